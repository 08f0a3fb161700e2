"""Language identification by Bayesian fusion of several kinds of evidence.

For every row and language, log probabilities are added up:

- the text's likelihood: byte trigrams of its letters, under a model per language fitted
  to a bounded sample of labelled rows, weighed as at most ``EVIDENCE`` independent
  trigrams, since neighbours depend on each other;
- the language declared in the markup, and the address suffix: how often each value
  goes with each language;
- the host's prior, smoothed towards its domain's, and that towards all rows'.

The last three are learned from all rows by grouped aggregation of what the text alone
says. A row's own share is taken out again before it is judged.

A text is read once: its log likelihoods, a few numbers, are written with the row's keys,
and all that follows is column expressions on these slim rows. Texts are never shuffled.
A table of sums by key is broadcast if its bytes are few; else the ``hot`` keys with most
rows are (a fixed number), and only rows of other keys meet the table by a join. So a
host that a third of all rows have is never a join key.

``und`` competes as a language of uniform trigrams, so texts that fit no language are
undetermined. A row is accepted if its best language is not ``und`` and its posterior
reaches ``confident``.

Defined results: null and empty texts are judged by the other evidence alone. A missing
or malformed declaration, address or host is no evidence (its key is empty). Rows with
null or repeated ids are judged each. Without labelled rows every row is ``und``. The
model knows the ``languages`` most frequent declared languages; rows of others get the
most similar of these or ``und``, and a warning says so. An empty table gives an empty
result. Columns that aren't named are not read, whatever their names.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideq.llm.common import is_small, saved, table, trimmed
from strideq.llm.text_arrays import as_bytes, first_by_hash, parts

SLOTS = 1 << 16
EVIDENCE = 60
UNDETERMINED = "und"
#: Log probability of every trigram under ``und``.
UNIFORM = -10.0
STRENGTH = 10.0
_MARKUP = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>"


def _letters() -> np.ndarray:
    t = np.full(256, 32, np.uint32)
    for b in range(256):
        if b >= 128:
            t[b] = b
        elif chr(b).isalpha():
            t[b] = ord(chr(b).lower())
    return t


_LETTER = _letters()


def trigrams(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and slot of every byte trigram that has a letter in its middle."""
    m = np.full(len(buffer) + 2, 32, np.uint32)
    m[1:-1] = _LETTER[buffer]
    at = np.flatnonzero(m[1:-1] != 32)
    key = (m[at] << np.uint32(16)) | (m[at + 1] << np.uint32(8)) | m[at + 2]
    with np.errstate(over="ignore"):
        return at, ((key * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)


class Trigrams:
    """Log probabilities by slot and language; the last language is ``und``."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.languages = [*sorted(samples), UNDETERMINED]
        self.log_p = np.full((SLOTS, len(self.languages)), UNIFORM, np.float32)
        for i, name in enumerate(self.languages[:-1]):
            c = np.full(SLOTS, 0.05)
            for buffer, _, _ in parts(samples[name]):
                c += np.bincount(trigrams(buffer)[1], minlength=SLOTS)
            self.log_p[:, i] = np.log(c / c.sum())

    def log_likelihood(self, texts: list[bytes | None]) -> np.ndarray:
        """Weighed log likelihood of each text by language."""
        total, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for buffer, of, begin in parts(texts):
            at, slot = trigrams(buffer)
            if not len(at):
                continue
            piece = np.searchsorted(begin, at, side="right") - 1
            there, first = np.unique(piece, return_index=True)
            np.add.at(total, of[there], np.add.reduceat(self.log_p[slot], first, axis=0, dtype=np.float64))
            np.add.at(n, of[there], np.diff(np.append(first, len(at))))
        return total * np.minimum(1.0, EVIDENCE / np.maximum(n, 1))[:, None]


def fit(docs: DataFrame, language_col: str, most: int = 400, languages: int = 200) -> Trigrams:
    """Trigram models of the ``languages`` most frequent declared languages, from at most
    ``most`` rows of each, the first by a hash of id and text, with whole texts. Rows that
    repeat id and text count once."""
    of = [c for c in ("doc_id", "text") if c in docs.columns]
    d = docs.select(primary(F.col(language_col)).alias("y_"), *of).filter("y_ <> '' and text is not null")
    names = [r[0] for r in d.groupBy("y_").count().orderBy(F.desc("count"), "y_").limit(languages + 2).collect() if r[0] != UNDETERMINED]
    if len(names) > languages:
        warnings.warn(f"more than {languages} declared languages: the model knows the most frequent ones", stacklevel=2)
    picked: dict[str, list[bytes]] = {n: [] for n in names[:languages]}
    for r in first_by_hash(d, "y_", dict.fromkeys(picked, most), of).collect() if picked else []:
        picked[r["y_"]].append(r["text"].encode("utf-8", "surrogatepass"))
    return Trigrams(picked)


def primary(c: Column) -> Column:
    """The primary tag of a declared language in lower case; empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(c.cast("string")), r"^\s*([a-z]{2,3})(?:[-_].*)?\s*$", 1), F.lit(""))


def _shares(log_p: Column) -> Column:
    """Probabilities from log weights."""
    return _scaled(_let(log_p, lambda a: F.transform(a, lambda x: F.exp(x - F.array_max(a)))))


def _scaled(p: Column) -> Column:
    """An array divided by its sum."""
    return _let(p, lambda a: F.transform(a, lambda x: x / F.aggregate(a, F.lit(0.0), lambda s, y: s + y)))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def identify(rows: DataFrame, model: Trigrams, text: Column, host: Column, declared: Column | None = None, suffix: Column | None = None, domain: Column | None = None, carry: dict[str, Column] | None = None, confident: float = 0.6, hot: int = 20_000) -> DataFrame:
    """The columns of ``carry``, with ``language``, ``probability`` and ``accepted``, for
    every row. Evidence that isn't given has no say."""
    carry = carry or {}
    n = len(model.languages)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def likelihood(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = [sent.value.log_likelihood(as_bytes(batch.slice(lo, 512))).ravel() for lo in range(0, len(batch), 512)]
            flat = np.concatenate(out) if out else np.zeros(0)
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n), pa.int32()), pa.array(flat))
        trimmed()

    of = {"declared_": declared, "suffix_": suffix, "domain_": domain, "host_": host}
    keys = {k: F.coalesce(c.cast("string"), F.lit("")) for k, c in of.items() if c is not None}
    own = rows.select(*[c.alias(f"c{i}_") for i, c in enumerate(carry.values())], *[c.alias(k) for k, c in keys.items()], text.alias("text_"))
    slim = own.select(*[f"c{i}_" for i in range(len(carry))], *keys, likelihood("text_").alias("ll_")).withColumn("p_", _shares(F.col("ll_")))
    slim, _ = saved(slim, "likelihood")

    each = [F.sum(F.get("p_", F.lit(i))).alias(f"s{i}_") for i in range(n)]
    by_key, _ = saved(slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_"), *each), "evidence")
    total = [F.sum(f"s{i}_").alias(f"s{i}_") for i in range(n)]
    everything = by_key.agg(*total).first()
    overall = F.array(*[F.lit(everything[i] or 0.0) for i in range(n)])

    met = slim
    for k in keys:
        sums = by_key.groupBy(k).agg(F.sum("rows_").alias("rows_"), *total).select(k, "rows_", F.array(*[F.col(f"s{i}_") for i in range(n)]).alias("n_" + k))
        met = _meet(met, saved(sums, k)[0], k, "n_" + k, hot)

    def others(k: str) -> Column:
        return F.zip_with("n_" + k, "p_", lambda a, b: F.greatest(a - b, F.lit(0.0)))

    met = met.withColumn("every_", F.zip_with(overall, "p_", lambda a, b: F.greatest(a - b, F.lit(0.0)) + 1.0))
    met = met.withColumn("prior_", _scaled(F.col("every_")))
    met = met.withColumn("log_", F.col("ll_"))
    for k in [k for k in ("declared_", "suffix_") if k in keys]:
        # P(value | language), up to what is the same for all languages.
        given = F.zip_with(F.zip_with(others(k), "prior_", lambda a, b: a + STRENGTH * b), "every_", lambda a, b: F.log(a / b))
        met = met.withColumn("log_", F.when(F.col(k) != "", F.zip_with("log_", given, lambda a, b: a + b)).otherwise(F.col("log_")))
    for k in [k for k in ("domain_", "host_") if k in keys]:
        met = met.withColumn("prior_", _scaled(F.zip_with(others(k), "prior_", lambda a, b: a + STRENGTH * b)))
    met = met.withColumn("post_", _shares(F.zip_with("log_", "prior_", lambda a, b: a + F.log(b))))
    met = met.withColumn("best_", F.array_max("post_")).withColumn("at_", F.array_position("post_", F.col("best_")).cast("int"))
    names = F.array(*[F.lit(x) for x in model.languages])
    accepted = (F.col("best_") >= confident) & (F.col("at_") < n)
    return met.select(*[F.col(f"c{i}_").alias(c) for i, c in enumerate(carry)], F.element_at(names, F.col("at_")).alias("language"), F.col("best_").alias("probability"), accepted.alias("accepted"))


def _meet(rows: DataFrame, sums: DataFrame, key: str, value: str, hot: int) -> DataFrame:
    """Every row with its key's sums. Every row's key is in ``sums``."""
    if is_small(sums):
        return rows.join(F.broadcast(sums.drop("rows_")), key)
    most = sums.orderBy(F.desc("rows_"), key).limit(hot).drop("rows_")
    first = rows.join(F.broadcast(most), key, "left")
    there = first.filter(F.col(value).isNotNull())
    rest = first.filter(F.col(value).isNull()).drop(value).join(sums.drop("rows_"), key)
    return there.unionByName(rest)


def of_documents(docs: DataFrame, model: Trigrams, carry: dict[str, Column] | None = None) -> DataFrame:
    """Documents: the declared language is ``lang``, the host is ``source``."""
    return identify(docs, model, F.col("text"), F.col("source"), primary(F.col("lang")), carry=carry or {"doc_id": F.col("doc_id")})


def of_pages(pages: DataFrame, model: Trigrams) -> DataFrame:
    """Web pages: declared language from the markup, suffix, domain and host from the address."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    return identify(
        pages,
        model,
        F.regexp_replace("html", _MARKUP, " "),
        host,
        F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1)),
        F.regexp_extract(host, r"\.([a-z]{2,24})$", 1),
        F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1),
        {"page_id": F.col("page_id")},
    )


def kept(docs: DataFrame, model: Trigrams) -> DataFrame:
    """The documents whose language is accepted, with all their columns.

    What goes is known by id and a hash of all that was judged; rows equal in these have
    one verdict. Only the rejected rows' keys come back to the documents."""
    key = F.xxhash64("text", F.lit(1), "lang", F.lit(2), "source")  # a null leaves no trace, so places are marked
    judged = of_documents(docs, model, {"id_": F.col("doc_id"), "key_": key})
    gone, _ = saved(judged.filter("not accepted").select(F.col("id_").alias("gone_id"), F.col("key_").alias("gone_key")).distinct(), "rejected")
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id_"), key.alias("key_"))
    gone = F.broadcast(gone) if is_small(gone) else gone
    return marked.join(gone, F.col("id_").eqNullSafe(F.col("gone_id")) & (F.col("key_") == F.col("gone_key")), "left_anti").select("row.*")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all pages with their language."""
    docs, pages = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), table(spark, sf_dir, "pages").select("page_id", "url", "html")
    model = fit(docs, "lang")
    own = of_documents(docs, model).withColumn("page_id", F.lit(None).cast("long"))
    web = of_pages(pages, model).withColumn("doc_id", F.lit(None).cast("long"))
    return own.unionByName(web).select("doc_id", "page_id", "language", "probability", "accepted")
