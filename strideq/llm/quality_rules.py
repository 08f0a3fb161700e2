"""Quality rules as a short-circuit cascade, with DataFrame functions only.

Base counts of every text come first; a text that fails the base test is settled.
The remaining rules are tried in an order estimated on a sample: each rule's cost
(time per row, over enough repetitions to stand out of the noise) and selectivity (share
of rows it rejects), most rejection per cost first. A CASE expression evaluates them lazily, so a row pays only for the rules up
to its first rejection. The order changes the time, never the verdict.

Defined results: a null text has no words, so it fails the base test; so does an empty
one. Rows with a null or repeated id are judged like any other. Columns of the input
other than the two named ones are ignored, whatever their names. An empty table gives
an empty result.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideq.llm.common import table

#: The characters that end a word, and those that count as symbols.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS = 50


@dataclass(frozen=True)
class Rule:
    """A named SQL condition over the base counts and ``text``; true rejects the row."""

    name: str
    rejects: str


RULES = (
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("exclamation", "10 * (length(text) - length(replace(text, '!', ''))) > 3 * n_words"),
    Rule("capitals", "2 * (length(text) - length(regexp_replace(text, '[A-Z]', ''))) > word_chars"),
    Rule("digits", "2 * (length(text) - length(regexp_replace(text, '[0-9]', ''))) > word_chars"),
)


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text and the base counts of every text."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def repeated(w):
        # Each three-word window with its place; equal windows become neighbours.
        windows = F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
            lambda x, i: F.struct(F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)).alias("k"), i.alias("p")),
        )

        def places(s):
            same = lambda x, y: F.coalesce(x["k"] == y["k"], F.lit(False))
            twice = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
            return F.sort_array(F.transform(twice, lambda x: x["p"]))

        def covered(p):
            # A window covers three words, less what the next one covers too.
            return F.aggregate(
                F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            )

        return _let(_let(F.sort_array(windows), places), covered)

    def counts(w):
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated(w).alias("n_repeat_words"))

    def lines(t):
        full = F.filter(t, lambda x: F.length(F.translate(x, SPACES, "")) > 0)
        return _let(full, lambda f: (F.size(f) - F.size(F.array_distinct(f))).cast("long"))

    text = F.col("text")
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    d = d.select(
        "doc_id",
        "text",
        _let(words, counts).alias("c"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(F.split(text, "\n"), lines).alias("n_dup_lines"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long").alias("n_lines"),
    )
    return d.select("doc_id", "text", "c.n_words", "word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words", "n_lines").withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )


def _let(value, body):
    """``body`` of ``value``, computed once: a lambda's variable is never inlined again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def order_rules(counts: DataFrame, rules: tuple[Rule, ...] = RULES, evaluations: int = 100_000, characters: int = 40_000_000, rounds: int = 3) -> list[Rule]:
    """The rules by estimated rejection per cost, measured on base counts of a sample.

    A rule's cost is the time of about ``evaluations`` evaluations in one job (fewer where
    texts of the sample have more than ``characters`` so often), its rows repeated, less that of a rule that reads nothing; the first job of each is
    not counted, and of the ``rounds`` others the median is. Costs below what the empty
    rule's own times differ by can't be told apart and count as that.
    """
    kept = counts.filter("not base_failed").cache()
    try:
        n = kept.count()
        if not n:
            return list(rules)
        shares = kept.agg(*[F.avg(F.expr(r.rejects).cast("int")).alias(r.name) for r in rules]).first()
        length = kept.agg(F.sum(F.length("text"))).first()[0]
        times = max(1, min(evaluations // n, characters // max(length, 1)))
        many = kept.withColumn("again_", F.explode(F.sequence(F.lit(1), F.lit(times))))

        def seconds(condition: str) -> list[float]:
            took = []
            for _ in range(rounds + 1):
                began = time.perf_counter()
                many.agg(F.sum(F.expr(condition).cast("int"))).collect()
                took.append(time.perf_counter() - began)
            return sorted(took[1:])

        empty = seconds("again_ < 0")
        noise = max(empty[-1] - empty[0], 1e-3)
        cost = {r.name: max(seconds(r.rejects)[rounds // 2] - empty[rounds // 2], noise) / (n * times) for r in rules}
        gain = {r.name: (shares[r.name] or 0.0) / cost[r.name] for r in rules}
        return sorted(rules, key=lambda r: (-gain[r.name], r.name))
    finally:
        kept.unpersist()


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, text, base counts, ``base_failed`` and ``kept``.

    About ``sample_rows`` random rows serve to order the rules, and for nothing else.
    """
    n = docs.count()  # from the files' footers
    sample = docs.sample(min(1.0, sample_rows / n), seed=7) if n > sample_rows else docs
    ordered = order_rules(base_counts(sample, id_col, text_col), rules)
    counts = base_counts(docs, id_col, text_col)
    verdict = F.when(F.col("base_failed"), F.lit(False))
    for r in ordered:
        verdict = verdict.when(F.expr(r.rejects), F.lit(False))
    return counts.withColumn("kept", verdict.otherwise(F.lit(True)))


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the cascade."""
    return cascade(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*COLUMNS)


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
tri AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
t AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM tri),
cov AS (SELECT r, count(DISTINCT i + o) AS n FROM t, (SELECT unnest([0, 1, 2]) AS o) WHERE c > 1 GROUP BY r),
c AS (SELECT w.r, doc_id, text, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        len(string_split(text, chr(10)))::BIGINT AS n_lines
      FROM w LEFT JOIN cov ON w.r = cov.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 3 * n_lines
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 10 * (length(text) - length(replace(text, '!', ''))) > 3 * n_words
    OR 2 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > word_chars
    OR 2 * (length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) > word_chars) AS kept
FROM b
"""
