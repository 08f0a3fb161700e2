"""Substring deduplication by sliding sentence spans.

A text is cut into sentences: at line ends, and after ``. ! ?`` before white space. A
sentence of more than ``LONG`` words is cut further after commas, semicolons and colons,
so that passages without full stops have borders too. Every run of consecutive sentences
that holds at least ``run`` sentences and ``words`` words, the shortest such run from each
sentence on and the shortest up to each sentence, is hashed to 128 bits. Runs with equal
hashes meet globally. The first occurrence, by id and place, stays; a sentence that is covered by any
other occurrence goes. Letters' case and spacing don't count in comparisons.

Counts of hashes are added up by each task before they meet; only runs that occur twice
go on. Of these, runs of a text that overlap or touch are one span, and a span as a whole
is compared first: all its runs repeat earlier ones wherever it isn't first. So a passage
that a third of all texts hold is a row in each, and single runs are compared only in the
first text of every distinct span.

Defined results: a null text stays null; an empty text stays empty. A null id comes last.
Rows with the same id and the same text are one row and share what happens to it; of rows
with the same id and other texts, a hash of the text says which is first. Texts too short
for a run stay. A text of which everything goes becomes empty. An empty table gives an
empty result. Other columns pass through unread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideq.llm.common import hint_small, remove, saved, table
from strideq.llm.text_arrays import finished, mixed, powers, whole_keys

LONG = 24
_BORDER = re.compile(r"\n\s*|(?<=[.!?])\s+")
_CLAUSE = re.compile(r"(?<=[,;:])\s+")


def sentences(text: str) -> list[tuple[int, int, str]]:
    """Start, end and normal form of every sentence with a word; they cover the text,
    except for white space at its start."""
    out: list[tuple[int, int, str]] = []
    at = 0
    for m in _BORDER.finditer(text):
        _sentence(text, at, m.end(), out)
        at = m.end()
    if at < len(text):
        _sentence(text, at, len(text), out)
    return out


def _sentence(text: str, at: int, end: int, out: list[tuple[int, int, str]]) -> None:
    words = text[at:end].lower().split()
    if len(words) > LONG:
        lo = at
        for m in _CLAUSE.finditer(text, at, end):
            own = text[lo : m.end()].lower().split()
            if len(own) >= LONG // 2:
                out.append((lo, m.end(), " ".join(own)))
                lo = m.end()
        words, at = text[lo:end].lower().split(), lo
    if words:
        out.append((at, end, " ".join(words)))


def runs(text: str, least_sentences: int, least_words: int) -> tuple[list[tuple[int, int, str]], np.ndarray, np.ndarray, np.ndarray]:
    """Sentences of a text, and of its runs the first sentence, the last and the hash (two
    columns of 64 bits)."""
    own = sentences(text)
    n = len(own)
    if n < least_sentences:
        return own, *(np.zeros(0, np.int64),) * 2, np.zeros((0, 2), np.uint64)
    h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(s) for _, _, s in own]), np.uint64).reshape(n, 2)
    words = np.cumsum([0] + [s.count(" ") + 1 for _, _, s in own])
    at = np.arange(n)
    # The shortest run from each sentence on, and the shortest up to each sentence.
    last = np.maximum(np.searchsorted(words, words[:-1] + least_words) - 1, at + least_sentences - 1)
    first = np.minimum(np.searchsorted(words, words[1:] - least_words, side="right") - 1, at - least_sentences + 1)
    lo, hi = np.concatenate([at, first]), np.concatenate([last, at])
    there = (lo >= 0) & (hi < n)
    pairs = np.unique(np.stack([lo[there], hi[there]], axis=1), axis=0)
    lo, hi = pairs[:, 0], pairs[:, 1]
    # Hash of a run: for either half of its sentences' hashes a polynomial, by sums up to
    # its ends.
    with np.errstate(over="ignore"):
        p, inverse = powers(n)
        s = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(h * p[:n, None], axis=0, dtype=np.uint64)])
        return own, lo, hi, ((s[hi + 1] - s[lo]) * inverse[lo, None]) ^ (hi - lo).astype(np.uint64)[:, None]


def dedup(docs: DataFrame, run: int = 2, words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` in a struct ``row``, with ``clean_text`` and ``removed`` (start and end of
    each removed stretch, in characters)."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id_"), F.col(f"`{text_col}`").alias("text_"))
    d = d.withColumn("key_", F.xxhash64("text_"))
    light = d.select("id_", "key_", "text_")
    integer = T.IntegerType()
    schema = T.StructType([T.StructField("h0", T.LongType()), T.StructField("h1", T.LongType()), light.schema["id_"], light.schema["key_"], T.StructField("first", integer), T.StructField("last", integer)])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                of, first, last, hashes = [], [], [], []
                for i, t in enumerate(part.column("text_").to_pylist()):
                    _, a, b, h = runs(t or "", run, words)
                    of.append(np.full(len(a), i))
                    first.append(a)
                    last.append(b)
                    hashes.append(h)
                at, h = pa.array(np.concatenate(of)), np.concatenate(hashes).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), part.column("id_").take(at), part.column("key_").take(at), *[pa.array(np.concatenate(x).astype(np.int32)) for x in (first, last)]],
                    ["h0", "h1", "id_", "key_", "first", "last"],
                )
        finished()

    h = ["h0", "h1"]
    found, found_at = saved(light.mapInArrow(spans, schema), "spans")
    # First which hashes occur twice; only their runs carry places. What joins is written
    # before, so that a hash with very many runs can be split among tasks.
    twice, twice_at = saved(found.groupBy(*h).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*h), "twice")
    again, again_at = saved(found.join(twice.hint("merge"), h), "again")
    remove(d.sparkSession, found_at)
    chains, chains_at = saved(_chains(again), "chains")
    remove(d.sparkSession, again_at)
    # A span stays where it is first; wherever else it is, all its runs are repeats.
    c = ["c0", "c1"]
    place = [F.col("id_").isNull().alias("o"), "id_", "key_", "start"]
    firsts = chains.groupBy(*c).agg(F.min(F.struct(*place, "runs_")).alias("p"))
    firsts, firsts_at = saved(firsts.select(*c, "p.*"), "firsts")
    kept = firsts.select(*c, F.col("id_").alias("kept_id"), F.col("key_").alias("kept_key"), F.col("start").alias("kept_start"))
    is_first = F.col("id_").eqNullSafe(F.col("kept_id")) & (F.col("key_") == F.col("kept_key")) & (F.col("start") == F.col("kept_start"))
    copies = chains.drop("runs_").join(kept.hint("merge"), c).filter(~is_first).select("id_", "key_", F.col("start").alias("first"), F.col("end").alias("last"))
    # Of first spans each run is looked at: another span may hold it too.
    inner, inner_at = saved(firsts.select("id_", "key_", F.explode("runs_").alias("r")).select("id_", "key_", "r.*"), "inner")
    first = F.struct(F.col("id_").isNull().alias("o"), "id_", "key_", "first")
    least, least_at = saved(inner.groupBy(*h).agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("p")).filter("n > 1").select(*h, F.col("p.id_").alias("kept_id"), F.col("p.key_").alias("kept_key"), F.col("p.first").alias("kept_first")), "least")
    is_first = F.col("id_").eqNullSafe(F.col("kept_id")) & (F.col("key_") == F.col("kept_key")) & (F.col("first") == F.col("kept_first"))
    later = inner.join(least.hint("merge"), h).filter(~is_first).select("id_", "key_", "first", "last")
    # What a text loses, as stretches of sentences.
    cut = copies.unionByName(later).groupBy("id_", "key_").agg(F.collect_set(F.struct("first", "last")).alias("r"))
    cut, _ = saved(cut.select(F.col("id_").alias("cut_id"), F.col("key_").alias("cut_key"), _stretches(F.sort_array("r")).alias("runs_")), "cut")
    for path in (twice_at, chains_at, firsts_at, inner_at, least_at):
        remove(d.sparkSession, path)
    # Which texts lose anything: small beside the texts, so they stay where they are; beyond
    # the bound they have to meet.
    met = d.select("row", "id_", "key_", "text_").join(hint_small(cut), (F.col("key_") == F.col("cut_key")) & F.col("id_").eqNullSafe(F.col("cut_id")), "left")

    @F.arrow_udf("struct<clean_text: string, removed: array<struct<start: int, end: int>>>")
    def cut_out(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([("clean_text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        for texts, covered in batches:
            out = []
            for lo in range(0, len(texts), 256):
                found = []
                for text, own in zip(texts.slice(lo, 256).to_pylist(), covered.slice(lo, 256).to_pylist(), strict=True):
                    clean, gone = (text, []) if own is None else without(text, [(r["first"], r["last"]) for r in own])
                    found.append({"clean_text": clean, "removed": [{"start": a, "end": b} for a, b in gone]})
                out.append(pa.array(found, kind))
            yield pa.concat_arrays(out) if out else pa.array([], kind)
        finished()

    # Only texts that lose something go through Python.
    whole = met.filter("runs_ is null").select("row", F.col("text_").alias("clean_text"), F.array().cast("array<struct<start: int, end: int>>").alias("removed"))
    less = met.filter("runs_ is not null").select("row", cut_out("text_", "runs_").alias("c")).select("row", "c.clean_text", "c.removed")
    return whole.unionByName(less)


def _chains(again: DataFrame) -> DataFrame:
    """Repeated runs as spans: the runs of a text that overlap or touch, with their number
    of sentences, the hash of them all (``c0``, ``c1``), and the runs themselves. A passage
    that many texts hold is one span in each of them, not as many rows as it has runs."""
    doc = F.xxhash64("id_", "key_")
    rows = again.withColumn("doc_", doc).repartition("doc_", "key_").sortWithinPartitions("doc_", "key_", "first", "last")
    integer, long = T.IntegerType(), T.LongType()
    run_ = T.StructType([T.StructField("h0", long), T.StructField("h1", long), T.StructField("first", integer), T.StructField("last", integer)])
    schema = T.StructType([again.schema["id_"], again.schema["key_"], T.StructField("start", integer), T.StructField("end", integer), T.StructField("c0", long), T.StructField("c1", long), T.StructField("runs_", T.ArrayType(run_))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_keys(batches, ["doc_", "key_"]):
            column = lambda name, rows=rows: rows.column(name).to_numpy()
            doc, key, first, last = column("doc_"), column("key_"), column("first"), column("last")
            new = np.ones(len(doc), bool)
            # A run repeated in full: rows with the same id and text are one.
            same = (doc[1:] == doc[:-1]) & (key[1:] == key[:-1]) & (first[1:] == first[:-1]) & (last[1:] == last[:-1])
            take = np.flatnonzero(np.append(True, ~same))
            doc, key, first, last = doc[take], key[take], first[take], last[take]
            other = np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))
            text = np.cumsum(other) - 1
            # The greatest end so far in each text: ends are moved apart by text first.
            far = np.int64(1) << np.int64(32)
            reach = np.maximum.accumulate(last.astype(np.int64) + text * far) - text * far
            new = other.copy()
            new[1:] |= first[1:] > reach[:-1] + 1
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, len(doc)))
            start = first[begin]
            within = np.arange(len(doc)) - np.repeat(begin, size)
            shape = ((first - np.repeat(start, size)).astype(np.uint64) << np.uint64(32)) | (last - first).astype(np.uint64)
            hashes = []
            h = [column("h0")[take], column("h1")[take]]
            with np.errstate(over="ignore"):
                p = powers(int(size.max()))[0]
                for own in h:
                    x = mixed(own.view(np.uint64) ^ mixed(shape))
                    hashes.append(np.add.reduceat(x * p[within], begin).view(np.int64))
            at = pa.array(take[begin])
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(doc)), pa.int32()), pa.StructArray.from_arrays([pa.array(h[0]), pa.array(h[1]), pa.array(first), pa.array(last)], ["h0", "h1", "first", "last"]))
            yield pa.RecordBatch.from_arrays([rows.column("id_").take(at), rows.column("key_").take(at), pa.array(start), pa.array(np.maximum.reduceat(last, begin)), pa.array(hashes[0]), pa.array(hashes[1]), lists], [f.name for f in schema])
        finished()

    return rows.mapInArrow(run, schema)


def _stretches(runs_: Column) -> Column:
    """Sorted runs, those that overlap or touch put together."""
    kind = "array<struct<first: int, last: int>>"

    def add(done: Column, r: Column) -> Column:
        end = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(end["first"].alias("first"), F.greatest(end["last"], r["last"]).alias("last"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["last"] + 1 >= r["first"]), longer).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(runs_, F.array().cast(kind), add)


def without(text: str, covered: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """``text`` without the sentences of the covered runs, and the stretches removed."""
    own = sentences(text)
    gone = np.zeros(len(own) + 1, int)
    for first, last in covered:
        gone[first] += 1
        gone[last + 1] -= 1
    gone = np.cumsum(gone) > 0
    cut: list[tuple[int, int]] = []
    for (start, end, _), out in zip(own, gone, strict=False):
        if out:
            if cut and cut[-1][1] == start:
                cut[-1] = (cut[-1][0], end)
            else:
                cut.append((start, end))
    kept, at = [], 0
    for start, end in cut:
        kept.append(text[at:start])
        at = end
    return "".join([*kept, text[at:]]), cut


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without what another document, or the same one, says before."""
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", F.col("clean_text").alias("text"), F.size("removed").alias("n_removed"), "removed")
