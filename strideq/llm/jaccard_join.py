"""Similarity join of word shingle sets by chosen paths.

Every text is its set of five-word shingles. Texts with equal sets are one content; the
join is between contents. It finds all pairs whose Jaccard similarity reaches the
threshold, up to the target recall, and reports per row its class and its links.

Sets are split recursively. At each node of a tree a set chooses, by a hash of node and
shingle, each of its shingles with a chance of about 1/(spread * size), and goes to the
child of every shingle it chose. Sets that share many shingles keep meeting, others
part. A child with a single set ends; a child of at most ``small`` sets is compared by
brute force; a larger one is split again, up to ``depth`` times. The whole is repeated
in as many independent runs as the target recall needs.

Within a bucket, sketches (one-permutation minhashes) tell which sets may be similar;
this only joins them into candidate groups, whose sketches leave a wide margin below
the threshold. Each group is then verified once and exactly: all its pairs whose sizes
allow the threshold, in blocks of bounded size, as products of incidence matrices. A
group's sets are dealt into size classes, so that only a class and the next one meet, and
each class into blocks of up to ``VERIFY`` sets; a set goes to as many tasks as there are
blocks to meet. A pair is never a row: a task gives every set's number of links and a
spanning forest. So a large group of near copies costs its comparisons but no quadratic
output, and blocks spread it over tasks. Tasks read their rows sorted, one block pair at
a time; nothing is collected by key.

Texts of contents that meet nobody are read once and never shuffled.

Defined results: null, empty and wordless texts have no shingles; each is a class of its
own with no links. A text of fewer than five words has one shingle, all its words. Rows
with equal sets are one class whatever their ids; the class id is the least id in the
class, null if all are null. ``n_links`` counts the other contents (not rows) that the
row's content is similar to. An empty table gives an empty result. Very long texts are
sets like others. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideq.llm.common import hint_small, remove, saved, table
from strideq.llm.graph import components
from strideq.llm.text_arrays import as_bytes, finished, mixed, parts, raw_words, rows_by, words

_WORD = raw_words()
_MUL = np.uint64(0x9E3779B97F4A7C15)
SKETCH = 128
BLOCK = 512
VERIFY = 2048
#: How far below the threshold sketches may be.
MARGIN = 0.2


def shingle_sets(texts: list[bytes | None], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    open_: list[np.ndarray] = []
    at = 0

    def whole() -> np.ndarray:
        h = np.concatenate(open_) if len(open_) != 1 else open_[0]
        if not len(h):
            return h
        n = len(h) - size + 1
        with np.errstate(over="ignore"):
            if n < 1:
                s = np.zeros(1, np.uint64)
                for x in h:
                    s = mixed(s * _MUL + x + np.uint64(1))
            else:
                s = h[:n].copy()
                for k in range(1, size):
                    s = s * _MUL + h[k : k + n]
                s = mixed(s)
        return np.unique(s)

    for buffer, of, begin in parts(texts):
        start, _, h = words(buffer, _WORD)
        first = np.append(np.searchsorted(start, begin), len(h))
        for i, text in enumerate(of):
            if text != at:
                yield whole()
                open_, at = [], int(text)
            open_.append(h[first[i] : first[i + 1]])
    if open_:
        yield whole()


def sketch(s: np.ndarray) -> bytes:
    """A byte of the least hash in each of SKETCH ranges; 0 for an empty range."""
    bits = SKETCH.bit_length() - 1
    at = np.searchsorted(s, np.arange(SKETCH, dtype=np.uint64) << np.uint64(64 - bits))
    there = np.minimum(at, len(s) - 1)
    own = (s[there] >> np.uint64(64 - bits)) == np.arange(SKETCH, dtype=np.uint64)
    return np.where(own & (at < len(s)), 1 + (s[there] % np.uint64(255)).astype(np.uint8), 0).astype(np.uint8).tobytes()


def chosen(s: np.ndarray, node: int, spread: float) -> np.ndarray:
    """The children of ``node`` that set ``s`` goes to."""
    with np.errstate(over="ignore"):
        h = mixed(s * np.uint64(node | 1) + np.uint64(node))
    limit = np.uint64(min(int(2.0**64 / (spread * len(s))), 2**64 - 1))
    return h[h <= limit]


def runs_needed(threshold: float, spread: float, depth: int, recall: float) -> int:
    """How many runs find a pair at the threshold with the chance ``recall``: the sets
    meet in a number of shared children that is nearly Poisson at each level."""
    mean, alive = threshold / spread, 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-mean * alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def join(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, recall: float = 0.99, spread: float = 0.7, small: int = BLOCK, depth: int = 4, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, class_id, n_links, n_copies (rows with an equal set) of every row; and the
    columns named in ``keep``."""
    spark = docs.sparkSession
    runs = runs_needed(threshold, spread, depth, recall)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    long, binary = T.LongType(), T.BinaryType()
    schema = T.StructType([d.schema["doc_id"], *[T.StructField(k, v) for k, v in {"text_key": long, "sig": binary, "n": long, "sketch": binary, "paths": T.ArrayType(long)}.items()]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = [int(x) for x in mixed(np.arange(1, runs + 1, dtype=np.uint64))]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sig, n, sketches, paths = [], [], [], []
                for s in shingle_sets(as_bytes(part.column("text")), shingle):
                    n.append(len(s))
                    sig.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sketches.append(sketch(s) if len(s) else None)
                    paths.append(np.concatenate([chosen(s, node, spread) for node in nodes]).view(np.int64) if len(s) else [])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(sig, pa.binary()), pa.array(n, pa.int64()), pa.array(sketches, pa.binary()), pa.array(paths, pa.list_(pa.int64()))],
                    ["doc_id", "text_key", "sig", "n", "sketch", "paths"],
                )
        finished()

    rows, _ = saved(d.mapInArrow(scan, schema), "scan")
    lone = rows.filter("sig is null")
    # One row per content; of equal sets the least row stands for all. Equal sets have
    # equal sketches and paths.
    pick = F.min(F.struct(F.col("doc_id").isNull().alias("o"), "doc_id", "text_key", "n", "sketch", "paths")).alias("p")
    contents, _ = saved(rows.filter("sig is not null").groupBy("sig").agg(pick, F.count(F.lit(1)).alias("n_copies")).select("sig", "n_copies", "p.doc_id", "p.text_key", "p.n", "p.sketch", "p.paths"), "contents")

    # Level one: buckets of at least two contents.
    placed, spent = _buckets(contents.select("sig", F.explode("paths").alias("node")))
    all_edges = [saved(_candidates(placed.filter(F.col("n_sets") <= small), contents, threshold), "edges")[0]]
    deep = placed.filter(F.col("n_sets") > small).select("node", "sig")
    # What follows is small beside the sets, so the sets are not shuffled for it.
    needed = all_edges[0].select(F.col("a").alias("sig")).unionByName(all_edges[0].select(F.col("b").alias("sig"))).unionByName(deep.select("sig")).distinct()
    needed, needed_at = saved(needed, "needed")
    few, _ = saved(contents.drop("paths").join(hint_small(needed), "sig"), "few")
    sets = _sets_of(d, few, shingle)
    spent.append(needed_at)

    level = 1
    while deep.limit(1).count() and level < depth:
        level += 1
        last = level == depth
        nodes, _ = saved(deep.groupBy("sig").agg(F.collect_list("node").alias("nodes")), "nodes")  # a set's nodes, a few

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    part, at, found = batch.slice(lo, 512), [], []
                    for i, (raw, own) in enumerate(zip(part.column("set").to_pylist(), part.column("nodes").to_pylist(), strict=True)):
                        s = np.frombuffer(raw, np.uint64)
                        kids = np.unique(np.concatenate([chosen(s, x & (2**64 - 1), spread) for x in own]))
                        at.append(np.full(len(kids), i))
                        found.append(kids.view(np.int64))
                    yield pa.RecordBatch.from_arrays([part.column("sig").take(pa.array(np.concatenate(at))), pa.array(np.concatenate(found))], ["sig", "node"])
            finished()

        placed, more = _buckets(sets.select("sig", "set").join(hint_small(nodes), "sig").mapInArrow(split, "sig binary, node bigint"))
        spent += more
        ready = placed if last else placed.filter(F.col("n_sets") <= small)
        all_edges.append(saved(_candidates(ready, few, threshold), "edges")[0])
        deep = placed.filter(F.col("n_sets") > small).select("node", "sig")

    near = all_edges[0]
    for e in all_edges[1:]:
        near = near.unionByName(e)
    groups, _ = saved(components(near).select(F.col("node").alias("sig"), F.xxhash64("root").alias("grp")), "groups")
    verified = _verify(groups, sets, threshold)
    for df in (sets, near, groups, few):
        spent += sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})
    for path in spent:
        remove(spark, path)
    links = verified.groupBy("sig").agg(F.sum("links").cast("long").alias("n_links"))
    tied = components(verified.filter("other is not null").select(F.col("sig").alias("a"), F.col("other").alias("b")))
    tied, _ = saved(tied.join(contents.select(F.col("sig").alias("node"), "doc_id"), "node"), "tied")
    least, _ = saved(tied.groupBy("root").agg(F.min("doc_id").alias("class_id")), "least")
    classes = tied.join(hint_small(least), "root").select(F.col("node").alias("sig"), "class_id")
    table_, _ = saved(
        contents.select("sig", "n_copies", "doc_id")
        .join(links, "sig", "left")
        .join(classes, "sig", "left")
        .select("sig", "n_copies", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")),
        "classes",
    )
    out = ["doc_id", "class_id", "n_links", "n_copies", *keep]
    # A content with very many copies is one key; what meets is written, so it can be split.
    paired = rows.filter("sig is not null").join(table_, "sig").select(*out)
    alone = lone.withColumns({"class_id": F.col("doc_id"), "n_links": F.lit(0).cast("long"), "n_copies": F.lit(1).cast("long")}).select(*out)
    return paired.unionByName(alone)


def _buckets(placed: DataFrame) -> tuple[DataFrame, list[str]]:
    """Set and node rows of nodes with two sets or more, with their number ``n_sets``; and
    the folders written. The numbers are written before they meet the rows, so that a node
    with very many sets can be split among tasks."""
    placed, at = saved(placed, "placed")
    full, full_at = saved(placed.groupBy("node").agg(F.count(F.lit(1)).alias("n_sets")).filter("n_sets > 1"), "full")
    met, met_at = saved(placed.join(full.hint("merge"), "node"), "met")
    for path in (at, full_at):
        remove(placed.sparkSession, path)
    return met, [met_at]


def _candidates(members: DataFrame, contents: DataFrame, threshold: float) -> DataFrame:
    """Edges between sets of a bucket whose sketches allow similarity: a spanning forest
    per pair of blocks. A bucket of up to BLOCK sets is one block; larger ones are left
    only where splitting ends, and have blocks of up to VERIFY sets."""
    least = max(0.0, threshold - MARGIN)
    blocks = F.when(F.col("n_sets") <= BLOCK, 1).otherwise(F.ceil(F.col("n_sets") / VERIFY)).cast("int")
    m = members.select("node", "sig", blocks.alias("k")).withColumn("own", F.pmod(F.xxhash64("sig"), F.col("k")).cast("int"))
    m = m.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    m = m.select("node", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "sig")
    m = m.join(contents.select("sig", "sketch").hint("merge"), "sig")
    key = ["node", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for rows in rows_by(batches, key):
            sets = sorted(zip(rows.column("sig").to_pylist(), rows.column("sketch").to_pylist(), strict=True))
            k = np.frombuffer(b"".join(x for _, x in sets), np.uint8).reshape(len(sets), SKETCH)
            for i, j in _forest(len(sets), _sketch_pairs(k, least)):
                a.append(sets[i][0])
                b.append(sets[j][0])
            if len(a) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
        finished()

    return m.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a binary, b binary").distinct()


def _sketch_pairs(k: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each set the later sets whose sketches agree in at least ``least`` of the
    ranges that either fills."""
    for i in range(len(k) - 1):
        rest = k[i + 1 :]
        same = ((rest == k[i]) & (rest > 0)).sum(axis=1)
        either = ((rest > 0) | (k[i] > 0)).sum(axis=1)
        yield i, i + 1 + np.flatnonzero(same >= least * either)


def _forest(n: int, pairs: Iterator[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """A spanning forest of the graph with these edges."""
    root = np.arange(n)
    found = []
    for i, js in pairs:
        if len(js):
            others = np.unique(root[js])
            others = others[others != root[i]]
            if len(others):
                found += [(i, int(o)) for o in others]
                root[np.isin(root, others)] = root[i]
    return found


def _sets_of(d: DataFrame, contents: DataFrame, shingle: int) -> DataFrame:
    """The sets of some contents, from the one row that stands for each."""
    wanted = contents.select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_"), "sig")
    wanted = hint_small(saved(wanted, "wanted")[0])
    met = d.join(wanted, (d["text_key"] == wanted["key_"]) & d["doc_id"].eqNullSafe(wanted["id_"])).select("sig", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sig, n, raw = [], [], []
                for want, s in zip(part.column("sig").to_pylist(), shingle_sets(as_bytes(part.column("text")), shingle), strict=True):
                    if xxhash.xxh3_128_digest(s.tobytes()) == want:
                        sig.append(want)
                        n.append(len(s))
                        raw.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(sig, pa.binary()), pa.array(n, pa.int64()), pa.array(raw, pa.binary())], ["sig", "n", "set"])
        finished()

    sets, path = saved(met.mapInArrow(run, "sig binary, n bigint, set binary"), "sets")
    if sets.count() == sets.select("sig").distinct().count():
        return sets
    # Rows repeated in full stand for one content more than once.
    once, _ = saved(sets.dropDuplicates(["sig"]), "sets")
    remove(d.sparkSession, path)
    return once


def _verify(groups: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Exact comparison of all pairs of every group that sizes allow: (sig, links, other),
    where ``links`` add up to a set's number of links and ``other`` are edges of a spanning
    forest. Of two similar sets the smaller has at least ``threshold`` times the larger's
    size, so their size classes are equal or neighbours."""
    t = Fraction(str(threshold))
    step = math.log(1 / threshold) * (1 + 1e-9) if 0 < threshold < 1 else 1e-9 if threshold >= 1 else math.inf
    size_class = F.floor(F.log(F.col("n")) / step).cast("long")
    sized, sized_at = saved(groups.join(hint_small(sets.select("sig", "n")), "sig").select("grp", "sig", "n", size_class.alias("c")), "sized")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / VERIFY), F.ceil(F.sum("n") / 2_000_000)).cast("int")
    shape, shape_at = saved(sized.groupBy("grp", "c").agg(blocks.alias("k")), "shape")
    shape = hint_small(shape)
    m = sized.drop("n").join(shape, ["grp", "c"])
    for name, by in (("up", -1), ("down", 1)):  # blocks of the classes above and below
        m = m.join(hint_small(shape.select("grp", (F.col("c") + by).alias("c"), F.col("k").alias(name))), ["grp", "c"], "left")
    own = F.pmod(F.xxhash64("sig"), F.col("k")).cast("int")
    m = m.withColumn("own", own)
    none = F.array().cast("array<struct<c: bigint, i: int, next: int, j: int, side: int>>")

    def tasks(n: Column, to) -> Column:
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), to)).otherwise(none)

    def task(c: Column, i: Column, next_: int, j: Column, side: Column) -> Column:
        return F.struct(c.cast("long").alias("c"), i.cast("int").alias("i"), F.lit(next_).alias("next"), j.cast("int").alias("j"), side.cast("int").alias("side"))

    c, at = F.col("c"), F.col("own")
    meets = F.concat(
        tasks(F.col("k"), lambda x: task(c, F.least(at, x), 0, F.greatest(at, x), F.when(at <= x, 0).otherwise(1))),
        tasks(F.coalesce("up", F.lit(0)), lambda x: task(c, at, 1, x, F.lit(0))),
        tasks(F.coalesce("down", F.lit(0)), lambda x: task(c - 1, x, 1, at, F.lit(1))),
    )
    key = ["grp", "c", "i", "next", "j"]
    m = m.select("sig", "grp", F.explode(meets).alias("t")).select("sig", "grp", "t.*")
    blocks_, blocks_at = saved(m, "blocks")
    met = sets.select("sig", "set").join(hint_small(blocks_), "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_by(batches, key):
            sides: list[list[tuple]] = [[], []]
            for x in zip(rows.column("sig").to_pylist(), rows.column("set").to_pylist(), rows.column("side").to_pylist(), strict=True):
                sides[x[2]].append(x)
            alone = rows.column("next")[0].as_py() == 0 and rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
            if sides[0] and (alone or sides[1]):
                yield _block(sides[0], sides[0] if alone else sides[1], t)
        finished()

    out, _ = saved(met.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "sig binary, links bigint, other binary"), "compared")
    for path in (sized_at, shape_at, blocks_at):
        remove(sets.sparkSession, path)
    return out


def _block(left: list[tuple], right: list[tuple], t: Fraction) -> pa.RecordBatch:
    """Links and forest between two blocks of sets (or within one)."""
    same = left is right
    every = left if same else left + right
    arrays = [np.frombuffer(x[1], np.uint64) for x in every]
    size = np.array([len(a) for a in arrays])
    _, token, count = np.unique(np.concatenate(arrays) if arrays else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(arrays)), size)
    # Shingles of a single set are in no intersection.
    name = np.cumsum(count > 1) - 1
    shared = count[token] > 1
    row, token = row[shared], name[token[shared]]
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    n, split = len(arrays), len(left)
    both = np.zeros((split, n if same else n - split), np.float32)
    step = 1024
    for lo in range(0, int(token[-1]) + 1 if len(token) else 0, step):
        a, b = np.searchsorted(token, [lo, lo + step])
        m = np.zeros((n, min(step, int(token[-1]) + 1 - lo)), np.float32)
        m[row[a:b], token[a:b] - lo] = 1
        both += m[:split] @ (m if same else m[split:]).T
    other = size if same else size[split:]
    linked = np.zeros(both.shape, bool)
    for lo in range(0, split, 256):
        met = both[lo : lo + 256].astype(np.int64)
        union = size[lo : min(lo + 256, split), None] + other[None, :] - met
        linked[lo : lo + 256] = met * t.denominator >= union * t.numerator
    if same:
        np.fill_diagonal(linked, False)
        links = linked.sum(axis=1)
    else:
        links = np.concatenate([linked.sum(axis=1), linked.sum(axis=0)])
    offset = 0 if same else split
    sigs = [x[0] for x in every]
    forest = _forest(n, ((i, offset + np.flatnonzero(linked[i])) for i in range(split)))
    out = [(sigs[k], int(v), None) for k, v in enumerate(links) if v] + [(sigs[a], 0, sigs[b]) for a, b in forest]
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], ["sig", "links", "other"])


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: five-word shingles, Jaccard similarity of 0.8 or more."""
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))
