"""Packing token sequences into windows by best-fit decreasing.

Documents become token ids; a document longer than a window is first cut into full
windows, each a sequence of its own. What remains of every document is one piece
shorter than a window. Pieces are placed longest first, each into the tightest open
window that holds it; a segment tree indexed by remaining capacity finds that window.

Best-fit decreasing depends on lengths alone, and there are fewer lengths than a
window has places. So the plan is made from the counts by length: the pieces of one
length go to runs of windows that have the same remaining capacity. The plan's size
depends on the window, not on the data. Pieces find their place in it by their rank
among the pieces of their length: a task's own count when it wrote them, plus the
counts of the tasks before it.

Defined results: a null text is an empty one, and an empty document still has its end
id. Rows with null or repeated ids are packed like any other; every row's ids are in
the output exactly once. An empty table has no pieces. Other columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideq.llm.common import hint_small, saved, table, trimmed

#: Characters from which on a text is encoded in pieces.
_LONG = 1 << 20
_BORDER = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
#: Words kept in each of two generations.
_CACHED = 100_000
#: A space with white space beside it: only there can a token span words' borders.
_ODD_SPACE = re.compile(r"^\s| \s|\s | $")
_PLAIN = re.compile(r"[\n\x20-\x7E\xA1-ʯ]*")


class Encoder:
    """The byte-level encoder. A text is encoded at once: in text of many different words
    that is less than half the work of looking up its words one by one. Long texts are cut
    at spaces between letters, which always begin a token, so no list of ids is long."""

    def __init__(self, ranks_path: str, special: str, special_id: int):
        import public_tokenizers

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._special, self._special_id = special, np.array([special_id], "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        ids = self._bpe.encode_ordinary(text)
        return np.fromiter(ids, "<u4", len(ids)).tobytes()

    def _part(self, text: str) -> bytes:
        out, at = [], 0
        while len(text) - at > _LONG and (cut := _BORDER.search(text, at + _LONG)):
            out.append(self._plain(text[at : cut.start()]))
            at = cut.start()
        return b"".join([*out, self._plain(text[at:] if at else text)])

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids; the special token's own text is that token."""
        if self._special in text:
            return self._special_id.join(self._part(t) for t in text.split(self._special))
        return self._part(text)


class WordCache(Encoder):
    """The encoder with the ids of whole words kept, for text of few different words.

    A single space between other characters always begins a token, so a text is the
    sequence of its words, each with the space before it, and equal words have equal ids.
    Full generations follow each other; a word that is met again moves to the young one.
    """

    def __init__(self, ranks_path: str, special: str, special_id: int):
        super().__init__(ranks_path, special, special_id)
        self._of: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        ids = self._old.pop(word, None) or self._plain(word)
        if len(word) < 60:
            if len(self._of) >= _CACHED:
                self._old, self._of = self._of, {}
            self._of[word] = ids
        return ids

    def _part(self, text: str) -> bytes:
        if not text:
            return b""
        if _ODD_SPACE.search(text) or not _PLAIN.fullmatch(text):
            return self._plain(text)
        first, *rest = text.split(" ")
        get, new = self._of.get, self._word
        return self._plain(first) + b"".join([get(w) or new(w) for w in [" " + w for w in rest]])


@lru_cache(maxsize=2)
def encoder(ranks_path: str, special: str, special_id: int) -> Encoder:
    """One encoder per task and file."""
    return Encoder(ranks_path, special, special_id)


class CapacityTree:
    """Segment tree over remaining capacities; a leaf is set if windows have it."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.set = np.zeros(2 * self.size, bool)

    def put(self, capacity: int, there: bool) -> None:
        """Note whether any open window has ``capacity`` left."""
        at = self.size + capacity
        self.set[at] = there
        while at > 1:
            at //= 2
            self.set[at] = self.set[2 * at] or self.set[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        """The least capacity of an open window that is not below ``length``."""
        at = self.size + length
        if self.set[at]:
            return length
        while at > 1:
            if not at & 1 and self.set[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.set[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first rank, pieces, pieces in each
    window, first sequence, first offset there). Sequences are numbered from 0."""
    open_windows: dict[int, list[tuple[int, int]]] = defaultdict(list)  # capacity: runs (first, number)
    tree, plan, made = CapacityTree(window), [], 0

    def opened(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            open_windows[capacity].append((first, n))
            tree.put(capacity, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                each = window // length
                first, n, capacity = made, -(-left // each), window
                made += n
            else:
                first, n = open_windows[capacity].pop()
                if not open_windows[capacity]:
                    tree.put(capacity, False)
                each = capacity // length
            placed = min(left, n * each)
            plan.append((length, rank, placed, each, first, window - capacity))
            full, over = divmod(placed, each)
            opened(capacity - each * length, first, full)
            if over:
                opened(capacity - over * length, first + full, 1)
            opened(capacity, first + full + bool(over), n - full - bool(over))
            rank += placed
            left -= placed
    return plan


def pack(docs: DataFrame, ranks: str, special: str = "<|endoftext|>", special_id: int = 50256, end_id: int = 1, window: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, ``start``, ``length``, ``ids`` (binary, little-endian unsigned
    32-bit), ``doc_tokens``, ``sequence_id`` and ``offset``."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long = T.LongType()
    names = {"start": long, "length": long, "ids": T.BinaryType(), "doc_tokens": long, "task": long, "task_rank": long}
    schema = T.StructType([d.schema["doc_id"], *[T.StructField(k, v) for k, v in names.items()]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(ranks, special, special_id), np.array([end_id], "<u4").tobytes()
        task, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                of, start, length, ids, total, rank = [], [], [], [], [], []
                for i, text in enumerate(batch.column("text").slice(lo, 256).to_pylist()):
                    own = coder.encode(text) + end
                    n = len(own) // 4
                    for at in range(0, n, window):
                        part = own[4 * at : 4 * (at + window)]
                        size = len(part) // 4
                        of.append(i)
                        start.append(at)
                        length.append(size)
                        ids.append(part)
                        total.append(n)
                        rank.append(seen[size])
                        seen[size] += 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, 256).take(pa.array(of, pa.int32())), *[pa.array(x, pa.int64()) for x in (start, length)], pa.array(ids, pa.binary()), pa.array(total, pa.int64()), pa.array([task] * len(of), pa.int64()), pa.array(rank, pa.int64())],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "task", "task_rank"],
                )
        encoder.cache_clear()  # its tables need not stay in the worker
        del coder
        trimmed()

    # Written once: ranks are those of the committed attempt of each task.
    pieces, _ = saved(d.mapInArrow(cut, schema), "pieces")
    per_task, _ = saved(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "counts")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``window`` rows
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    spark = d.sparkSession
    plan = spark.createDataFrame(best_fit_decreasing(counts, window), "length bigint, lo bigint, n bigint, each bigint, first bigint, at bigint")
    plan = plan.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("lo", "n", "each", "first", "at"))).alias("runs"))
    ranked = pieces.join(hint_small(saved(base, "base")[0]), ["length", "task"]).withColumn("rank", F.col("base") + F.col("task_rank"))
    run = F.element_at(F.filter("runs", lambda r: (r["lo"] <= F.col("rank")) & (F.col("rank") < r["lo"] + r["n"])), 1)
    placed = ranked.join(F.broadcast(plan), "length").withColumn("run", run).withColumn("nth", F.col("rank") - F.col("run.lo"))
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids",
        "doc_tokens",
        (F.col("run.first") + F.floor(F.col("nth") / F.col("run.each"))).cast("long").alias("sequence_id"),
        (F.col("run.at") + F.col("nth") % F.col("run.each") * F.col("length")).alias("offset"),
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    """The pieces of ``docs`` with the digest of their ids."""
    import public_tokenizers

    out = pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
