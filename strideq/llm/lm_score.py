"""Language-model scoring by the likelihood of a subword lattice.

A text is a row of words and an end. Every word spans a lattice whose edges are the
pieces of an existing vocabulary (single bytes among them, so nothing is impossible)
and, over the whole word, an edge of its own if training texts hold that word. The
probability of the text is the sum over all ways through its lattice, by the forward
recursion in log space. No piece reaches across words, so the sum over a text is the
product of the sums over its words, and each distinct word is solved once.

Weights: piece weights are the vocabulary's own scores (log probabilities, or merge ranks,
read by Zipf's law). With ``rounds`` over 0 they are then fitted to the distinct training
words by expectation over all segmentations. With ``whole_words`` words of the training
texts are edges too, with their relative frequency; the share of the pieces is then the
share of words met once (Good and Turing), so all outcomes together have probability one.

Counts cover all training texts: every task counts its own words, and the counts are
added up by word. Scoring looks words up in two ways: the ``hot_words`` most frequent
ones of all texts, a fixed number, are sent to every task, be they training words or not;
all others meet the word table by a join on the word. So a word that a third of all rows
hold is never a join key.

Defined results: a null text is an empty one and has one token, the end. Rows with
null or repeated ids are scored each (a null id's fold is that of the empty text).
Without any training text a word has the weight of its pieces. An empty table gives an
empty result. Very long words are solved like others. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideq.llm.common import fold, saved, table, trimmed

_MIX = np.uint64(0x9E3779B97F4A7C15)
_PRIME = np.uint64(0x100000001B3)
_SLOT_BITS = 20


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a sentencepiece file as bytes (a space begins a word) and their initial
    log weights; the 256 single bytes come first."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [bytes([b]) for b in range(256)]
    known, scores = set(pieces), []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        raw = model.id_to_piece(i).replace("▁", " ").encode("utf-8")
        if b" " not in raw[1:] and raw not in known:
            known.add(raw)
            pieces.append(raw)
            scores.append(model.get_score(i))
    s = np.array(scores)
    if len(s) and s.min() < -100:  # ranks of merges
        s = -np.log(np.argsort(np.argsort(-s)) + 2.7)
    least = s.min() - math.log(256) if len(s) else 0.0
    w = np.concatenate([np.full(256, least), s])
    return pieces, w - np.logaddexp.reduce(w)


class Lattice:
    """Forward and backward sums over all segmentations, for many words at once."""

    def __init__(self, pieces: list[bytes], log_p: np.ndarray):
        self.log_p = log_p
        self.longest = max(map(len, pieces))
        with np.errstate(over="ignore"):
            keys = np.array([self._hash(p) for p in pieces], np.uint64)
        self._keys = keys
        self._tables = []
        left, turn = np.arange(len(pieces)), np.uint64(1)
        while len(left):  # keys that share a slot go to the next table
            with np.errstate(over="ignore"):
                mul = _MIX * (turn * np.uint64(2) + np.uint64(1))
                slot = (keys[left] * mul) >> np.uint64(64 - _SLOT_BITS)
            t = np.full(1 << _SLOT_BITS, -1, np.int32)
            t[slot] = left
            self._tables.append((mul, t))
            left = left[t[slot] != left]
            turn += np.uint64(1)

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(_PRIME) + b + 1) & (2**64 - 1)
        return h

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        found = np.full(h.shape, -1, np.int32)
        for mul, t in self._tables:
            at = t[(h * mul) >> np.uint64(64 - _SLOT_BITS)]
            hit = (at >= 0) & (self._keys[at] == h)
            found[hit] = at[hit]
        return found

    def _edges(self, m: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """Pieces by (start, end) for words that are the rows of ``m``."""
        n, out = m.shape[1], {}
        with np.errstate(over="ignore"):
            h = np.zeros(m.shape, np.uint64)
            for size in range(1, min(n, self.longest) + 1):
                h = h[:, : n - size + 1] * _PRIME + m[:, size - 1 :] + np.uint64(1)
                found = self._find(h)
                for start in np.flatnonzero((found >= 0).any(axis=0)):
                    out[int(start), int(start) + size] = found[:, start]
        return out

    def batches(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of equal length as byte matrices of bounded size, with their places."""
        size = np.array([len(w) + 1 for w in words])
        order = np.argsort(size, kind="stable")
        lo = 0
        while lo < len(order):
            n = size[order[lo]]
            hi = lo + int(np.searchsorted(size[order[lo:]], n, side="right"))
            hi = min(hi, lo + max(1, 1_000_000 // (n * min(n, self.longest))))
            at = order[lo:hi]
            yield at, np.frombuffer(b"".join(b" " + words[i] for i in at), np.uint8).reshape(len(at), n).astype(np.uint64)
            lo = hi

    def _forward(self, n: int, rows: int, edges: dict) -> np.ndarray:
        a = np.full((n + 1, rows), -np.inf)
        a[0] = 0.0
        for (i, j), piece in sorted(edges.items(), key=lambda e: e[0][1]):
            a[j] = np.logaddexp(a[j], np.where(piece >= 0, a[i] + self.log_p[piece], -np.inf))
        return a

    def log_prob(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the sum over all segmentations of each word."""
        out = np.zeros(len(words))
        for at, m in self.batches(words):
            out[at] = self._forward(m.shape[1], len(at), self._edges(m))[-1]
        return out

    def expected(self, words: list[bytes]) -> np.ndarray:
        """How often each piece is used, by expectation over all segmentations."""
        total = np.zeros(len(self.log_p))
        for _, m in self.batches(words):
            n, rows, edges = m.shape[1], len(m), self._edges(m)
            a = self._forward(n, rows, edges)
            b = np.full((n + 1, rows), -np.inf)
            b[n] = 0.0
            for (i, j), piece in sorted(edges.items(), key=lambda e: -e[0][0]):
                w = np.where(piece >= 0, b[j] + self.log_p[piece], -np.inf)
                there = piece >= 0
                total += np.bincount(piece[there], np.exp(a[i] + w - a[n])[there], len(total))
                b[i] = np.logaddexp(b[i], w)
        return total


def _tokens(text: bytes | None) -> list[bytes]:
    # ``bytes`` lowers A-Z alone and splits at the six ASCII spaces alone.
    return text.lower().split() if text else []


def _flat(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def count_words(docs: DataFrame) -> DataFrame:
    """word, its count ``c`` in rows with ``train``, and ``rows_``, its count in all
    rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        others: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            for found, is_train in ((counts, True), (others, False)):
                words, n = list(found), list(found.values())
                for lo in range(0, len(words), 50_000):
                    own = pa.array(n[lo : lo + 50_000], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(words[lo : lo + 50_000], pa.binary()), own if is_train else pa.array([0] * len(own), pa.int64()), own], ["word", "c", "rows_"])
            counts.clear()
            others.clear()

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for text, train in zip(_flat(part.column("text")), part.column("train").to_pylist(), strict=True):
                    (counts if train else others).update(_tokens(text))
                if len(counts) + len(others) > 400_000:
                    yield from out()
        yield from out()
        trimmed()

    return docs.select("text", "train").mapInArrow(run, "word binary, c bigint, rows_ bigint").groupBy("word").agg(F.sum("c").alias("c"), F.sum("rows_").alias("rows_"))


def fit_pieces(words: DataFrame, pieces: list[bytes], log_p: np.ndarray, rounds: int, prior: float) -> np.ndarray:
    """Piece weights fitted to the distinct words; what comes to the driver is one number
    per piece."""
    spark = words.sparkSession
    start = np.exp(log_p)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((pieces, log_p))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(*sent.value)
            total = np.zeros(len(sent.value[0]))
            for batch in batches:
                total += lattice.expected(batch.column("word").to_pylist())
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["piece", "n"])

        found = words.select("word").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        counts = prior * start
        for r in found:
            counts[r["piece"]] += r["n"]
        log_p = np.log(counts / counts.sum())
        sent.destroy()
    return log_p


def score(docs: DataFrame, vocabulary_path: str, train: Column, rounds: int = 2, prior: float = 1000.0, whole_words: bool = True, hot_words: int = 300_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``trained`` (the value of ``train``), n_tokens, n_known, train_tokens,
    base_score and score (log10) of every row."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), train.alias("train"))
    long, double = T.LongType(), T.DoubleType()
    fields = {"train": T.BooleanType(), "n_tokens": long, "known": long, "base": double, "score": double, "cold": T.ArrayType(T.BinaryType())}
    schema = T.StructType([T.StructField("row", long), d.schema["doc_id"], *[T.StructField(k, v) for k, v in fields.items()]])
    counts, counts_at = saved(count_words(d), "words")
    ends = d.filter("train").select(F.count(F.lit(1))).first()[0]
    t = counts.agg(F.sum("c"), F.sum(F.when(F.col("c") > 0, 1)), F.sum(F.when(F.col("c") == 1, 1))).first()
    n = (t[0] or 0) + ends
    v = (t[1] or 0) + (ends > 0)
    pieces, log_p = vocabulary(vocabulary_path)
    log_p = fit_pieces(counts.filter("c > 0"), pieces, log_p, rounds, prior)

    share = min(max(t[2] or 0, 1) / n, 0.5) if n and whole_words else 1.0  # of the pieces
    ending = (ends + 1) / (n + 2)
    log10 = math.log(10)
    sent = spark.sparkContext.broadcast((pieces, log_p))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*sent.value)
        for batch in batches:
            c = batch.column("c").to_numpy()
            by_pieces = lattice.log_prob(batch.column("word").to_pylist()) + math.log(share * (1 - ending))
            with np.errstate(divide="ignore"):
                whole = np.log((1 - share) * c / max(n, 1))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), batch.column("rows_"), pa.array((np.logaddexp(by_pieces, whole) if whole_words else by_pieces) / log10)], ["word", "c", "rows_", "lp"])
        trimmed()

    words, _ = saved(counts.mapInArrow(solve, "word binary, c bigint, rows_ bigint, lp double"), "solved")
    hot = words.orderBy(F.desc("rows_"), "word").limit(hot_words).toArrow()
    hot = spark.sparkContext.broadcast((hot.column("word").to_pylist(), hot.column("c").to_numpy(), hot.column("lp").to_numpy()))
    rest = n + v + 1.0
    end = (math.log10((ends + 1) / rest), math.log10(((1 - share) * ends / max(n, 1) if whole_words else 0.0) + share * ending))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, c, lp = hot.value
        place = {w: i for i, w in enumerate(names)}.get
        known_ = np.append(c > 0, False)
        base = np.append(np.log10((c + 1) / rest), 0.0)
        lp = np.append(lp, 0.0)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, cold, size, known, s0, s1 = batch.slice(lo, 256), [], [], [], [], []
                for text in _flat(part.column("text")):
                    words_ = _tokens(text)
                    at = np.array([place(w, -1) for w in words_], np.int64)
                    new = np.flatnonzero(at < 0)
                    cold.append([words_[i] for i in new])
                    size.append(len(words_) + 1)
                    known.append(int(known_[at].sum()) + (ends > 0))
                    s0.append(base[at].sum() + end[0])
                    s1.append(lp[at].sum() + end[1])
                rows = np.arange(row, row + len(size))
                row += len(size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), part.column("doc_id"), part.column("train"), *[pa.array(x, pa.int64()) for x in (size, known)], *[pa.array(x, pa.float64()) for x in (s0, s1)], pa.array(cold, pa.list_(pa.binary()))],
                    ["row", "doc_id", "train", "n_tokens", "known", "base", "score", "cold"],
                )
        trimmed()

    # Written once: row numbers are those of the committed attempt of each task.
    rows, _ = saved(d.mapInArrow(look_up, schema), "rows")
    met = rows.select("row", F.explode("cold").alias("word")).join(words, "word")
    more = met.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, 1).otherwise(0)).alias("k"),
        F.sum(F.log10((F.col("c") + 1) / F.lit(rest))).alias("b"),
        F.sum("lp").alias("s"),
    )
    out = rows.drop("cold").join(more, "row", "left")
    return out.select(
        "doc_id",
        F.col("train").alias("trained"),
        "n_tokens",
        (F.col("known") + F.coalesce("k", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"),
    )


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of those outside the held-out fold."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, public_tokenizers.path("piece_bpe_32k.model"), fold("doc_id", 7) != 2)
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
