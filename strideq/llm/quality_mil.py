"""Quality by attention-based multiple-instance learning, trained in numpy.

A document is a bag of passages, consecutive runs of words. Every passage is encoded:
shares of kinds of characters, word lengths, repetition and shape, through a hidden
layer. Gated attention, learned from labels of whole documents, weighs the passages;
the weighted sum represents the document, and a logistic layer scores it. So one bad
passage in a long text counts as much as training says it should. The score is moved
so that the threshold best on part of the training sample is at ``decision``.

Labels, declared language, source and id of a row are no inputs of its score. The model
is fitted to a bounded sample: at most ``most`` rows of each label, the first by a hash
of the id, each with its whole text.

Defined results: null and empty texts are one empty passage. Rows with null or repeated
ids are scored each. Without training rows of both labels every score is 1. A text over
a megabyte is read in parts cut between passages, which are the same as if it were read
whole. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideq.llm.common import fold, table
from strideq.llm.text_arrays import Adam, as_bytes, best_threshold, finished, labelled_sample, parts, raw_words, words

PASSAGE = 48
HIDDEN = 16
GATE = 8
_WORD = raw_words()


def _kinds() -> np.ndarray:
    """A byte's kind: 0 white space, 1 lower, 2 upper, 3 digit, 4 beyond ASCII, 5 end of
    sentence, 6 comma and quotes, 7 exclamation, 8 brackets, 9 bar, 10 other symbols,
    11 line end."""
    k = np.full(256, 10)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            k[b] = 4
        elif c == "\n":
            k[b] = 11
        elif c.isspace():
            k[b] = 0
        elif c.islower():
            k[b] = 1
        elif c.isupper():
            k[b] = 2
        elif c.isdigit():
            k[b] = 3
        elif c in ".?":
            k[b] = 5
        elif c in ",;:'\"-":
            k[b] = 6
        elif c == "!":
            k[b] = 7
        elif c in "()[]{}":
            k[b] = 8
        elif c == "|":
            k[b] = 9
    return k


_KIND = _kinds()
N_KINDS = 12
INPUTS = N_KINDS + 5


def passages(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of every passage, and the text each belongs to (in order)."""
    found, of_text = [], []
    before = np.zeros(len(texts), np.int64)  # passages of a text in earlier pieces
    for buffer, of, begin in parts(texts, PASSAGE, _WORD):
        start, end, h = words(buffer, _WORD)
        first = np.searchsorted(start, begin)  # of each piece's words
        sizes = np.diff(np.append(first, len(start)))
        n_passages = np.maximum(-(-sizes // PASSAGE), 1)
        piece = np.repeat(np.arange(len(of)), n_passages)
        nth = np.arange(len(piece)) - np.repeat(np.cumsum(n_passages) - n_passages, n_passages)
        word = first[piece] + nth * PASSAGE
        in_text = nth + before[of[piece]]
        np.add.at(before, of, n_passages)
        # A passage begins with its first word; the first of a piece with the piece.
        at = np.where(nth == 0, begin[piece], start[np.minimum(word, max(len(start) - 1, 0))] if len(start) else 0)
        kind = _KIND[buffer]
        length = np.diff(np.append(at, len(buffer)))
        bounds = np.minimum(at, max(len(buffer) - 1, 0))
        counts = np.stack([np.where(length > 0, np.add.reduceat((kind == k).astype(np.int64), bounds), 0) for k in range(N_KINDS)], axis=1) if len(buffer) else np.zeros((len(piece), N_KINDS))
        n_words = np.minimum(sizes[piece] - nth * PASSAGE, PASSAGE).clip(0)
        x = np.zeros((len(piece), INPUTS))
        x[:, :N_KINDS] = np.sqrt(counts / np.maximum(length, 1)[:, None])
        if len(start):
            # Repetition: distinct words, and words equal to the one before.
            p_of_word = np.repeat(np.arange(len(piece)), n_words)
            order = np.lexsort((h, p_of_word))
            new = np.ones(len(h), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (p_of_word[order][1:] != p_of_word[order][:-1])
            distinct = np.bincount(p_of_word[order], new, len(piece))
            again = np.zeros(len(h))
            again[1:] = h[1:] == h[:-1]
            width = np.bincount(p_of_word, (end - start).astype(float), len(piece))
            x[:, N_KINDS] = distinct / np.maximum(n_words, 1)
            x[:, N_KINDS + 1] = np.bincount(p_of_word, again, len(piece)) / np.maximum(n_words, 1)
            x[:, N_KINDS + 2] = np.minimum(width / np.maximum(n_words, 1) / 10, 3)
        x[:, N_KINDS + 3] = n_words / PASSAGE
        x[:, N_KINDS + 4] = np.log1p(in_text) / 5
        found.append(x)
        of_text.append(of[piece])
    return np.concatenate(found), np.concatenate(of_text)


class Mil:
    """The network; ``p`` holds its weights."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        s = lambda *n: r.standard_normal(n) / np.sqrt(n[0])
        self.p = {"w": s(INPUTS, HIDDEN), "b": np.zeros(HIDDEN), "v": s(HIDDEN, GATE), "g": s(HIDDEN, GATE), "a": s(GATE), "u": s(HIDDEN), "c": np.zeros(1)}
        self.mean, self.scale, self.shift = np.zeros(INPUTS), np.ones(INPUTS), 0.0

    def _forward(self, x: np.ndarray, first: np.ndarray):
        p = self.p
        h = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["g"])))
        e = (t * s) @ p["a"]
        sizes = np.diff(np.append(first, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), sizes))
        a = e / np.repeat(np.add.reduceat(e, first), sizes)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return h, t, s, a, z, z @ p["u"] + p["c"][0], sizes

    def fit(self, bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int, rate: float, seed: int = 3) -> None:
        """Minibatch training on bags of passages."""
        r, p = np.random.default_rng(seed), self.p
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(axis=0), every.std(axis=0) + 1e-3
        bags = [(b - self.mean) / self.scale for b in bags]
        adam = Adam(p, rate)
        for _ in range(epochs):
            order = r.permutation(len(bags))
            for lo in range(0, len(order), 64):
                own = order[lo : lo + 64]
                x = np.concatenate([bags[i] for i in own])
                first = np.cumsum([0] + [len(bags[i]) for i in own[:-1]])
                h, t, s, a, z, out, sizes = self._forward(x, first)
                g = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[own]) * weight[own] / len(own)
                dz = np.repeat(g[:, None] * p["u"], sizes, axis=0)
                da = (dz * h).sum(axis=1)
                de = a * (da - np.repeat(np.add.reduceat(a * da, first), sizes))
                dts = de[:, None] * p["a"]
                dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
                dh = (a[:, None] * dz + dt @ p["v"].T + ds @ p["g"].T) * (1 - h * h)
                grads = {"u": z.T @ g, "c": np.array([g.sum()]), "a": (t * s).T @ de, "v": h.T @ dt, "g": h.T @ ds, "w": x.T @ dh, "b": dh.sum(axis=0)}
                adam.step({k: v + 1e-4 * p[k] for k, v in grads.items()})

    def logits(self, texts: list[bytes | None]) -> np.ndarray:
        """Uncalibrated log odds of each text."""
        if not texts:
            return np.zeros(0)
        x, of = passages(texts)
        first = np.searchsorted(of, np.arange(len(texts)))
        return self._forward((x - self.mean) / self.scale, first)[5]

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """Calibrated scores."""
        return 1 / (1 + np.exp(-np.clip(self.logits(texts) + self.shift, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, allowed: Column, decision: float, most: dict[int, int], epochs: int, rate: float) -> Mil | None:
    """The network fitted to a bounded sample of labelled rows."""
    sample = labelled_sample(docs, labels, "quality", most, allowed)
    y = np.array([s[1] for s in sample], float)
    if not len(y) or not 0 < y.sum() < len(y):
        return None
    weight = np.array([s[2] / (y == s[1]).sum() for s in sample])
    held = np.arange(len(sample)) % 4 == 0
    if not 0 < y[~held].sum() < (~held).sum():
        held[:] = False
    net, on = Mil(), np.flatnonzero(~held)
    share = y[on].mean()
    balance = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    net.fit([passages([sample[i][0]])[0] for i in on], y[on], balance[on], epochs, rate)
    at = np.flatnonzero(held) if held.any() and 0 < y[held].sum() < held.sum() else on
    cut = best_threshold(net.logits([sample[i][0] for i in at]), y[at], weight[at])
    net.shift = float(np.log(decision / (1 - decision)) - cut)
    return net


def score(docs: DataFrame, labels: DataFrame, allowed: Column, decision: float = 0.3, most: dict[int, int] | None = None, epochs: int = 30, rate: float = 0.005, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, and the ``score`` of every row."""
    spark = docs.sparkSession
    net = train(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, allowed, decision, most or {0: 1500, 1: 1500}, epochs, rate)
    if net is None:
        return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.lit(1.0).alias("score"))
    sent = spark.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.concatenate([np.zeros(0), *[sent.value.scores(as_bytes(batch.slice(lo, 512))) for lo in range(0, len(batch), 512)]]))
        finished()

    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), scored(F.col(f"`{text_col}`")).alias("score"))


def op8_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of labels outside the held-out fold."""
    held = fold("doc_id", 5) == 0
    out = score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), ~held)
    out = out.select("row.doc_id", "score")
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"))
