"""Toxicity by a convolutional text classifier, trained in numpy.

Words are hashed twice, and their first five bytes once, and each hash has a trained
embedding; a word is the three side by side. So a rare word that shares one slot with a
telling word doesn't pass for it, and words of one stem are akin. Filters of several
widths run over the words. A text is pooled in eight regions: each filter's largest
value in a region is taken, and the three largest of them are kept in order, so that
one chance word weighs less than several. A logistic layer weighs these values.
Embeddings start from how much more often the training texts with label 1 hold the slot.

The decision threshold is calibrated by language: a guess from function words in the text
itself picks the language, and the language's threshold, shrunk towards the common one by
how few labelled rows it has, is moved to ``decision``. Thresholds are found by
cross-fitting: each part of the training rows is judged by a network fitted to the rest.
Labels, declared language, source and id of a row are no inputs of its score.

Counts, networks and thresholds are of all labelled rows, each with its whole text. An id
with both labels has the larger; of several texts with one id the least is taken. Rows are
dealt to shards of bounded size by a hash of the id. Up to two shards are one: their rows
go to files in the driver's temporary folder, and it trains alone. More are trained in
tasks: in every epoch each goes over all its rows from the same weights, and the weights
are then averaged. Then the driver holds the networks and some bytes of each row.

Defined results: null and empty texts get the score of a text without words. Rows with
null or repeated ids are scored each. Without training rows of both labels every score
is 0. A text over a megabyte is read in parts and pooled over its whole length, as any
other. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from copy import deepcopy
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideq.llm.common import fold, hint_small, remove, saved, small_batches, table, trimmed
from strideq.llm.text_arrays import PART, Adam, as_bytes, best_threshold, finished, lower_words, parts, spans, words

SLOTS = 1 << 17
DIM = 4
WIDTHS = (1, 2, 3)
FILTERS = 8
STEM = 5
TABLES = 3
REGIONS = 8
KEPT = 3
#: About the labelled rows, and bytes of their texts, in one shard.
SHARD_ROWS = 4096
SHARD_BYTES = 32 << 20
#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with this on by are".split(),
    "fr": "le les des et est un une du pour que dans qui pas sur avec".split(),
    "de": "der die und das ist den von mit im für auf nicht ein eine zu".split(),
    "es": "el los las y en por con para una del se lo como no su".split(),
}
_WORD = lower_words()
_EMPTY = np.full((TABLES, 1), SLOTS, np.int32)
_GAP = np.full((TABLES, max(WIDTHS) - 1), SLOTS, np.int32)


def _slots(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, hash and the three slots of every word."""
    start, end, h = words(buffer, _WORD)
    stem = spans(buffer, _WORD, start, np.minimum(end, start + STEM))
    mask = np.uint64(SLOTS - 1)
    return start, h, np.stack([h & mask, (h >> np.uint64(32)) & mask, stem & mask]).astype(np.int64)


def _language_of_hash() -> tuple[np.ndarray, np.ndarray]:
    found = {}
    for i, ws in enumerate(FUNCTION_WORDS.values()):
        for w in ws:
            h = int(words(np.frombuffer(w.encode(), np.uint8), _WORD)[2][0])
            found[h] = i
    keys = np.array(sorted(found), np.uint64)
    return keys, np.array([found[int(k)] for k in keys])


def _read(texts: list[bytes | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """The slots of each text, one empty place for a text without words, and its guessed
    language."""
    seen = np.zeros((len(texts), len(FUNCTION_WORDS)))
    keys, language = _language_of_hash()
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for buffer, of, begin in parts(texts):
        start, h, slots = _slots(buffer)
        first = np.searchsorted(start, begin)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == h)
        np.add.at(seen, (of[np.searchsorted(first, hit, side="right") - 1], language[at[hit]]), 1)
        slots = slots.astype(np.int32)
        for i, a, b in zip(of, first, np.append(first[1:], len(start)), strict=True):
            out[i].append(slots[:, a:b])
    whole = [x[0] if len(x) == 1 else np.hstack(x) for x in out]
    guess = np.where(seen.max(axis=1) > 0, seen.argmax(axis=1), len(FUNCTION_WORDS)) if texts else np.zeros(0, int)
    return [x if x.shape[1] else _EMPTY for x in whole], guess


def _once(slots: np.ndarray) -> np.ndarray:
    """Each slot once."""
    s = np.sort(slots)
    return s[np.append(True, s[1:] != s[:-1])]


class Stored:
    """Byte strings of any number in a file, read by place; ``of`` picks and orders them."""

    def __init__(self, path: Path):
        self._path, self._out, self._end = path, path.open("wb"), [0]
        self.of = np.zeros(0, np.int64)

    def add(self, value: bytes) -> None:
        self._out.write(value)
        self._end.append(self._end[-1] + len(value))

    def done(self, order: np.ndarray) -> Stored:
        """Ready to be read, in this order."""
        self._out.close()
        self._end, self.of = np.array(self._end), order
        self._in = np.memmap(self._path, np.uint8, "r") if self._end[-1] else np.zeros(0, np.uint8)
        return self

    def part(self, on: np.ndarray) -> Stored:
        """Those numbered ``on``."""
        out = object.__new__(type(self))
        out.__dict__ = self.__dict__ | {"of": self.of[on]}
        return out

    def __len__(self) -> int:
        return len(self.of)

    def raw(self, i: int) -> bytes:
        at = self.of[i]
        return self._in[self._end[at] : self._end[at + 1]].tobytes()

    def __getitem__(self, i: int) -> np.ndarray:
        """The slots of a text."""
        return np.frombuffer(self.raw(i), np.int32).reshape(TABLES, -1)


class Cnn:
    """The network; ``p`` holds its weights."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        d = TABLES * DIM
        self.e = [(0.01 * r.standard_normal((SLOTS + 1, DIM))).astype(np.float32) for _ in range(TABLES)]
        u = 0.1 * r.standard_normal((KEPT, len(WIDTHS), FILTERS))
        u[:, :, :2] += 0.5
        self.p = {"u": u.ravel(), "c": np.zeros(1)}
        for w in WIDTHS:
            f = 0.3 * r.standard_normal((w * d, FILTERS))
            f[[0, DIM], 0] = f[2 * DIM, 1] = 1.0  # two filters begin with the words' and the stems' prior
            self.p[f"w{w}"], self.p[f"b{w}"] = f, np.zeros(FILTERS)
        self.shift = np.zeros(len(FUNCTION_WORDS) + 1)

    def inputs(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Slots, with empty places after each text, so that no filter reaches into the next
        one; first places; sizes; embeddings."""
        idx = np.concatenate([x for t in texts for x in (t, _GAP)], axis=1)
        room = np.array([t.shape[1] for t in texts]) + _GAP.shape[1]
        x = np.empty((idx.shape[1], TABLES * DIM), np.float32)
        for k in range(TABLES):
            x[:, k * DIM : (k + 1) * DIM] = self.e[k].take(idx[k], axis=0)
        return idx, np.cumsum(room) - room, room - _GAP.shape[1], x

    def convolved(self, x: np.ndarray) -> list[np.ndarray]:
        """Per width the filters, one in a row, at every place but the last empty ones."""
        n, d = len(x) - (max(WIDTHS) - 1), x.shape[1]
        f = np.hstack([self.p[f"w{w}"][k * d : (k + 1) * d] for w in WIDTHS for k in range(w)]).astype(np.float32)
        y, out, at = f.T @ x.T, [], 0
        for w in WIDTHS:
            a = y[at : at + FILTERS, :n] + self.p[f"b{w}"].astype(np.float32)[:, None]
            for k in range(1, w):
                a += y[at + k * FILTERS : at + (k + 1) * FILTERS, k : n + k]
            out.append(a)
            at += w * FILTERS
        return out

    def pooled(self, x: np.ndarray, first: np.ndarray, sizes: np.ndarray, train: bool = False):
        """Per text the KEPT largest of its regions' maxima, by place, width and filter; for
        training also the places in ``x`` that they are from."""
        edge = first[:, None] + sizes[:, None] * np.arange(REGIONS + 1)[None, :] // REGIONS
        full = (edge[:, 1:] > edge[:, :-1]).ravel()
        lo, hi = edge[:, :-1].ravel()[full], edge[:, 1:].ravel()[full]
        regions = np.stack([lo, hi], axis=1).ravel()  # every other segment is between regions
        spread = np.diff(np.append(lo, x.shape[0] - (max(WIDTHS) - 1)))  # a region, and what is empty after it
        z, place = [], []
        for a in self.convolved(x):
            top = np.maximum.reduceat(np.hstack([a, a[:, -1:]]), regions, axis=1)[:, ::2]
            most = np.zeros((len(full), FILTERS))
            most[full] = np.maximum(top, 0).T
            most = most.reshape(len(first), REGIONS, FILTERS)
            order = np.argsort(-most, axis=1, kind="stable")[:, :KEPT]
            z.append(np.take_along_axis(most, order, axis=1))
            if train:
                # The first place of each maximum: later ones, and places after the region,
                # are written before it.
                row, at = np.divmod(np.flatnonzero(a[:, lo[0] :] == np.repeat(top, spread, axis=1))[::-1], a.shape[1] - lo[0])
                at += lo[0]
                own, found = np.searchsorted(lo, at, side="right") - 1, np.zeros((len(lo), FILTERS), np.int64)
                found[own, row] = at
                where = np.zeros((len(full), FILTERS), np.int64)
                where[full] = found
                place.append(np.take_along_axis(where.reshape(len(first), REGIONS, FILTERS), order, axis=1))
        return np.stack(z, axis=2).reshape(len(first), -1), place

    def pooled_long(self, slots: np.ndarray, step: int = 1 << 15) -> np.ndarray:
        """The same for one text of any length, some words at a time."""
        n, gap = slots.shape[1], max(WIDTHS) - 1
        edge = n * np.arange(REGIONS + 1) // REGIONS
        most = np.zeros((len(WIDTHS), REGIONS, FILTERS))
        for k in range(REGIONS):
            for lo in range(edge[k], edge[k + 1], step):
                hi = min(lo + step, edge[k + 1])
                idx = np.full((TABLES, hi - lo + gap), SLOTS)
                reach = slots[:, lo : hi + gap]
                idx[:, : reach.shape[1]] = reach
                x = np.hstack([self.e[t][idx[t]] for t in range(TABLES)])
                for i, a in enumerate(self.convolved(x)):
                    most[i, k] = np.maximum(most[i, k], a.max(axis=1))
        return np.sort(most, axis=1)[:, ::-1][:, :KEPT].transpose(1, 0, 2).ravel()

    def begin(self, seen: list[np.ndarray], n: np.ndarray, rate: float) -> None:
        """Embeddings from how many of the ``n`` texts of each label hold each slot."""
        n = np.maximum(n, 1)
        for k in range(TABLES):
            rate_of = (seen[k] + 0.5) / (n + 1)
            support = seen[k].sum(axis=1) / (seen[k].sum(axis=1) + 5)
            self.e[k][:, 0] += support * np.log(rate_of[:, 1] / rate_of[:, 0])
            self.e[k][SLOTS] = 0
        self.square = [np.full(SLOTS + 1, 1e-4, np.float32) for _ in range(TABLES)]
        self.adam = Adam(self.p, rate)

    def fit(self, docs: Stored, y: np.ndarray, weight: np.ndarray, epochs: int, rate: float, seed: int = 11) -> None:
        """Minibatch training; ``docs`` gives slot arrays by number."""
        r = np.random.default_rng(seed)
        seen = [np.zeros((SLOTS + 1, 2)) for _ in range(TABLES)]
        for i, label in enumerate(y):
            s = docs[i]
            for k in range(TABLES):
                seen[k][_once(s[k]), int(label)] += 1
        self.begin(seen, np.array([(y == 0).sum(), (y == 1).sum()]), rate)
        for _ in range(epochs):
            self.epoch(docs, y, weight, r.permutation(len(docs)))

    def epoch(self, docs: Stored | list[np.ndarray], y: np.ndarray, weight: np.ndarray, order: np.ndarray) -> None:
        """One pass over ``docs`` in minibatches."""
        d = TABLES * DIM
        for lo in range(0, len(order), 64):
            own = order[lo : lo + 64]
            idx, first, sizes, x = self.inputs([docs[i] for i in own])
            z, place = self.pooled(x, first, sizes, train=True)
            out = 1 / (1 + np.exp(-np.clip(z @ self.p["u"] + self.p["c"], -30, 30)))
            g = (out - y[own]) * weight[own] / len(own)
            grads = {"u": z.T @ g + 1e-4 * self.p["u"], "c": np.array([g.sum()])}
            dz = (g[:, None] * self.p["u"][None, :] * (z > 0)).reshape(len(own), KEPT, len(WIDTHS), FILTERS)
            places, by_place = [], []
            for i, w in enumerate(WIDTHS):
                dw, own_dz, top = np.zeros_like(self.p[f"w{w}"]), dz[:, :, i], place[i]
                on = np.nonzero(own_dz)
                value, at = own_dz[on], top[on]
                for k in range(w):
                    rows = slice(k * d, (k + 1) * d)
                    dw[rows] = np.einsum("ikfd,ikf->df", x[top + k], own_dz)
                    places.append(at + k)
                    by_place.append(value[:, None] * self.p[f"w{w}"][rows].T[on[2]])
                grads[f"w{w}"], grads[f"b{w}"] = dw + 1e-4 * self.p[f"w{w}"], own_dz.sum(axis=(0, 1))
            touched, of = np.unique(np.concatenate(places), return_inverse=True)
            by_place = np.concatenate(by_place)
            dx = np.stack([np.bincount(of, by_place[:, c], len(touched)) for c in range(d)], axis=1)
            for k in range(TABLES):
                at, gk = idx[k][touched].astype(np.int64), dx[:, k * DIM : (k + 1) * DIM]
                np.add.at(self.square[k], at, (gk * gk).sum(axis=1).astype(np.float32))
                change = (-0.1 * self.adam.rate * gk / np.sqrt(self.square[k][at])[:, None]).astype(np.float32)
                np.add.at(self.e[k].reshape(-1), (at[:, None] * DIM + np.arange(DIM)).ravel(), change.ravel())
                self.e[k][SLOTS] = 0
            self.adam.step(grads)

    def values(self, texts: list[np.ndarray]) -> np.ndarray:
        """Uncalibrated log odds of texts given by their slots."""
        z = np.zeros((len(texts), KEPT * len(WIDTHS) * FILTERS))
        short = [i for i, t in enumerate(texts) if t.shape[1] <= PART // 8]
        cut = np.cumsum([texts[i].shape[1] for i in short]) // (PART // 8)
        for own in np.split(np.array(short, np.int64), 1 + np.flatnonzero(np.diff(cut))):
            if len(own):
                _, first, sizes, x = self.inputs([texts[i] for i in own])
                z[own] = self.pooled(x, first, sizes)[0]
        for i in sorted(set(range(len(texts))) - set(short)):
            z[i] = self.pooled_long(texts[i])
        return z @ self.p["u"] + self.p["c"][0]

    def logits(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Uncalibrated log odds and the guessed language of each text."""
        slots, guess = _read(texts)
        return self.values(slots), guess

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """Calibrated scores."""
        logit, guess = self.logits(texts)
        return 1 / (1 + np.exp(-np.clip(logit + self.shift[guess], -30, 30)))

    def calibrate(self, logit: np.ndarray, guess: np.ndarray, y: np.ndarray, weight: np.ndarray, decision: float, prior: float = 10.0) -> None:
        """Move every language's best threshold to ``decision``. A language's own threshold
        counts by its rows of the rarer label, the common one by ``prior`` such rows."""
        goal = np.log(decision / (1 - decision))
        common = best_threshold(logit, y, weight)
        common = common if common is not None else 0.0
        self.shift[:] = goal - common
        for i in range(len(FUNCTION_WORDS)):
            own = guess == i
            cut = best_threshold(logit[own], y[own], weight[own])
            if cut is not None:
                n = min(y[own].sum(), (1 - y[own]).sum())
                self.shift[i] = goal - (n * cut + prior * common) / (n + prior)


def labelled(docs: DataFrame, labels: DataFrame, allowed: Column) -> tuple[DataFrame, str]:
    """doc_id, y and text of every labelled row, once per id; written, and the path."""
    own = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).dropna().filter(allowed)
    own, path = saved(own.groupBy("doc_id").agg(F.max("y").alias("y")).filter(F.col("y").isin([0, 1])), "labels", keep=False)
    rows = docs.select("doc_id", "text").join(hint_small(own), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    out = saved(rows, "labelled", keep=False)
    remove(docs.sparkSession, path)
    return out


def train(docs: DataFrame, labels: DataFrame, allowed: Column, decision: float, epochs: int, rate: float, folds: int = 3) -> Cnn | None:
    """The network fitted to all labelled rows."""
    with _freed(docs.sparkSession):
        return _train(docs, labels, allowed, decision, epochs, rate, folds)


@contextmanager
def _freed(spark: SparkSession) -> Iterator[None]:
    """Meanwhile a query's shuffle files go when it ends: every epoch is one."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _train(docs: DataFrame, labels: DataFrame, allowed: Column, decision: float, epochs: int, rate: float, folds: int) -> Cnn | None:
    rows, path = labelled(docs, labels, allowed)
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(-(-n // SHARD_ROWS), -(-size // SHARD_BYTES))
    if shards > 2:
        try:
            return _trained_in_tasks(rows, shards, decision, epochs, rate, folds)
        finally:
            remove(docs.sparkSession, path)
    with tempfile.TemporaryDirectory(prefix="strideq-") as folder:
        texts, slots, ids, y = Stored(Path(folder, "texts")), Stored(Path(folder, "slots")), [], []
        for r in rows.toLocalIterator():
            text = (r["text"] or "").encode("utf-8", "surrogatepass")
            slots.add(_read([text])[0][0].tobytes())
            texts.add(text)
            ids.append(r["doc_id"])
            y.append(r["y"])
        remove(docs.sparkSession, path)
        order = np.array(sorted(range(len(ids)), key=ids.__getitem__), np.int64)
        y = np.array(y, float)[order]
        return _trained(texts.done(order), slots.done(order), y, decision, epochs, rate, folds)


def _folds(y: np.ndarray, folds: int) -> np.ndarray:
    """The fold of each row: labels in equal shares."""
    of = np.zeros(len(y), int)
    for label in (0, 1):
        own = np.flatnonzero(y == label)
        of[own] = np.arange(len(own)) % folds
    return of


def _balance(y: np.ndarray, share: float) -> np.ndarray:
    """Weights by which both labels count the same, of rows of which ``share`` have label 1."""
    return np.where(y == 1, 0.5 / share, 0.5 / (1 - share))


def _trained(texts: Stored, slots: Stored, y: np.ndarray, decision: float, epochs: int, rate: float, folds: int) -> Cnn | None:
    if not len(y) or not 0 < y.sum() < len(y):
        return None

    def fitted(on: np.ndarray) -> Cnn:
        net = Cnn()
        net.fit(slots.part(on), y[on], _balance(y[on], y[on].mean()), epochs, rate)
        return net

    # Every row's log odds by a network that hasn't seen it: thresholds are calibrated on
    # all rows, so rare languages have what rows there are.
    net, every = fitted(np.arange(len(y))), np.arange(len(y))
    logit, guess, of = np.zeros(len(y)), np.zeros(len(y), int), _folds(y, folds)
    for k in range(folds):
        rest, held = every[of != k], every[of == k]
        if not len(held):
            continue
        other = fitted(rest) if 0 < y[rest].sum() < len(rest) else net
        for lo in range(0, len(held), 256):
            at = held[lo : lo + 256]
            logit[at], guess[at] = other.logits([texts.raw(i) for i in at])
    net.calibrate(logit, guess, y, np.ones(len(y)), decision)
    return net


class Shard:
    """The labelled rows of one shard: slots of each text, label, fold and guessed language."""

    SCHEMA = "shard int, slots binary, sizes binary, y binary, fold binary, guess binary"

    def __init__(self, row: dict):
        self.number, sizes = row["shard"], np.frombuffer(row["sizes"], np.int64)
        flat, end = np.frombuffer(row["slots"], np.int32), TABLES * np.cumsum(sizes)
        self.docs = [flat[b - TABLES * n : b].reshape(TABLES, -1) for b, n in zip(end, sizes, strict=True)]
        self.y, self.fold, self.guess = (np.frombuffer(row[k], np.int8).astype(int) for k in ("y", "fold", "guess"))

    @staticmethod
    def written(shard: int, texts: list[np.ndarray], y: list[int], guess: list[int], folds: int) -> pa.RecordBatch:
        labels = np.array(y)
        values = [np.array([t.shape[1] for t in texts], np.int64), *[np.asarray(v).astype(np.int8) for v in (labels, _folds(labels, folds), guess)]]
        row = [b"".join(t.tobytes() for t in texts), *[v.tobytes() for v in values]]
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *[pa.array([v], pa.binary()) for v in row]], ["shard", "slots", "sizes", "y", "fold", "guess"])

    @staticmethod
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield Shard(batch.slice(i, 1).to_pylist()[0])

    def rest(self, net: int) -> np.ndarray:
        """The rows a network learns from: 0 from all, k + 1 from all but fold k."""
        return np.flatnonzero(self.fold != net - 1)


def _sharded(rows: DataFrame, shards: int, folds: int) -> tuple[DataFrame, str]:
    """Labelled rows dealt to shards by a hash of the id, one row for each; written, and
    the path. A shard's rows are in order of the id, so it is the same however they came."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, texts, y, guess = None, [], [], []
        for batch in batches:
            number = batch.column("shard").to_numpy()
            for part in np.split(np.arange(len(number)), 1 + np.flatnonzero(np.diff(number))):
                if not len(part):
                    continue
                if texts and number[part[0]] != last:
                    yield Shard.written(last, texts, y, guess, folds)
                    texts, y, guess = [], [], []
                last, own = number[part[0]], batch.slice(part[0], len(part))
                for lo in range(0, len(part), 256):
                    read = _read(as_bytes(own.column("text").slice(lo, 256)))
                    texts += read[0]
                    guess += read[1].tolist()
                y += own.column("y").to_pylist()
        if texts:
            yield Shard.written(last, texts, y, guess, folds)
        finished()

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).repartitionById(shards, "shard")
    return saved(dealt.sortWithinPartitions("shard", "doc_id").select("shard", "y", "text").mapInArrow(packed, Shard.SCHEMA), "shards", keep=False)


def _gathered(shards: DataFrame, of: Callable[[Shard], Iterator[tuple[int, np.ndarray, np.ndarray]]], width: int, mean: bool) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sums of sparse tables over shards, or means over those that have a place: ``of`` gives,
    for a shard, table, places and as many rows of ``width`` numbers. At most SLOTS + 1 places
    a table come to the driver."""
    schema, kind = "key int, place binary, value binary", np.float32 if mean else np.float64

    def row(key: int, place: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        binary = [pa.array([v.tobytes()], pa.binary()) for v in (place.astype(np.int32), value.astype(kind))]
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), *binary], ["key", "place", "value"])

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in Shard.read(batches):
            for x in of(shard):
                yield row(*x)
        finished()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["key"] not in sums:
                    sums[r["key"]] = np.zeros((SLOTS + 1, width)), np.zeros(SLOTS + 1, np.int32)
                place = np.frombuffer(r["place"], np.int32)
                own, n = sums[r["key"]]
                own[place] += np.frombuffer(r["value"], kind).reshape(-1, width)
                n[place] += 1
        for key, (own, n) in sums.items():
            place = np.flatnonzero(n)
            yield row(key, place, own[place] / n[place, None] if mean else own[place])
        sums.clear()
        trimmed()

    with small_batches(shards.sparkSession):
        found = shards.mapInArrow(given, schema).repartition("key").mapInArrow(added, schema).collect()
    return {r["key"]: (np.frombuffer(r["place"], np.int32), np.frombuffer(r["value"], kind).reshape(-1, width)) for r in found}


def _trained_in_tasks(rows: DataFrame, shards: int, decision: float, epochs: int, rate: float, folds: int, seed: int = 11) -> Cnn | None:
    """The network, fitted to shards of the rows side by side: every epoch each shard goes
    on from the same weights over all its rows, and then the shards' weights are averaged,
    an embedding over the shards that changed it."""
    spark = rows.sparkSession
    table, path = _sharded(rows, shards, folds)
    try:

        def counts(shard: Shard) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            part = shard.fold * 2 + shard.y
            yield -1, np.arange(2 * folds), np.bincount(part, minlength=2 * folds)[:, None]
            for i in range(2 * folds):
                own = [shard.docs[j] for j in np.flatnonzero(part == i)]
                for k in range(TABLES if own else 0):
                    place, n = np.unique(np.concatenate([_once(s[k]) for s in own]), return_counts=True)
                    yield i * TABLES + k, place, n[:, None]

        found = _gathered(table, counts, 1, mean=False)
        n = np.zeros((folds, 2))
        n.reshape(-1)[found[-1][0]] = found[-1][1][:, 0]
        if not n.sum(axis=0).all():
            return None
        learnt = {net: n.sum(axis=0) - (n[net - 1] if net else 0) for net in range(folds + 1)}
        learnt = {net: own for net, own in learnt.items() if own.all()}  # the others' folds are judged by 0
        nets: dict[int, Cnn] = {}
        for net, own in learnt.items():
            seen = [np.zeros((SLOTS + 1, 2)) for _ in range(TABLES)]
            for key, (place, value) in found.items():
                if key >= 0 and key // TABLES // 2 != net - 1:
                    seen[key % TABLES][place, key // TABLES % 2] += value[:, 0]
            nets[net] = Cnn()
            nets[net].begin(seen, own, rate)
        for epoch in range(epochs):
            sent = spark.sparkContext.broadcast(nets)
            means = _gathered(table, _pass_over(sent, learnt, [seed, epoch]), DIM + 1, mean=True)
            sent.destroy()
            for net, own in nets.items():
                for k in range(TABLES):
                    place, value = means[net * TABLES + k]
                    own.e[k][place] += value[:, :DIM]
                    own.square[k][place] += value[:, DIM]
                _put_dense(own, means[-1 - net][1].astype(float))
            del means
        sent = spark.sparkContext.broadcast(nets)

        def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard in Shard.read(batches):
                logit = np.zeros(len(shard.y))
                for k in range(folds):
                    held = np.flatnonzero(shard.fold == k)
                    logit[held] = sent.value.get(k + 1, sent.value[0]).values([shard.docs[i] for i in held])
                values = [v.tobytes() for v in (logit, shard.guess.astype(np.int8), shard.y.astype(np.int8))]
                yield pa.RecordBatch.from_arrays([pa.array([shard.number], pa.int32()), *[pa.array([v], pa.binary()) for v in values]], ["shard", "logit", "guess", "y"])
            finished()

        with small_batches(spark):
            out = table.mapInArrow(judged, "shard int, logit binary, guess binary, y binary").collect()
        sent.destroy()
    finally:
        remove(spark, path)
    out.sort(key=lambda r: r["shard"])
    logit = np.concatenate([np.frombuffer(r["logit"]) for r in out])
    guess, y = (np.concatenate([np.frombuffer(r[k], np.int8) for r in out]).astype(int) for k in ("guess", "y"))
    net = nets[0]
    net.calibrate(logit, guess, y.astype(float), np.ones(len(y)), decision)
    del net.square, net.adam  # only training needs them
    return net


def _dense(net: Cnn) -> np.ndarray:
    """The weights that are no embeddings, and Adam's means of them; last its steps."""
    own = [np.concatenate([v[k].ravel() for k in sorted(net.p)]) for v in (net.p, net.adam.m, net.adam.v)]
    return np.vstack([np.stack(own, axis=1), np.full((1, 3), net.adam.t)])


def _put_dense(net: Cnn, values: np.ndarray) -> None:
    for j, v in enumerate((net.p, net.adam.m, net.adam.v)):
        at = 0
        for k in sorted(net.p):
            v[k][...] = values[at : at + v[k].size, j].reshape(v[k].shape)
            at += v[k].size
    net.adam.t = float(values[-1, 0])


def _pass_over(sent: Broadcast, learnt: dict[int, np.ndarray], seed: list[int]) -> Callable[[Shard], Iterator[tuple[int, np.ndarray, np.ndarray]]]:
    """One epoch of each network over a shard: changes of embeddings and of their squares,
    and the other weights."""

    def changes(shard: Shard) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for number, label_counts in learnt.items():
            rest = shard.rest(number)
            if not len(rest):
                continue
            before = sent.value[number]
            net = deepcopy(before)
            weight = _balance(shard.y, label_counts[1] / label_counts.sum())
            net.epoch(shard.docs, shard.y, weight, rest[np.random.default_rng([*seed, shard.number]).permutation(len(rest))])
            for k in range(TABLES):
                place = np.flatnonzero(net.square[k] != before.square[k])
                change = net.e[k][place] - before.e[k][place]
                yield number * TABLES + k, place, np.column_stack([change, net.square[k][place] - before.square[k][place]])
            dense = _dense(net)
            yield -1 - number, np.arange(len(dense)), np.hstack([dense, np.zeros((len(dense), DIM - 2))])

    return changes


def score(docs: DataFrame, labels: DataFrame, allowed: Column, decision: float = 0.7, epochs: int = 6, rate: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and toxicity score of every row."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    net = train(d, labels, allowed, decision, epochs, rate)
    if net is None:
        return d.select("doc_id", F.lit(0.0).alias("score"))
    sent = d.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.concatenate([np.zeros(0), *[sent.value.scores(as_bytes(batch.slice(lo, 256))) for lo in range(0, len(batch), 256)]]))
        finished()

    return d.select("doc_id", scored("text").alias("score"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of labels outside the held-out fold."""
    held = fold("doc_id", 3) == 1
    out = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int").alias("predicted"))
