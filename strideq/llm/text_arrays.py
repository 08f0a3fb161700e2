"""Texts as arrays: words and their hashes without a Python step per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideq.llm.common import trimmed

PART = 1 << 20
_P = 0x5851F42D4C957F2D
_C = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


def lower_words() -> np.ndarray:
    """Letters (A-Z lowered), digits and all bytes beyond ASCII make words; 0 separates."""
    t = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 128 or c.isalnum():
            t[b] = ord(c.lower()) if b < 128 else b
    return t


def raw_words() -> np.ndarray:
    """All bytes but the six ASCII spaces make words."""
    t = np.arange(256, dtype=np.uint8)
    t[[0, 9, 10, 11, 12, 13, 32]] = 0
    return t


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            p, inverse = np.full(n, _P, np.uint64), np.full(n, pow(_P, -1, 2**64), np.uint64)
            p[0] = inverse[0] = 1
            _powers[:] = [np.multiply.accumulate(p), np.multiply.accumulate(inverse)]
    return _powers[0], _powers[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of an odd number modulo 2**64, and their inverses."""
    return _tables(max(n, PART))


def finished() -> None:
    """At the end of a task: drop the tables of powers and give memory back."""
    _powers.clear()
    trimmed()


def words(buffer: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every word in a byte buffer."""
    edge = np.diff(np.concatenate([[0], (table[buffer] > 0).view(np.int8), [0]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return start, end, spans(buffer, table, start, end)


def spans(buffer: np.ndarray, table: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of a byte buffer."""
    m = table[buffer]
    p, inverse = _tables(max(len(m), PART))
    with np.errstate(over="ignore"):
        s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(m.astype(np.uint64) * p[: len(m)])])
        h = (s[end] - s[start]) * inverse[start]
        h = (h ^ (h >> np.uint64(31))) * _C
    return h ^ (h >> np.uint64(29))


def _cut(text: bytes, at: int, every: int, table: np.ndarray | None) -> int:
    """Where the piece of a text from ``at`` on ends: at white space, or before a word
    whose number from ``at`` on is a multiple of ``every``. A window without such a place
    is widened, so no word is ever cut."""
    size = PART
    while at + size < len(text):
        if every:
            start = words(np.frombuffer(text, np.uint8, size, at), table)[0]
            cut = int(start[(len(start) - 1) // every * every]) if len(start) > every else 0
        else:
            cut = max(text.rfind(c, at, at + size) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")) - at
        if cut > 0:
            return at + cut
        size *= 2
    return len(text)


def parts(texts: list[bytes | None], every: int = 0, table: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of about a megabyte: bytes, and for each piece its text and its start.

    A longer text is cut into pieces at white space, so memory stays bounded; with
    ``every``, into pieces of so many words of ``table``, or a multiple.
    """
    joined: list[bytes] = []
    of: list[int] = []
    size = 0

    def out():
        starts = np.cumsum([0] + [len(x) + 1 for x in joined[:-1]])
        return np.frombuffer(b" ".join(joined), np.uint8), np.array(of), starts

    for i, text in enumerate(texts):
        text = text or b""
        at = 0
        while True:
            cut = _cut(text, at, every, table)
            if joined and size + cut - at > PART:
                yield out()
                joined, of, size = [], [], 0
            joined.append(text[at:cut])
            of.append(i)
            size += cut - at + 1
            at = cut
            if at >= len(text):
                break
    if joined:
        yield out()


def first_by_hash(df: DataFrame, by: str, most: dict, of: list[str]) -> DataFrame:
    """Of the rows with each value of ``by`` the first ``most[value]`` by a hash of the
    columns ``of``, rows that are equal in these counting once; with ``by`` and ``of``.

    Rows beyond about twice the share that is wanted are left out where they are read, so
    that tasks together send a few times ``most`` rows on, however many there are.
    """
    h, mask = F.xxhash64(*[F.col(f"`{c}`") for c in of]), (1 << 52) - 1
    df = df.select(by, *of, h.alias("h_"))
    wanted = F.col(by).isin(list(most))
    numbers = {r[0]: r[1] for r in df.filter(wanted).groupBy(by).agg(F.approx_count_distinct("h_", 0.02)).collect()}
    share = F.lit(None).cast("long")
    for value, n in numbers.items():
        limit = mask if n <= 4 * most[value] else int((2 * most[value] + 50) / n * mask)
        share = F.when(F.col(by) == value, F.lit(limit)).otherwise(share)
    once = df.filter(wanted).filter(F.col("h_").bitwiseAND(F.lit(mask)) <= share).groupBy(by, "h_").agg(F.min(F.struct(*of)).alias("r_"))
    place = F.row_number().over(Window.partitionBy(by).orderBy("h_"))
    kept = once.withColumn("n_", place)
    last = F.lit(0)
    for value, n in most.items():
        last = F.when(F.col(by) == value, n).otherwise(last)
    return kept.filter(F.col("n_") <= last).select(by, *[F.col(f"r_.`{c}`") for c in of])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], train) -> list[tuple[bytes, int, int]]:
    """(text, label, total rows with that label) for at most ``most[label]`` labelled rows of
    each label, by hash of the id; the whole text of each. ``train``: condition on doc_id.
    An id with both labels has the larger; of several texts with one id the least is taken."""
    own = labels.select("doc_id", F.col(label).cast("int").alias("y")).dropna().filter(train)
    own = own.groupBy("doc_id").agg(F.max("y").alias("y"))
    totals = {r["y"]: r["n"] for r in own.filter(F.col("y").isin([0, 1])).groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = first_by_hash(own, "y", most, ["doc_id"])  # at most sum(most) rows
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"]))
    return [((r["text"] or "").encode("utf-8", "surrogatepass"), r["y"], totals[r["y"]]) for r in rows]


def rows_by(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.RecordBatch | pa.Table]:
    """The rows of each key, of batches sorted by whole-number key columns; one key's rows
    are held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        own = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in key], axis=1)
        edges = 1 + np.flatnonzero((own[1:] != own[:-1]).any(axis=1))
        begin, end = np.append(0, edges), np.append(edges, n)
        if held and (own[0] != last).any():
            yield held[0] if len(held) == 1 else pa.Table.from_batches(held)
            held = []
        for a, b in zip(begin[:-1], end[:-1], strict=True):
            part = batch.slice(a, b - a)
            yield pa.Table.from_batches([*held, part]) if held else part
            held = []
        held.append(batch.slice(begin[-1], end[-1] - begin[-1]))
        last = own[-1]
    if held:
        yield held[0] if len(held) == 1 else pa.Table.from_batches(held)


def whole_keys(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by whole-number key columns, cut so that a key's rows are together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        own = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in key], axis=1)
        edges = np.flatnonzero((own[1:] != own[:-1]).any(axis=1))
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in key):
            yield pa.concat_batches(held)
            held = []
        if len(edges):
            cut = int(edges[-1]) + 1
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held, batch = [], batch.slice(cut)
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * _C
        h = (h ^ (h >> np.uint64(32))) * _C
        return h ^ (h >> np.uint64(32))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """Texts of an Arrow column as bytes."""
    return column.cast(pa.binary()).to_pylist()


def best_threshold(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float | None:
    """The middle of the gap in ``logit`` where the weighted F1 of the rarer label is
    best; None if a label is missing."""
    if not (0 < y.sum() < len(y)):
        return None
    rare = y if (weight * y).sum() <= (weight * (1 - y)).sum() else 1 - y
    up = rare is y
    order = np.argsort(logit if up else -logit, kind="stable")[::-1]
    hit, miss = np.cumsum((weight * rare)[order]), np.cumsum((weight * (1 - rare))[order])
    f1 = 2 * hit / (hit + miss + (weight * rare).sum())
    k = int(np.argmax(f1))
    lo = logit[order][k]
    nxt = logit[order][min(k + 1, len(order) - 1)]
    return float((lo + nxt) / 2)


class Adam:
    """Adam steps on a dictionary of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
