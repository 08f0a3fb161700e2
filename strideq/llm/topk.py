"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are first turned to the principal axes of a bounded sample, which changes no inner
product. Then each is summarised at several resolutions: cut into segments, and of every
segment its mean and deviation. The distance of two vectors is at least the distance of
their summaries, weighted by segment length, and finer segments give a tighter bound. For
vectors of known length a lower bound on distance is an upper bound on the inner product.
Segments at the front are short, since the first axes hold most.

Queries meet all rows in blocks, coarse to fine. Every query begins with a floor, its k-th
score within the sample, so even the first block is pruned: a pair whose bound is below
the floor goes at each resolution. A resolution that rules out little of a sample of pairs
is passed over in that block; where few pairs are left it looks at these one by one. Those
left at the end are scored exactly, in whole numbers.

Components are ``floor(scale * x)``. Products are summed in doubles where these are exact,
in 64-bit integers beyond, and in Python's beyond these. Scores outside the range of a
long are cut to it, and are ties then.

Queries are read in blocks of bounded bytes, one at a time: a block is all that is
broadcast. Each task keeps its own k best per query, and the few that tasks keep are
ranked per query.

Defined results: a vector that is null, empty, or holds null or non-finite components
takes no part, as query or candidate; nor does a row without an id. A pair of different
dimensions has no score. A repeated query row is one query; of query rows with one id and
other vectors each is a query of its own, with ranks of its own. Repeated candidate rows
are candidates each. Ties go to the smaller id. Rows with the query's own id are no
candidates. With fewer candidates than k, all are returned. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideq.llm.common import saved, table, trimmed
from strideq.llm.text_arrays import first_by_hash

_SLACK = 1e-9
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Rows and queries that meet at once.
ROWS, QUERIES = 1024, 4096


def resolutions(dim: int) -> list[np.ndarray]:
    """Segment borders, coarse to fine: single axes at the front, then longer segments."""
    found = []
    for single, rest in ((4, 1), (12, 2), (28, 4)):
        front = min(single, dim)
        back = np.linspace(front, dim, min(rest, dim - front) + 1).astype(int)[1:] if dim > front else []
        found.append(np.concatenate([np.arange(front + 1), back]).astype(int))
        if front == dim:
            break
    return found


def summary(m: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Means and deviations of each row's segments, scaled so that the inner product of
    two summaries is an upper bound on the inner product of the vectors."""
    width = np.diff(edges).astype(float)
    mean = np.add.reduceat(m, edges[:-1], axis=1) / width
    long = width > 1
    square = np.add.reduceat(m * m, edges[:-1], axis=1)[:, long] / width[long]
    deviation = np.sqrt(np.maximum(square - mean[:, long] ** 2, 0.0))
    return np.hstack([mean * np.sqrt(width), deviation * np.sqrt(width[long])])


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` in doubles; infinite where these can't hold it."""
    with np.errstate(over="ignore"):
        return np.floor(x * float(scale))


class Side:
    """Vectors with their summaries."""

    def __init__(self, x: np.ndarray, scale: int, turn: np.ndarray):
        self.x, self.scale, self.v = x, scale, whole(x, scale)
        with np.errstate(over="ignore", invalid="ignore"):
            turned = self.v @ turn
            self.norm = np.sqrt((self.v * self.v).sum(axis=1))
            self.levels = [summary(turned, e) for e in resolutions(x.shape[1])]

    def integers(self, i: int) -> list[int]:
        """The components of one vector, exact."""
        return [int(np.floor(c * self.scale)) if abs(c) < 2.0**40 else int(c) * self.scale for c in self.x[i].tolist()]


def _pairwise(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows ``i`` of ``a`` with rows ``j`` of ``b``."""
    out = np.empty(len(i), np.result_type(a, b))
    for lo in range(0, len(i), 1 << 16):
        s = slice(lo, lo + (1 << 16))
        out[s] = np.einsum("ij,ij->i", a[i[s]], b[j[s]])
    return out


def exact(q: Side, r: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whole-number inner products of the pairs, cut to the range of a long."""
    size = q.norm[i] * r.norm[j]
    if not len(i) or size.max() < 2.0**53:
        return _pairwise(q.v, r.v, i, j).astype(np.int64)
    out = np.empty(len(i), np.int64)
    small, mid = size < 2.0**53, (size >= 2.0**53) & (size < 2.0**62)
    out[small] = _pairwise(q.v, r.v, i[small], j[small]).astype(np.int64)
    if mid.any():
        at_q, to_q = np.unique(i[mid], return_inverse=True)
        at_r, to_r = np.unique(j[mid], return_inverse=True)
        # Either vector of such a pair is below 2**62, and so are its components.
        out[mid] = _pairwise(q.v[at_q].astype(np.int64), r.v[at_r].astype(np.int64), to_q, to_r)
    for n in np.flatnonzero(~small & ~mid):
        product = sum(x * y for x, y in zip(q.integers(int(i[n])), r.integers(int(j[n])), strict=True))
        out[n] = max(_LOW + 1, min(_HIGH, product))
    return out


def _helps(bound: np.ndarray, least: np.ndarray, alive: np.ndarray) -> bool:
    """Whether a resolution rules out a fair share of a sample of the pairs that are left;
    one that doesn't costs more than it saves."""
    n = alive.sum()
    return bool(n) and (alive & ~(bound < least)).sum() < 0.7 * n


def best_in_block(q: Side, q_ids: np.ndarray, r: Side, ids: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray], floor: np.ndarray, seen: Counter | None = None) -> None:
    """Merge a block of rows into each query's best scores and ids (padded with the least
    long and the greatest id). ``floor``: what the k-th score is known to reach."""
    scores, kept = best
    least = np.maximum(scores[:, -1], floor)
    least = np.where(least <= _LOW + 1, -np.inf, least.astype(float))  # nothing is below a cut score
    alive = ids[None, :] != q_ids[:, None]
    i = j = None
    with np.errstate(over="ignore", invalid="ignore"):
        slack = _SLACK * q.norm[:, None] * r.norm[None, :]
        for a, b in zip(q.levels, r.levels, strict=True):
            if i is not None:
                stays = ~(_pairwise(a, b, i, j) + slack[i, j] < least[i])
                i, j = i[stays], j[stays]
            elif _helps(a[::16] @ b[::4].T + slack[::16, ::4], least[::16, None], alive[::16, ::4]):
                alive &= ~(a @ b.T + slack < least[:, None])
                if 32 * alive.sum() < alive.size:
                    i, j = np.nonzero(alive)
    # A product of all is as fast as one of a thirtieth of the pairs, where doubles are exact.
    if i is None and q.norm.max(initial=0) * r.norm.max(initial=0) < 2.0**53:
        found = (q.v @ r.v.T).astype(np.int64)
        n = int(alive.sum())
        i, j = np.nonzero(alive & (found >= np.maximum(scores[:, -1], floor)[:, None]))
        found = found[i, j]
    else:
        i, j = (i, j) if i is not None else np.nonzero(alive)
        n = len(i)
        found = exact(q, r, i, j)
        hit = found >= np.maximum(scores[i, -1], floor[i])
        i, j, found = i[hit], j[hit], found[hit]
    if seen is not None:
        seen["pairs"] += len(q_ids) * len(ids)
        seen["scored"] += n
    if not len(i):
        return
    own = np.unique(i)
    all_q = np.concatenate([np.repeat(own, k), i])
    all_s, all_id = np.concatenate([scores[own].ravel(), found]), np.concatenate([kept[own].ravel(), ids[j]])
    order = np.lexsort((all_id, ~all_s, all_q))  # ~s falls as s rises, and never overflows
    all_q, all_s, all_id = all_q[order], all_s[order], all_id[order]
    begin = np.searchsorted(all_q, own)
    take = (begin[:, None] + np.arange(k)[None, :]).ravel()  # every query has k entries at least
    scores[own], kept[own] = all_s[take].reshape(-1, k), all_id[take].reshape(-1, k)


def _turn(sample: np.ndarray) -> np.ndarray:
    """Principal axes of a sample, the first ones first."""
    with np.errstate(over="ignore"):
        norm = np.sqrt((sample * sample).sum(axis=1))
    fine = np.isfinite(norm) & (norm > 0)
    dim = sample.shape[1]
    if not fine.any():
        return np.eye(dim)
    unit = sample[fine] / norm[fine][:, None]
    return np.linalg.eigh(unit.T @ unit)[1][:, ::-1]


def _in_pieces(q: Side, size: int) -> list[tuple[slice, Side]]:
    out = []
    for lo in range(0, len(q.x), size):
        s, part = slice(lo, lo + size), object.__new__(Side)
        part.x, part.scale, part.v, part.norm, part.levels = q.x[s], q.scale, q.v[s], q.norm[s], [a[s] for a in q.levels]
        out.append((s, part))
    return out


def search(q_ids: np.ndarray, q: Side, blocks: Iterator[tuple[np.ndarray, np.ndarray]], k: int, turn: np.ndarray, floor: np.ndarray, seen: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k best scores and ids of each query among blocks of (ids, vectors)."""
    scores, kept = np.full((len(q_ids), k), _LOW), np.full((len(q_ids), k), _HIGH)
    pieces = _in_pieces(q, QUERIES)
    for ids, x in blocks:
        r = Side(x, q.scale, turn)
        for s, part in pieces:
            best_in_block(part, q_ids[s], r, ids, k, (scores[s], kept[s]), floor[s], seen)
    return scores, kept


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(rows, -1)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, query_bytes: int = 16 << 20, sample: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the k best of all rows for every row whose id is
    divisible by ``every``. The axes and the first floors are from the ``sample`` rows that
    are first by a hash; they change how much is compared, never the result."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    v = v.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    queries, _ = saved(v.filter(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates().withColumn("query_key", F.xxhash64("v")), "queries")
    dims = [r[0] for r in queries.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    found = []
    for dim in dims:
        rows, own = v.filter(F.size("v") == dim), queries.filter(F.size("v") == dim)
        first = first_by_hash(rows.withColumn("d_", F.size("v")), "d_", {dim: sample}, ["vec_id", "v"]).toArrow()
        first_ids, first_x = first.column("vec_id").to_numpy(), _matrix(first.column("v"), first.num_rows)
        turn = _turn(whole(first_x, scale))
        # Blocks by range of id; never more vectors at once on the driver than one block.
        n, low = own.agg(F.count(F.lit(1)), F.min("vec_id")).first()
        blocks = max(1, -(-n * dim * 8 // query_bytes))
        edges = [low, *sorted({int(e) for e in own.stat.approxQuantile("vec_id", [i / blocks for i in range(1, blocks)], 0.001)} - {low})] if blocks > 1 else [low]
        for at, lo in enumerate(edges):
            block = own.filter(F.col("vec_id") >= lo)
            if at + 1 < len(edges):
                block = block.filter(F.col("vec_id") < edges[at + 1])
            got = block.select("vec_id", "query_key", "v").toArrow()
            q_ids, q_keys, q_x = got.column("vec_id").to_numpy(), got.column("query_key").to_numpy(), _matrix(got.column("v"), got.num_rows)
            one = _block(rows, q_ids, q_keys, q_x, k, scale, turn, first_ids, first_x)
            if len(edges) > 1:  # one block's broadcast at a time
                one, _ = saved(one, "best")
            found.append(one)
    if not found:
        found = [spark.createDataFrame([], "query_id bigint, query_key bigint, vec_id bigint, score bigint")]
    parts = found[0]
    for f in found[1:]:
        parts = parts.unionByName(f)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), F.asc("vec_id"))
    return parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _block(rows: DataFrame, q_ids: np.ndarray, q_keys: np.ndarray, q_x: np.ndarray, k: int, scale: int, turn: np.ndarray, first_ids: np.ndarray, first_x: np.ndarray) -> DataFrame:
    def pieces(ids: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for lo in range(0, len(ids), ROWS):
            yield ids[lo : lo + ROWS], x[lo : lo + ROWS]

    none = np.full(len(q_ids), _LOW)
    floor = search(q_ids, Side(q_x, scale, turn), pieces(first_ids, first_x), k, turn, none)[0][:, -1]
    sent = rows.sparkSession.sparkContext.broadcast((q_ids, q_keys, q_x, turn, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q_keys, q_x, turn, floor = sent.value

        def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                if batch.num_rows:
                    yield from pieces(batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), batch.num_rows))

        scores, kept = search(q_ids, Side(q_x, scale, turn), blocks(), k, turn, floor)
        at = scores > _LOW
        n = at.sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, n)), pa.array(np.repeat(q_keys, n)), pa.array(kept[at]), pa.array(scores[at])], ["query_id", "query_key", "vec_id", "score"])
        trimmed()

    return rows.mapInArrow(run, "query_id bigint, query_key bigint, vec_id bigint, score bigint")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all embeddings for every hundredth one."""
    return top_k(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
