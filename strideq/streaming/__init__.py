"""Queries over unbounded streams: predicates as they are, links with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideq.plans.predicates import Predicates
from strideq.plans.syntax import parse
from strideq.sources.corpus import Corpus, CorpusSpec


def matching(stream: DataFrame, query: str, spec: CorpusSpec, dictionaries: dict | None = None) -> DataFrame:
    """The events of a stream that a lone condition matches: stateless, append mode."""
    q = parse(query)
    body = q.source.items[0].body
    corpus = Corpus(stream.withColumn("position", F.lit(0).cast("long")), spec)
    return stream.filter(Predicates(corpus, dictionaries or {}).column(body))


def link(left: DataFrame, right: DataFrame, window_seconds: int, late: str = "10 minutes", keys: tuple[str, ...] = (), id_col: str = "id", time_col: str = "timestamp") -> DataFrame:
    """Left events with every right event within the window after them: a stream-stream
    interval join. Both sides' watermarks bound the state. The nearest per left event is
    the least ``distance_us``; ``nearest`` takes it."""
    a = left.withWatermark(time_col, late).select(F.col(id_col).alias("left_id"), F.col(time_col).alias("left_time"), *[F.col(k).alias("left_" + k) for k in keys])
    b = right.withWatermark(time_col, late).select(F.col(id_col).alias("right_id"), F.col(time_col).alias("right_time"), *[F.col(k).alias("right_" + k) for k in keys])
    on = (F.col("right_time") > F.col("left_time")) & (F.col("right_time") <= F.col("left_time") + F.expr(f"INTERVAL {window_seconds} SECONDS"))
    for k in keys:
        on = on & (F.col("left_" + k) == F.col("right_" + k))
    return a.join(b, on).withColumn("distance_us", F.unix_micros("right_time") - F.unix_micros("left_time"))


def nearest(linked: DataFrame) -> DataFrame:
    """The nearest right event of every left one, once the watermark has passed."""
    best = F.min_by(F.struct("right_id", "right_time"), F.struct("distance_us", "right_id")).alias("n")
    return linked.groupBy("left_id", "left_time").agg(best).select("left_id", "left_time", "n.right_id", "n.right_time")


def runs(stream: DataFrame, step_seconds: int, least: int, late: str = "10 minutes", keys: tuple[str, ...] = (), time_col: str = "timestamp") -> DataFrame:
    """Maximal runs by time as session windows: events at most a step apart. A session ends
    a step after its last event and joins what begins right then, as a run does."""
    return (
        stream.withWatermark(time_col, late)
        .groupBy(F.session_window(time_col, f"{step_seconds} seconds").alias("session"), *keys)
        .agg(F.count(F.lit(1)).alias("n"), F.min(time_col).alias("first"), F.max(time_col).alias("last"))
        .filter(F.col("n") >= least)
    )
