"""What a corpus holds: coverage, types, distinct and frequent values; and what is
around an event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from strideq.sources.corpus import Corpus


def profile(df: DataFrame, top: int = 10, distinct_up_to: int = 1000) -> DataFrame:
    """Per field: type, coverage, distinct values (null beyond ``distinct_up_to``), and the
    ``top`` most frequent values with their counts."""
    n = df.count()
    there = df.agg(*[F.sum(F.col(f"`{f.name}`").isNotNull().cast("long")).alias(f"c{i}") for i, f in enumerate(df.schema.fields)]).first()
    rows = []
    for i, f in enumerate(df.schema.fields):
        own = df.select(F.explode(f"`{f.name}`").alias("v")) if isinstance(f.dataType, ArrayType) else df.select(F.col(f"`{f.name}`").alias("v"))
        counts = own.filter("v is not null").select(F.col("v").cast("string").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        best = counts.orderBy(F.desc("n"), "v").limit(top).collect()
        many = counts.limit(distinct_up_to + 1).count()
        rows.append((f.name, f.dataType.simpleString(), round((there[i] or 0) / max(n, 1), 6), many if many <= distinct_up_to else None, ",".join(f"{r['v']}={r['n']}" for r in best)))
    return df.sparkSession.createDataFrame(rows, "field string, type string, coverage double, n_distinct bigint, top string")


def context(corpus: Corpus, position: int, before: int = 5, after: int = 5, same: str | None = None, minutes: int | None = None) -> DataFrame:
    """Events around a position, in order; of the same value of a field, or not more than
    so many minutes away, if asked."""
    df = corpus.df
    here = df.filter(F.col("position") == position)
    if same or minutes is not None:
        row = here.select(*([same] if same else []), "t_us").first()
        if same:
            df = df.filter(F.col(same).eqNullSafe(F.lit(row[same])))
        if minutes is not None:
            corpus.require_time("context in minutes")
            df = df.filter(F.abs(F.col("t_us") - F.lit(row["t_us"])) <= minutes * 60_000_000)
    earlier = df.filter(F.col("position") < position).orderBy(F.desc("position")).limit(before)
    later = df.filter(F.col("position") > position).orderBy("position").limit(after)
    return earlier.unionByName(here).unionByName(later).orderBy("position")
