"""Maximal runs: gaps and islands, without a task that sees all rows.

Islands are found inside stretches of the axis, each a window partition of its own. Then
one summary row per stretch (and per values of the variables) says which stretches join
at their borders; stretches are few by construction. Lengths are added up from summaries,
and only events of runs whose length is in the range are put together.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strideq.operators.frames import BOUND, Groups, Rows, bucket

#: About so many events make a stretch; but never more stretches than this, since their
#: summaries without variables are one window partition.
STRETCH_ROWS, STRETCHES = 2_000, 500_000


def runs(rows: Rows, axis: str, step: int, least: int, most: int | None) -> Groups:
    """One group per maximal run whose length is in the range."""
    first = {}
    for u in rows.equal:
        first.setdefault(u.var, u)
    names = [BOUND + v for v in first]
    df = rows.df.filter(F.col(axis).isNotNull()).select(F.col(axis).alias("x"), "p", "member", *[F.col(u.column).alias(BOUND + v) for v, u in first.items()])
    for n in names:
        df = df.filter(F.col(n).isNotNull())
    low, high, many = df.agg(F.min("x"), F.max("x"), F.count(F.lit(1))).first()
    stretches = max(8, min(many // STRETCH_ROWS, STRETCHES))
    width = max(4 * step, 1, ((high - low) // stretches + 1) if low is not None else 1)
    df = df.withColumn("b", bucket(F.col("x"), width))
    own = Window.partitionBy(*names, "b").orderBy("x", "p")
    gap = F.col("x") - F.lag("x").over(own)
    df = df.withColumn("new", F.when(gap <= step, 0).otherwise(1)).withColumn("i", F.sum("new").over(own))
    islands = df.groupBy(*names, "b", "i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"))
    border = islands.groupBy(*names, "b").agg(F.min("lo").alias("from_"), F.max("hi").alias("to_"), F.max("i").alias("last_i"))
    by_key = Window.partitionBy(*names).orderBy("b")
    joins = F.coalesce((F.col("from_") - F.lag("to_").over(by_key)) <= step, F.lit(False))
    border = border.withColumn("joins", joins)
    # The last island of a stretch begins there, unless it is also the first and joins.
    begins = F.when((F.col("last_i") > 1) | ~F.col("joins"), F.struct(F.col("b").alias("b"), F.col("last_i").alias("i")))
    border = border.withColumn("tail", F.last(begins, ignorenulls=True).over(by_key))
    border = border.withColumn("head", F.when(F.col("joins"), F.lag("tail").over(by_key)).otherwise(F.struct(F.col("b").alias("b"), F.lit(1).cast("long").alias("i"))))
    whole = islands.join(border.select(*names, "b", "head"), [*names, "b"])
    label = F.when(F.col("i") == 1, F.col("head")).otherwise(F.struct(F.col("b").alias("b"), F.col("i").cast("long").alias("i")))
    # Lengths first: runs out of range are never put together.
    parts = whole.select(*names, "b", "i", "n", label["b"].alias("run_b"), label["i"].alias("run_i"))
    run = [*names, "run_b", "run_i"]
    lengths = parts.groupBy(*run).agg(F.sum("n").alias("length")).filter(F.col("length") >= least)
    if most is not None:
        lengths = lengths.filter(F.col("length") <= most)
    fits = parts.join(lengths.select(*run), run).select(*names, "b", "i", "run_b", "run_i")
    found = df.join(fits, [*names, "b", "i"]).groupBy(*run).agg(F.sort_array(F.collect_list(F.struct("x", "p", "member"))).alias("s"))
    out = found.select(F.transform("s", lambda x: x["member"]).alias("m"), F.struct(F.col("s")[0]["x"].alias("a"), F.col("s")[0]["p"].alias("p")).alias("o"), *names)
    return Groups(out, {v: u.is_list for v, u in first.items()}, frozenset({axis}))
