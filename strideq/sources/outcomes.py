"""Results of calls attached to the calls, and sizes as words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duration_word(ms: Column) -> Column:
    """A duration in milliseconds as a word."""
    return F.when(ms < 1_000, "instant").when(ms < 10_000, "short").when(ms < 60_000, "medium").when(ms < 600_000, "long").when(ms.isNotNull(), "very_long")


def size_word(chars: Column) -> Column:
    """A number of characters as a word."""
    return F.when(chars == 0, "empty").when(chars < 1_000, "small").when(chars < 10_000, "medium").when(chars < 100_000, "large").when(chars.isNotNull(), "huge")


def attach_outcomes(df: DataFrame, file: str = "session", order: str = "line") -> DataFrame:
    """Each result goes to the earliest call of its id that still waits.

    Within a file and call id, a result answers a call if one waits: reading in order,
    calls add one and results take one, never below none. Answering results are
    numbered, calls are numbered, and equal numbers meet. ``df`` has kind (tool_use,
    tool_result, ...), call, time, error and output_chars; calls get outcome,
    duration_ms, output_chars, spawned and the two words.
    """
    named = df.filter(F.col("call").isNotNull() & F.col("kind").isin("tool_use", "tool_result"))
    own = Window.partitionBy(file, "call").orderBy(order)
    step = F.when(F.col("kind") == "tool_use", 1).otherwise(-1)
    walk = named.withColumn("walk_", F.sum(step).over(own))
    # The walk's running minimum below zero says how many results found nobody waiting.
    lost = F.least(F.lit(0), F.min("walk_").over(own))
    walk = walk.withColumn("lost_", lost)
    before = F.coalesce(F.lag("lost_").over(own), F.lit(0))
    walk = walk.withColumn("answers_", (F.col("kind") == "tool_result") & (F.col("lost_") == before))
    uses = walk.filter("kind = 'tool_use'").withColumn("nth_", F.row_number().over(own)).select(F.col(file).alias("u_file"), F.col("call").alias("u_call"), F.col(order).alias("u_order"), F.col("time").alias("u_time"), "nth_")
    results = walk.filter("answers_").withColumn("nth_", F.row_number().over(own)).select(F.col(file).alias("u_file"), F.col("call").alias("u_call"), "nth_", F.col("time").alias("r_time"), F.col("error").alias("r_error"), F.col("output_chars").alias("r_chars"), F.col("spawned").alias("r_spawned") if "spawned" in df.columns else F.lit(None).cast("string").alias("r_spawned"))
    met = uses.join(results, ["u_file", "u_call", "nth_"]).select("u_file", "u_order", "u_time", "r_time", "r_error", "r_chars", "r_spawned")
    out = df.join(met, (df[file] == met["u_file"]) & (df[order] == met["u_order"]), "left")
    is_use, answered = F.col("kind") == "tool_use", F.col("u_order").isNotNull()
    ms = F.round((F.unix_micros("r_time") - F.unix_micros("u_time")) / 1000).cast("long")
    out = out.withColumns(
        {
            "outcome": F.when(is_use & answered, F.when(F.col("r_error"), "error").otherwise("ok")).when(is_use, "none"),
            "duration_ms": F.when(is_use, ms),
            "output_chars": F.when(is_use, F.col("r_chars")).otherwise(F.col("output_chars")),
            "spawned": F.when(is_use, F.col("r_spawned")),
        }
    )
    out = out.drop("u_file", "u_order", "u_time", "r_time", "r_error", "r_chars", "r_spawned")
    return out.withColumns({"duration_bucket": duration_word(F.col("duration_ms")), "output_bucket": size_word(F.col("output_chars"))})
