"""Grouping, aggregation, order and limits over groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, FractionalType, NumericType, StringType

from strideq.errors import QueryError
from strideq.functions.times import bucket, micros
from strideq.operators.frames import Groups


def kept(field: str) -> str:
    """The place of a field's value in a member."""
    return "f_" + field


def as_text(c: Column, kind: DataType) -> Column:
    """A value as a key shows it."""
    if isinstance(kind, BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(kind, FractionalType):
        return c.cast("double").cast("string")
    return c.cast("string")


def keys(groups: Groups, by: tuple[tuple[str | None, str], ...], kinds: dict[str, DataType], unit: str | None) -> DataFrame:
    """Groups with ``key``, from the first member's values."""
    first = F.element_at("m", 1)
    parts = []
    for bucket_, field in by:
        if field not in kinds:
            parts.append(F.lit("__no_timestamp__" if bucket_ else "__none__"))
            continue
        value, kind = first[kept(field)], kinds[field]
        if bucket_:
            us = micros(value, kind, unit)
            parts.append(F.when(value.isNull(), "__no_timestamp__").when(us.isNull(), "__invalid_timestamp__").otherwise(bucket(us, bucket_)))
        else:
            parts.append(F.coalesce(as_text(value, kind), F.lit("__none__")))
    return groups.df.withColumn("key", F.concat_ws("|", *parts))


def aggregate(df: DataFrame, function: str, field: str | None, kinds: dict[str, DataType], grouped: bool, unit: str | None) -> DataFrame:
    """One ``value``, or one per ``key``: ``count`` counts groups; sums, averages and
    extremes are over distinct events, values that are no numbers left out."""
    by = ["key"] if grouped else []
    if function == "count":
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias("value"))
    if field not in kinds:
        empty = {"count_distinct": F.lit(0).cast("long"), "distinct": F.array().cast("array<string>")}.get(function, F.lit(None).cast("double"))
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).select(*by, empty.alias("value"))
    kind = kinds[field]
    events = df.select(*by, F.explode("m").alias("e")).select(*by, F.col("e.p").alias("p"), F.col(f"e.{kept(field)}").alias("x"))
    if function == "count_distinct":
        return events.groupBy(*by).agg(F.count_distinct("x").alias("value"))
    if function == "distinct":
        return events.groupBy(*by).agg(F.sort_array(F.collect_set("x")).alias("value"))
    events = events.dropDuplicates([*by, "p"])
    number = F.col("x").cast("double") if isinstance(kind, NumericType) else F.col("x").try_cast("double") if isinstance(kind, StringType) else F.lit(None).cast("double")
    if function in ("min", "max") and not isinstance(kind, NumericType):
        us = micros(F.col("x"), kind, unit)
        r = events.agg(F.count("x"), F.count(number), F.count(us)).first()
        if r[0] and r[1] < r[0]:
            if r[2] < r[0]:
                raise QueryError(f"{function}({field}) needs numbers or times; some values are neither")
            best = F.min_by if function == "min" else F.max_by
            return events.groupBy(*by).agg(best(F.col("x").cast("string"), us).alias("value"))
    agg = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[function]
    value = agg(number)
    return events.groupBy(*by).agg((F.coalesce(value, F.lit(0.0)) if function == "sum" else value).alias("value"))


def ordered(df: DataFrame, fields: tuple[str, ...], down: bool, kinds: dict[str, DataType]) -> DataFrame:
    """Groups by their first members' values; missing values last either way, then the
    natural order."""
    missing = [f for f in fields if f not in kinds]
    if missing:
        raise QueryError(f"no event has the field {missing[0]!r} to order by")
    first = F.element_at("m", 1)
    values = [first[kept(f)] for f in fields]
    gone = F.greatest(*[v.isNull() for v in values], F.lit(False))
    return df.orderBy(gone.asc(), *[v.desc() if down else v.asc() for v in values], F.col("o").asc())
