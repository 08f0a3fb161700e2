"""Links between whole groups: subqueries, and runs beside a link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideq.errors import QueryError
from strideq.operators.frames import BOUND, Groups, agree, bucket, differ, positions


def _edges(groups: Groups, axis: str, prefix: str) -> DataFrame:
    at = F.transform("m", lambda x: x[axis])
    df = groups.df.select(F.struct(*[F.col(f"`{c}`") for c in groups.df.columns]).alias(prefix), F.element_at(at, 1).alias("lo"), F.element_at(at, -1).alias("hi"), F.element_at("m", 1)["p"].alias("first"), F.element_at("m", -1)["p"].alias("last"))
    return df


def _same(left: Groups, right: Groups) -> Column:
    """Shared variables of single values are equal, plain, so that a join takes them as keys."""
    found = F.lit(True)
    for v, is_list in right.bound.items():
        if v in left.bound and not is_list and not left.bound[v]:
            found = found & (F.col(f"l.`{BOUND}{v}`") == F.col(f"r.`{BOUND}{v}`"))
    return found


def _test(left: Groups, right: Groups, unequal: list[tuple[str, str, bool, str]]) -> Column:
    """Shared lists agree; ``unequal`` is (side, column, is a list, variable)."""
    found = F.lit(True)
    for v, is_list in right.bound.items():
        if v in left.bound and (is_list or left.bound[v]):
            found = found & agree(F.col(f"l.`{BOUND}{v}`"), F.col(f"r.`{BOUND}{v}`"), left.bound[v], is_list)
    for side, column, is_list, v in unequal:
        other, bound = ("r", right.bound) if side == "l" else ("l", left.bound)
        if v not in bound:
            raise QueryError(f"!${v} refers to a variable that the other side does not bind")
        found = found & differ(F.col(f"{side}.`{column}`"), F.col(f"{other}.`{BOUND}{v}`"), is_list, bound[v])
    found = found & ~F.arrays_overlap(positions(F.col("l.m")), positions(F.col("r.m")))
    return F.coalesce(found, F.lit(False))


def link(left: Groups, right: Groups, axis: str, window: int, forward: bool, negative: bool, unequal: list[tuple[str, str, bool, str]] | None = None) -> Groups:
    """Each left group with every right group that begins at the nearest eligible border
    after it (or ends at the nearest before it); or, negative, those without any."""
    unequal = unequal or []
    a, b = _edges(left, axis, "l"), _edges(right, axis, "r")
    a = a.select("l", F.col("hi" if forward else "lo").alias("x"), positions(F.col("l.m")).alias("id_")).filter("x is not null")
    b = b.select("r", F.col("lo" if forward else "hi").alias("rx"), F.col("first" if forward else "last").alias("rq")).filter("rx is not null")
    width = max(window, 1)
    distance = F.col("rx") - F.col("x") if forward else F.col("x") - F.col("rx")
    same = _same(left, right)
    near = (distance > 0) & (distance <= window) & _test(left, right, unequal)
    if negative:
        for v in right.bound:
            if v not in left.bound:
                raise QueryError(f"${v} on the excluded side is not bound on the left")
        reach = F.col("rx") - window if forward else F.col("rx") + window
        many = b.select("r", "rx", F.explode(F.array_distinct(F.array(bucket(F.col("rx"), width), bucket(reach, width)))).alias("rb"))
        return left.of(a.withColumn("b", bucket(F.col("x"), width)).join(many, (F.col("b") == F.col("rb")) & same & near, "left_anti").select("l.*"))
    reach = F.col("x") + window if forward else F.col("x") - window
    many = a.withColumn("b", F.explode(F.array_distinct(F.array(bucket(F.col("x"), width), bucket(reach, width)))))
    met = many.join(b.withColumn("rb", bucket(F.col("rx"), width)), (F.col("b") == F.col("rb")) & same).filter(near).withColumn("d", distance)
    order = Window.partitionBy("id_").orderBy("d", F.col("rq") if forward else -F.col("rq"))
    met = met.withColumn("rank_", F.rank().over(order)).filter("rank_ = 1")
    bound, columns = dict(left.bound), {v: F.col(f"l.`{BOUND}{v}`") for v in left.bound}
    for v, is_list in right.bound.items():
        if v not in bound:
            bound[v], columns[v] = is_list, F.col(f"r.`{BOUND}{v}`")
    m = F.concat("l.m", "r.m") if forward else F.concat("r.m", "l.m")
    out = met.select(m.alias("m"), F.col("l.o").alias("o"), *[c.alias(BOUND + v) for v, c in columns.items()])
    return Groups(out, bound, left.axes | right.axes | {axis})
