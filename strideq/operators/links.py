"""Links: the nearest event after or before a group, or its absence.

Two strategies. As-of: both sides in one frame, partitioned by stretches of the axis (and
by the variables' values), sorted once, and a running last value; for links without
conditions, with equalities of single values, or with one inequality of single values
beside these. Where axes are mixed, an event of the group may come again: then as many
running values as the group has events. Candidates: a bucketed equi-join with the
exact window and conditions, and the nearest kept per group; for everything else, since a
condition must hold before the nearest is chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideq.errors import QueryError
from strideq.operators.frames import BOUND, Groups, Rows, Use, agree, bucket, differ, positions

#: Buckets of the as-of strategy are this many windows wide: narrower ones give more
#: tasks, wider ones fewer right rows in two buckets (one in STRETCH).
STRETCH = 8


def conditions(groups: Groups, rows: Rows, excluded: bool = False) -> tuple[list[Use], list[tuple]]:
    """Equalities of single values, as keys; and other conditions as (test, bound, use)."""
    keys, others = [], []
    if excluded:
        for u in (*rows.equal, *rows.unequal):
            if u.var not in groups.bound:
                raise QueryError(f"${u.var} on the excluded side is not bound on the left")
    for u in rows.equal:
        if u.var in groups.bound:
            if u.is_list or groups.bound[u.var]:
                others.append((agree, groups.bound[u.var], u))
            else:
                keys.append(u)
    for u in rows.unequal:
        if u.var not in groups.bound:
            raise QueryError(f"!${u.var} refers to a variable that no earlier event binds")
        others.append((differ, groups.bound[u.var], u))
    return keys, others


def _sides(groups: Groups, rows: Rows, axis: str, forward: bool) -> tuple[DataFrame, DataFrame]:
    """Left with its anchor's axis value ``x`` and position ``q``, and right."""
    anchor = F.element_at("m", -1 if forward else 1)
    left = groups.df.select(anchor[axis].alias("x"), anchor["p"].alias("q"), F.struct(*[F.col(f"`{c}`") for c in groups.df.columns]).alias("l"))
    right = rows.df.select(F.col(axis).alias("x"), F.col("p").alias("q"), F.struct(*[F.col(f"`{c}`") for c in rows.df.columns]).alias("r"))
    return left, right.filter("x is not null")


def _as_of(left: DataFrame, right: DataFrame, keys: list[Use], window: int, forward: bool) -> DataFrame:
    """Left rows with ``r``, the nearest right row in the window, or null."""
    width = STRETCH * max(window, 1)
    reach = F.col("x") - window if forward else F.col("x") + window
    names = [f"k{i}" for i in range(len(keys))]
    kinds = [right.schema["r"].dataType[u.column].dataType for u in keys]
    a = left.select(
        "x", "q", F.lit(0).alias("side"), *[F.col(f"l.`{BOUND}{u.var}`").cast(k).alias(n) for u, n, k in zip(keys, names, kinds, strict=True)], bucket(F.col("x"), width).alias("b"), "l", F.lit(None).cast(right.schema["r"].dataType).alias("r")
    )
    b = right.select(
        "x", "q", F.lit(1).alias("side"), *[F.col(f"r.`{u.column}`").alias(n) for u, n in zip(keys, names, strict=True)], F.explode(F.array_distinct(F.array(bucket(F.col("x"), width), bucket(reach, width)))).alias("b"), F.lit(None).cast(left.schema["l"].dataType).alias("l"), "r"
    )
    for n in names:
        b = b.filter(F.col(n).isNotNull())
    # Read towards the anchor: at equal axis values the left row comes before right rows,
    # and the right row read last is the nearest, of equal ones the lowest (forward) or
    # highest position.
    order = [F.col("x").desc(), F.col("side").asc(), F.col("q").desc()] if forward else [F.col("x").asc(), F.col("side").asc(), F.col("q").asc()]
    so_far = Window.partitionBy("b", *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = a.unionByName(b).withColumn("r", F.last("r", ignorenulls=True).over(so_far)).withColumn("rx", F.last(F.when(F.col("side") == 1, F.col("x")), ignorenulls=True).over(so_far))
    distance = F.col("rx") - F.col("x") if forward else F.col("x") - F.col("rx")
    near = F.coalesce((distance > 0) & (distance <= window), F.lit(False))
    return seen.filter("side = 0").select("l", F.when(near, F.col("r")).alias("r"))


def _as_of_other(left: DataFrame, right: DataFrame, keys: list[Use], use: Use, window: int, forward: bool) -> DataFrame:
    """The same, for the nearest right row whose value of one variable differs from the left
    row's: the nearest row, or else the nearest of another value than that row's. Either is
    a running value of one sorted frame, so pairs in the window are never made."""
    width = STRETCH * max(window, 1)
    reach = F.col("x") - window if forward else F.col("x") + window
    names = [f"k{i}" for i in range(len(keys))]
    kinds = [right.schema["r"].dataType[u.column].dataType for u in keys]
    value = F.col(f"r.`{use.column}`")
    a = left.select(
        "x", "q", F.lit(0).alias("side"), *[F.col(f"l.`{BOUND}{u.var}`").cast(k).alias(n) for u, n, k in zip(keys, names, kinds, strict=True)], bucket(F.col("x"), width).alias("b"), "l", F.lit(None).cast(right.schema["r"].dataType).alias("r")
    )
    b = right.filter(value.isNotNull()).select(
        "x", "q", F.lit(1).alias("side"), *[F.col(f"r.`{u.column}`").alias(n) for u, n in zip(keys, names, strict=True)], F.explode(F.array_distinct(F.array(bucket(F.col("x"), width), bucket(reach, width)))).alias("b"), F.lit(None).cast(left.schema["l"].dataType).alias("l"), "r"
    )
    for n in names:
        b = b.filter(F.col(n).isNotNull())
    order = [F.col("x").desc(), F.col("side").asc(), F.col("q").desc()] if forward else [F.col("x").asc(), F.col("side").asc(), F.col("q").asc()]
    own = Window.partitionBy("b", *names).orderBy(*order)
    before, so_far = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, 0)
    seen = a.unionByName(b).withColumn("n", F.when(F.col("side") == 1, F.struct("r", "x")))
    seen = seen.withColumn("prior", F.last("n", ignorenulls=True).over(before))
    # Where the value changes, the row before is the nearest of another value from here on.
    changed = F.when((F.col("side") == 1) & (F.col(f"prior.r.`{use.column}`") != value), F.col("prior"))
    seen = seen.withColumn("first_", F.last("n", ignorenulls=True).over(so_far)).withColumn("second_", F.last(changed, ignorenulls=True).over(so_far))
    bound = F.col(f"l.`{BOUND}{use.var}`")
    pick = F.when(F.col(f"first_.r.`{use.column}`") != bound, F.col("first_")).otherwise(F.when(bound.isNotNull(), F.col("second_")))
    out = seen.filter("side = 0").withColumn("pick", pick)
    distance = F.col("pick.x") - F.col("x") if forward else F.col("x") - F.col("pick.x")
    near = F.coalesce((distance > 0) & (distance <= window), F.lit(False))
    return out.select("l", F.when(near, F.col("pick.r")).alias("r"))


def _as_of_new(left: DataFrame, right: DataFrame, keys: list[Use], window: int, forward: bool, members: int) -> DataFrame:
    """The same, for the nearest right row that isn't one of the group's ``members`` events.
    The anchor is never in reach of itself, so one of the nearest ``members`` rows is new.
    Each of them is a running value of one sorted frame, and pairs in the window, which are
    as many as the window's density squared, are never made."""
    width = STRETCH * max(window, 1)
    reach = F.col("x") - window if forward else F.col("x") + window
    names = [f"k{i}" for i in range(len(keys))]
    kinds = [right.schema["r"].dataType[u.column].dataType for u in keys]
    a = left.select(
        "x", "q", F.lit(0).alias("side"), *[F.col(f"l.`{BOUND}{u.var}`").cast(k).alias(n) for u, n, k in zip(keys, names, kinds, strict=True)], bucket(F.col("x"), width).alias("b"), "l", F.lit(None).cast(right.schema["r"].dataType).alias("r")
    )
    b = right.select(
        "x", "q", F.lit(1).alias("side"), *[F.col(f"r.`{u.column}`").alias(n) for u, n in zip(keys, names, strict=True)], F.explode(F.array_distinct(F.array(bucket(F.col("x"), width), bucket(reach, width)))).alias("b"), F.lit(None).cast(left.schema["l"].dataType).alias("l"), "r"
    )
    for n in names:
        b = b.filter(F.col(n).isNotNull())
    order = [F.col("x").desc(), F.col("side").asc(), F.col("q").desc()] if forward else [F.col("x").asc(), F.col("side").asc(), F.col("q").asc()]
    own = Window.partitionBy("b", *names).orderBy(*order)
    before, so_far = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, 0)
    # On a right row n0 is the row itself, n1 the right row before it, and so on.
    seen = a.unionByName(b).withColumn("n0", F.when(F.col("side") == 1, F.struct("r", "x")))
    for i in range(1, members):
        seen = seen.withColumn(f"n{i}", F.when(F.col("side") == 1, F.last(f"n{i - 1}", ignorenulls=True).over(before)))
    seen = seen.withColumns({f"n{i}": F.last(f"n{i}", ignorenulls=True).over(so_far) for i in range(members)})
    held = positions(F.col("l.m"))
    out = seen.filter("side = 0").withColumn("pick", F.coalesce(*[F.when(~F.array_contains(held, F.col(f"n{i}.r.p")), F.col(f"n{i}")) for i in range(members)]))
    distance = F.col("pick.x") - F.col("x") if forward else F.col("x") - F.col("pick.x")
    near = F.coalesce((distance > 0) & (distance <= window), F.lit(False))
    return out.select("l", F.when(near, F.col("pick.r")).alias("r"))


def _same(keys: list[Use]) -> Column:
    """The equalities of single values, plain, so that a join takes them as keys."""
    found = F.lit(True)
    for u in keys:
        found = found & (F.col(f"l.`{BOUND}{u.var}`") == F.col(f"r.`{u.column}`"))
    return found


def _test(others: list[tuple], distinct: bool) -> Column:
    """The other conditions between ``l`` and ``r``; false where a value is missing."""
    found = F.lit(True)
    for test, is_list, u in others:
        found = found & test(F.col(f"r.`{u.column}`"), F.col(f"l.`{BOUND}{u.var}`"), u.is_list, is_list)
    if distinct:
        found = found & ~F.array_contains(positions(F.col("l.m")), F.col("r.p"))
    return F.coalesce(found, F.lit(False))


def _in_reach(left: DataFrame, right: DataFrame, keys: list[Use], window: int, forward: bool) -> DataFrame:
    """Pairs within the window and with equal keys, by an equi-join on these and on
    stretches of the axis."""
    width = max(window, 1)
    reach = F.col("x") + window if forward else F.col("x") - window
    a = left.select("x", "q", "l", F.explode(F.array_distinct(F.array(bucket(F.col("x"), width), bucket(reach, width)))).alias("b"))
    b = right.select(F.col("x").alias("rx"), F.col("q").alias("rq"), "r", bucket(F.col("x"), width).alias("rb"))
    distance = F.col("rx") - F.col("x") if forward else F.col("x") - F.col("rx")
    return a.join(b, (F.col("b") == F.col("rb")) & _same(keys)).withColumn("d", distance).filter((F.col("d") > 0) & (F.col("d") <= window))


def follow(groups: Groups, rows: Rows, axis: str, window: int, forward: bool, members: int) -> Groups:
    """Each group of ``members`` events with its nearest eligible event; groups without one
    go."""
    keys, others = conditions(groups, rows)
    left, right = _sides(groups, rows, axis, forward)
    left = left.filter("x is not null")
    distinct = bool(groups.axes - {axis})
    if not others:
        for u in keys:
            left = left.filter(F.col(f"l.`{BOUND}{u.var}`").isNotNull())
        met = (_as_of_new(left, right, keys, window, forward, members) if distinct else _as_of(left, right, keys, window, forward)).filter("r is not null")
    elif not distinct and len(others) == 1 and others[0][0] is differ and not others[0][1] and not others[0][2].is_list:
        for u in keys:
            left = left.filter(F.col(f"l.`{BOUND}{u.var}`").isNotNull())
        met = _as_of_other(left, right, keys, others[0][2], window, forward).filter("r is not null")
    else:
        met = _in_reach(left, right, keys, window, forward).filter(_test(others, distinct))
        order = F.struct("d", F.col("rq") if forward else -F.col("rq"))
        met = met.groupBy(positions(F.col("l.m")).alias("g")).agg(F.min_by(F.struct("l", "r"), order).alias("n")).select("n.l", "n.r")
    m = F.concat("l.m", F.array("r.member")) if forward else F.concat(F.array("r.member"), F.col("l.m"))
    uses: dict[str, list[Use]] = {}
    for u in rows.equal:
        uses.setdefault(u.var, []).append(u)
    bound, columns = dict(groups.bound), {}
    for v, is_list in groups.bound.items():
        value = F.col(f"l.`{BOUND}{v}`")
        if is_list:  # a list settles on what this event holds
            for u in uses.get(v, ()):
                own = F.col(f"r.`{u.column}`")
                value = F.array_intersect(value, own) if u.is_list else F.array(own.cast("string"))
        columns[v] = value
    for v, us in uses.items():
        if v not in bound:
            columns[v], bound[v] = F.col(f"r.`{us[0].column}`"), us[0].is_list
    out = met.select(m.alias("m"), F.col("l.o").alias("o"), *[c.alias(BOUND + v) for v, c in columns.items()])
    return Groups(out, bound, groups.axes | {axis})


def absent(groups: Groups, rows: Rows, axis: str, window: int, forward: bool) -> Groups:
    """The groups that have no eligible event in the window. A group whose variable has no
    value excludes nothing and stays; one without an axis value goes."""
    keys, others = conditions(groups, rows, excluded=True)
    left, right = _sides(groups, rows, axis, forward)
    left = left.filter("x is not null")
    if window == 0:
        return groups.of(left.select("l.*"))
    if not others:
        known = F.lit(True)
        for u in keys:
            known = known & F.col(f"l.`{BOUND}{u.var}`").isNotNull()
        met = _as_of(left.filter(known), right, keys, window, forward).filter("r is null").select("l.*")
        return groups.of(met.unionByName(left.filter(~known).select("l.*")) if keys else met)
    width = max(window, 1)
    reach = F.col("x") - window if forward else F.col("x") + window
    a = left.withColumn("b", bucket(F.col("x"), width)).alias("a")
    b = right.select(F.col("x").alias("rx"), "r", F.explode(F.array_distinct(F.array(bucket(F.col("x"), width), bucket(reach, width)))).alias("rb"))
    distance = F.col("rx") - F.col("x") if forward else F.col("x") - F.col("rx")
    near = (F.col("b") == F.col("rb")) & _same(keys) & (distance > 0) & (distance <= window) & _test(others, False)
    return groups.of(a.join(b, near, "left_anti").select("l.*"))
