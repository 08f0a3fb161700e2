"""Unordered co-occurrence within a window, quantifiers, and whole groups together.

A partial match grows leg by leg. The join is on stretches of the axis as wide as the
window; a partial match that spans [lo, hi] can only take an event in [hi - w, lo + w].

Matches may be as many as the square of the events in a window, so they are not exchanged:
of those with the same events one is told by looking at it, and goes where it was made.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideq.errors import QueryError
from strideq.operators.frames import BOUND, Groups, Rows, Use, agree, bucket, differ, positions


def _grown(part: DataFrame, other: DataFrame, window: int, keys: list[tuple[str, str]] | None = None) -> DataFrame:
    """Partial matches (lo, hi, ...) with every ``other`` (x_lo, x_hi, ...) in reach whose
    key columns are equal."""
    width = max(window, 1)
    first, last = bucket(F.col("hi") - window, width), bucket(F.col("lo") + window, width)
    a = part.filter("hi - lo <= %d" % window).withColumn("b", F.explode(F.sequence(first, last)))
    b = other.withColumn("b", bucket(F.col("x_lo"), width))
    span = F.greatest("hi", "x_hi") - F.least("lo", "x_lo")
    same = reduce(lambda c, k: c & (F.col(k[0]) == F.col(k[1])), keys or [], F.col("b") == F.col("other_b"))
    return a.join(b.withColumnRenamed("b", "other_b"), same).drop("b", "other_b").filter(span <= window)


#: Places of which all orders are tried; more of them take an exchange of the matches.
MOST_PLACES = 4


def _first_of_its_set(at: list[int]) -> Column:
    """Of the matches that have the same events, true for the one whose positions come first
    in the order of the places, which belong to legs ``at``. Events could change places if each
    matches the other's leg (columns ``also{place}_{leg}``); events of one leg are in order."""
    found = F.lit(True)
    for order in permutations(range(len(at))):
        moved = [i for i, k in enumerate(order) if at[i] != at[k]]
        if moved:
            i = next(i for i, k in enumerate(order) if i != k)
            could = reduce(lambda a, b: a & b, [F.col(f"also{order[i]}_{at[i]}") for i in moved])
            found = found & ~(could & (F.col(f"p{order[i]}") < F.col(f"p{i}")))
    return found


def together(legs: list[tuple[Rows, int]], axis: str, window: int) -> Groups:
    """One event of each leg (so many copies of each), all distinct and within the window;
    matches of the same events count once."""
    places: list[tuple[Rows, bool]] = [(rows, copy > 0) for rows, n in legs for copy in range(n)]
    at = [k for k, (_, n) in enumerate(legs) for _ in range(n)]
    known = len(places) <= MOST_PLACES and all(rows.also for rows, _ in legs)
    uses: list[list[Use]] = []
    part: DataFrame | None = None
    for i, (rows, again) in enumerate(places):
        own = rows.df.filter(F.col(axis).isNotNull())
        cols = {u.column for u in (*rows.equal, *rows.unequal)}
        one = own.select(F.col(axis).alias("x_lo"), F.col(axis).alias("x_hi"), F.col("p").alias(f"p{i}"), F.col("member").alias(f"m{i}"), *[F.col(c).alias(f"c{i}_{c}") for c in cols], *[F.col(c).alias(f"also{i}_{k}") for k, c in enumerate(rows.also if known else ())])
        if part is None:
            part = one.withColumnsRenamed({"x_lo": "lo", "x_hi": "hi"})
        else:
            # A variable of single values is a join key beside the stretch, from the first leg
            # on that has it again.
            earlier = {u.var: u.column for us in reversed(uses) for u in us if not u.is_list}
            keys = [(earlier[u.var], f"c{i}_{u.column}") for u in rows.equal if not u.is_list and u.var in earlier]
            met = _grown(part, one, window, keys)
            met = met.filter(reduce(lambda a, b: a & b, [F.col(f"p{i}") != F.col(f"p{k}") for k in range(i)]))
            met = met.filter(F.col(f"p{i}") > F.col(f"p{i - 1}")) if again else met
            part = met.withColumns({"lo": F.least("lo", "x_lo"), "hi": F.greatest("hi", "x_hi")}).drop("x_lo", "x_hi")
        uses.append([Use(u.var, f"c{i}_{u.column}", u.is_list) for u in rows.equal])
    # One value for each variable, read before members are sorted.
    by_var: dict[str, list[Use]] = {}
    for us in uses:
        for u in us:
            by_var.setdefault(u.var, []).append(u)
    bound: dict[str, bool] = {}
    values: dict[str, Column] = {}
    for v, us in by_var.items():
        single, lists = [u for u in us if not u.is_list], [u for u in us if u.is_list]
        if single:
            for u in [*single[1:], *lists]:
                part = part.filter(agree(F.col(u.column), F.col(single[0].column), u.is_list, False))
            values[v], bound[v] = F.col(single[0].column), False
        else:
            shared = reduce(F.array_intersect, [F.col(u.column) for u in lists])
            part = part.filter(F.size(shared) > 0) if len(lists) > 1 else part
            values[v], bound[v] = shared, True
        part = part.filter(values[v].isNotNull()) if len(us) > 1 else part
    for i, (rows, _) in enumerate(places):
        for u in rows.unequal:
            if u.var not in values:
                raise QueryError(f"!${u.var} refers to a variable that no other event binds")
            part = part.filter(differ(F.col(f"c{i}_{u.column}"), values[u.var], u.is_list, bound[u.var]))
    if known:
        part = part.filter(_first_of_its_set(at))
    every = [F.struct(F.col(f"m{i}")[axis].alias("a"), F.col(f"m{i}.p").alias("p"), F.col(f"m{i}").alias("x")) for i in range(len(places))]
    columns = [c.alias(BOUND + v) for v, c in values.items()]
    if len(places) == 2:  # the most frequent case, without a sort for each match
        a, b = every
        part = part.withColumn("turned_", (b["a"] < a["a"]) | ((b["a"] == a["a"]) & (b["p"] < a["p"])))
        pair = [F.when(F.col("turned_"), b).otherwise(a), F.when(F.col("turned_"), a).otherwise(b)]
        out = part.select(F.array(*[x["x"] for x in pair]).alias("m"), F.array(*[F.struct(x["a"].alias("a"), x["p"].alias("p")) for x in pair]).alias("o"), *columns)
    else:
        part = part.select(F.sort_array(F.array(*every)).alias("s"), *columns)
        out = part.select(F.transform("s", lambda x: x["x"]).alias("m"), F.transform("s", lambda x: F.struct(x["a"].alias("a"), x["p"].alias("p"))).alias("o"), *[BOUND + v for v in values])
    if len(places) > 1 and (len(legs) > 1 or values) and not known:
        out = distinct_sets(out)
    return Groups(out, bound, frozenset({axis}))


def distinct_sets(df: DataFrame) -> DataFrame:
    """One group for each set of members."""
    return df.withColumn("set_", F.sort_array(positions(F.col("m")))).dropDuplicates(["set_"]).drop("set_")


def ranges(legs: list[tuple[Rows, int, int]], axis: str, window: int) -> Groups:
    """All sizes in the quantifiers' ranges, matches of the same events once."""
    found = [together([(rows, n) for (rows, _, _), n in zip(legs, sizes, strict=True)], axis, window) for sizes in product(*[range(lo, hi + 1) for _, lo, hi in legs])]
    if len(found) == 1:
        return found[0]
    df = reduce(lambda a, b: a.unionByName(b), [g.df for g in found])
    # Matches of different sizes are never of the same events.
    totals = [sum(sizes) for sizes in product(*[range(lo, hi + 1) for _, lo, hi in legs])]
    return found[0].of(distinct_sets(df) if len(set(totals)) < len(totals) else df)


def _bounds(groups: Groups, axis: str) -> DataFrame:
    at = F.transform("m", lambda x: x[axis])
    return groups.df.select("m", F.array_min(at).alias("x_lo"), F.array_max(at).alias("x_hi"), F.exists(at, lambda x: x.isNull()).alias("gap")).filter("not gap").drop("gap")


def groups_together(parts: list[Groups], axis: str, window: int) -> Groups:
    """One group of each part, without common members, the whole within the window."""
    part = _bounds(parts[0], axis).withColumnsRenamed({"x_lo": "lo", "x_hi": "hi"}).filter(F.col("hi") - F.col("lo") <= window)
    for other in parts[1:]:
        met = _grown(part, _bounds(other, axis).withColumnRenamed("m", "n"), window)
        met = met.filter(~F.arrays_overlap(positions(F.col("m")), positions(F.col("n"))))
        part = met.select(F.concat("m", "n").alias("m"), F.least("lo", "x_lo").alias("lo"), F.greatest("hi", "x_hi").alias("hi"))
    every = F.sort_array(F.transform("m", lambda x: F.struct(x[axis].alias("a"), x["p"].alias("p"), x.alias("x"))))
    part = part.select(every.alias("s"))
    out = part.select(F.transform("s", lambda x: x["x"]).alias("m"), F.transform("s", lambda x: F.struct(x["a"].alias("a"), x["p"].alias("p"))).alias("o"))
    return Groups(distinct_sets(out), {}, frozenset({axis}))
