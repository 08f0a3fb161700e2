"""The shapes that operators pass on.

Rows: one event each, with ``p`` (position), ``t`` (microseconds, may be null), ``member``
(what a group keeps of the event) and the columns of its variables. Groups: one group
each, with ``m`` (members in slot order), ``o`` (sort key of the natural order) and the
columns of bound variables.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOUND = "v_"


@dataclass(frozen=True)
class Use:
    """A variable on a field of one event."""

    var: str
    column: str
    is_list: bool


@dataclass(frozen=True)
class Rows:
    """The matches of one leg. ``also`` names, for each leg of a comma row, the column that
    says whether the event could stand there too; empty if that isn't known."""

    df: DataFrame
    equal: tuple[Use, ...] = ()
    unequal: tuple[Use, ...] = ()
    also: tuple[str, ...] = ()


@dataclass(frozen=True)
class Groups:
    """Groups; ``bound`` says which variables are lists; ``axes`` what has ordered them."""

    df: DataFrame
    bound: dict[str, bool] = field(default_factory=dict)
    axes: frozenset[str] = frozenset()

    def of(self, df: DataFrame) -> Groups:
        """The same with another frame."""
        return replace(self, df=df)


def agree(a: Column, b: Column, a_list: bool, b_list: bool) -> Column:
    """Equal values, a list that holds the other's value, or lists that share one."""
    if a_list and b_list:
        return F.arrays_overlap(a, b)
    if a_list:
        return F.array_contains(a, b.cast("string"))
    if b_list:
        return F.array_contains(b, a.cast("string"))
    return a == b


def differ(a: Column, b: Column, a_list: bool, b_list: bool) -> Column:
    """Both values are there and don't agree."""
    if not a_list and not b_list:
        return a != b
    return ~F.coalesce(agree(a, b, a_list, b_list), F.lit(False)) & a.isNotNull() & b.isNotNull()


def singles(rows: Rows, axis: str = "p") -> Groups:
    """One group per event; variables are bound to their first use."""
    first: dict[str, Use] = {}
    for u in rows.equal:
        first.setdefault(u.var, u)
    df = rows.df.select(
        F.array("member").alias("m"),
        F.struct(F.col(axis).alias("a"), F.col("p").alias("p")).alias("o"),
        *[F.col(u.column).alias(BOUND + v) for v, u in first.items()],
    )
    return Groups(df, {v: u.is_list for v, u in first.items()})


def positions(m: Column) -> Column:
    """The positions of members, in slot order."""
    return F.transform(m, lambda x: x["p"])


def bucket(x: Column, width: int) -> Column:
    """Whole-number division that rounds down."""
    w = F.lit(width).cast("long")
    return F.call_function("div", x - F.pmod(x, w), w)
