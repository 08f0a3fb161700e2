"""The one tree that both surface syntaxes become."""

from __future__ import annotations

from dataclasses import dataclass

#: Microseconds of a unit; months and years only move a point in time.
UNIT_US = {
    "seconds": 1_000_000,
    "minutes": 60_000_000,
    "hours": 3_600_000_000,
    "days": 86_400_000_000,
    "weeks": 604_800_000_000,
    "months": 30 * 86_400_000_000,
    "years": 365 * 86_400_000_000,
}


def unit_of(word: str) -> str:
    """The full plural of a unit's spelling."""
    w = word.lower()
    for name in UNIT_US:
        if w in (name, name[:-1]) or w == name[0] and name not in ("months", "years"):
            return name
    raise KeyError(word)


@dataclass(frozen=True)
class Span:
    """A window: so many positions, or so many microseconds."""

    axis: str  # "position" or "time"
    size: int


@dataclass(frozen=True)
class Var:
    """``$name``, or ``!$name`` for a value that differs."""

    name: str
    negated: bool = False


@dataclass(frozen=True)
class Anything:
    """``*``"""


@dataclass(frozen=True)
class Leaf:
    """A predicate on one event: its kind and arguments (texts, Var or Anything)."""

    kind: str
    args: tuple = ()


@dataclass(frozen=True)
class Not:
    body: object


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


@dataclass(frozen=True)
class Link:
    """``left`` and the nearest ``right`` after (forward) or before it; or, negative,
    the left events without one."""

    forward: bool
    negative: bool
    left: object
    right: object
    window: Span | None = None


@dataclass(frozen=True)
class Run:
    """Maximal runs of ``body`` whose neighbours are at most ``step`` apart."""

    body: object
    least: int
    most: int | None
    step: Span | None = None


@dataclass(frozen=True)
class Item:
    """One place of a comma row."""

    body: object
    least: int = 1
    most: int | None = 1
    name: str | None = None


@dataclass(frozen=True)
class Row:
    items: tuple[Item, ...]


@dataclass(frozen=True)
class Next:
    """A further subquery; without ``link`` its order doesn't matter."""

    query: Query
    link: Link | None = None


@dataclass(frozen=True)
class Stages:
    head: Query
    rest: tuple[Next, ...] = ()


@dataclass(frozen=True)
class Moment:
    """A point in time: its text, or microseconds before now."""

    text: str | None = None
    ago: int | None = None


@dataclass(frozen=True)
class Between:
    """Members strictly after ``low`` and before ``high``, or inclusive."""

    low: Moment | None
    high: Moment | None
    inclusive: bool = False


@dataclass(frozen=True)
class Query:
    source: Row | Stages
    window: Span | None = None
    times: Between | None = None
    group: tuple[tuple[str | None, str], ...] = ()  # (unit or None, field)
    aggregate: tuple[str, str | None] | None = None
    order: tuple[tuple[str, ...], bool] | None = None
    limit: tuple[int, int] | None = None
