"""From a prepared tree to one DataFrame. Nothing is collected on the way, except what a
guard must know (whether there is any time, what the authors are called)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from strideq.errors import QueryError
from strideq.functions.times import moment_us
from strideq.operators import aggregate as A
from strideq.operators import cooccur, group_links, links
from strideq.operators.frames import BOUND, Groups, Rows, Use, agree, differ, singles
from strideq.operators.runs import runs
from strideq.plans.ir import Between, Link, Moment, Query, Run, Span, Stages
from strideq.plans.passes import DEFAULT_WINDOW, has_run, prepared, sequence
from strideq.plans.predicates import MENTIONED, Predicates
from strideq.sources.corpus import Corpus

AXIS = {"position": "p", "time": "t"}


@dataclass(frozen=True)
class Planned:
    """A planned query: groups, or a frame with ``value`` (and ``key``)."""

    kind: str  # "groups", "grouped" or "aggregate"
    df: DataFrame
    groups: Groups | None = None
    names: tuple[str | None, ...] = ()
    is_ordered: bool = False


class Planner:
    """Plans queries over one corpus."""

    def __init__(self, corpus: Corpus, dictionaries: dict, now_us: int):
        self.corpus, self.now_us = corpus, now_us
        self.predicates = Predicates(corpus, dictionaries)
        self.fields: list[str] = []

    def plan(self, query: Query) -> Planned:
        """The plan of a whole query."""
        q = prepared(query, self.corpus.spec.quantifier_ceiling)
        wanted = [f for _, f in q.group] + ([q.aggregate[1]] if q.aggregate and q.aggregate[1] else []) + (list(q.order[0]) if q.order else []) + self._inner_fields(q)
        self.fields = [f for f in dict.fromkeys(wanted) if self.corpus.has(f)]
        groups, names = self.body(q)
        kinds: dict[str, DataType] = {f: self.corpus.schema[f].dataType for f in self.fields}
        unit = self.corpus.spec.time_unit
        df = groups.df
        if q.group:
            df = A.keys(groups, q.group, kinds, unit)
        if q.aggregate:
            return Planned("aggregate", A.aggregate(df, *q.aggregate, kinds, bool(q.group), unit))
        if q.group:
            return Planned("grouped", df, groups, names)
        df, in_order = self.cut(df, q, kinds)
        return Planned("groups", df, groups.of(df), names, in_order)

    def _inner_fields(self, q: Query) -> list[str]:
        if not isinstance(q.source, Stages):
            return []
        found = []
        for inner in (q.source.head, *[n.query for n in q.source.rest]):
            found += (list(inner.order[0]) if inner.order else []) + self._inner_fields(inner)
        return found

    def cut(self, df: DataFrame, q: Query, kinds: dict[str, DataType]) -> tuple[DataFrame, bool]:
        """ORDER BY and LIMIT."""
        if q.order:
            df = A.ordered(df, *q.order, kinds)
        if q.limit:
            df = (df if q.order else df.orderBy("o")).offset(q.limit[1]).limit(q.limit[0])
        return df, bool(q.order)

    # -- legs -----------------------------------------------------------------
    def rows(self, e, leg: int = 0, legs: tuple = ()) -> Rows:
        """The events that match a condition and keep its own-event variables; for each of
        ``legs``, other conditions with the same variables, whether the event matches it."""
        c, p = self.corpus, self.predicates
        df = c.df.filter(p.column(e))
        uses, value = p.variables(e), {}
        for var, name, _ in uses:
            if name == MENTIONED:
                value[name] = p.mentions()
            elif not c.has(name):
                raise QueryError(f"${var} is bound to {name!r}, which no event has")
            else:
                value[name] = F.col(f"`{name}`")
        is_list = {name: name == MENTIONED or c.is_list(name) for name in value}
        bound = {v: n for v, n, neg in reversed(uses) if not neg}
        equal, unequal = [], []
        for v, n, neg in uses:
            if neg and v in bound:  # on the event itself
                df = df.filter(F.coalesce(differ(value[n], value[bound[v]], is_list[n], is_list[bound[v]]), F.lit(False)))
            elif neg:
                unequal.append(Use(v, "u_" + n, is_list[n]))
            else:
                if bound[v] != n:
                    df = df.filter(F.coalesce(agree(value[n], value[bound[v]], is_list[n], is_list[bound[v]]), F.lit(False)))
                equal.append(Use(v, "u_" + n, is_list[n]))
        member = F.struct(
            F.col("position").alias("p"),
            F.col(f"`{c.spec.id}`").alias("id"),
            F.col("t_us").alias("t"),
            F.lit(leg).alias("leg"),
            *[F.col(f"`{f}`").alias(A.kept(f)) for f in self.fields],
        )
        df = df.select(F.col("position").alias("p"), F.col("t_us").alias("t"), member.alias("member"), *[v.alias("u_" + n) for n, v in value.items()], *[(F.lit(True) if k == leg else p.column(x)).alias(f"also_{k}") for k, x in enumerate(legs)])
        return Rows(df, tuple(equal), tuple(unequal), tuple(f"also_{k}" for k in range(len(legs))))

    def axis(self, window: Span) -> str:
        """The axis column of a window; time must be there to be measured."""
        if window.axis == "time":
            self.corpus.require_time("DURING")
        return AXIS[window.axis]

    # -- sequences ------------------------------------------------------------
    def chain(self, e) -> tuple[Groups, list[int]]:
        """Groups of a chain of links, and its leg numbers in slot order."""
        if not isinstance(e, Link):
            rows = self.rows(e, 0)
            if rows.unequal:
                raise QueryError(f"!${rows.unequal[0].var} refers to a variable that no earlier event binds")
            return singles(rows), [0]
        left, slots = self.chain(e.left)
        axis = self.axis(e.window)
        if e.negative:
            return links.absent(left, self.rows(e.right), axis, e.window.size, e.forward), slots
        if not isinstance(e.left, Link) or e.left.negative:
            left = left.of(left.df.withColumn("o", F.struct(F.element_at("m", 1)[axis].alias("a"), F.element_at("m", 1)["p"].alias("p"))))
        leg = len(slots)
        out = links.follow(left, self.rows(e.right, leg), axis, e.window.size, e.forward, leg)
        return out, [*slots, leg] if e.forward else [leg, *slots]

    def side(self, e) -> tuple[Groups, tuple[Use, ...]]:
        """One side of a link with a run: groups, and the conditions that compare with the
        other side."""
        if isinstance(e, Run):
            rows = self.rows(e.body)
            if rows.unequal:
                raise QueryError(f"!${rows.unequal[0].var} can't stand in a run")
            return runs(rows, self.axis(e.step), e.step.size, e.least, e.most), ()
        rows = self.rows(e)
        groups = singles(rows)
        extra = [F.col(u.column).alias(f"ne_{u.var}_{u.column}") for u in rows.unequal]
        if extra:
            first = {}
            for u in rows.equal:
                first.setdefault(u.var, u)
            groups = groups.of(rows.df.select(F.array("member").alias("m"), F.struct(F.col("p").alias("a"), F.col("p").alias("p")).alias("o"), *[F.col(u.column).alias(BOUND + v) for v, u in first.items()], *extra))
        return groups, rows.unequal

    def run_link(self, e: Link) -> Groups:
        """A link with a run on a side."""
        left, l_ne = self.side(e.left)
        right, r_ne = self.side(e.right)
        unequal = [(s, f"ne_{u.var}_{u.column}", u.is_list, u.var) for s, us in (("l", l_ne), ("r", r_ne)) for u in us]
        return group_links.link(left, right, self.axis(e.window), e.window.size, e.forward, e.negative, unequal)

    # -- bodies ---------------------------------------------------------------
    def body(self, q: Query) -> tuple[Groups, tuple[str | None, ...]]:
        """Source, whole span and time filter of a query body."""
        names: tuple[str | None, ...] = ()
        window = q.window
        if isinstance(q.source, Stages):
            groups, window = self.stages(q.source, window)
        else:
            items = q.source.items
            names = tuple(i.name for i in items)
            one = items[0]
            if len(items) == 1 and (isinstance(one.body, Link) and has_run(one.body)):
                groups = self.run_link(one.body)
            elif len(items) == 1 and isinstance(one.body, Run):
                groups, _ = self.side(one.body)
            elif len(items) == 1 and sequence(one.body):
                groups, slots = self.chain(one.body)
            elif len(items) == 1 and (one.least, one.most) == (1, 1):
                groups = self.lone(one.body)
                if window and window.axis == "time":
                    self.axis(window)
                    groups = groups.of(groups.df.filter(F.element_at("m", 1)["t"].isNotNull()))
                window = None
            else:
                span = window or Span("position", DEFAULT_WINDOW)
                alike = self.alike([i.body for i in items])
                legs = [(self.event_set(i.body, k, alike), i.least, i.most) for k, i in enumerate(items)]
                groups, window = cooccur.ranges(legs, self.axis(span), span.size), None
        if window:  # the whole group's span
            axis = self.axis(window)
            at = F.transform("m", lambda x: x[axis])
            fits = ~F.exists(at, lambda x: x.isNull()) & (F.array_max(at) - F.array_min(at) <= window.size)
            groups = groups.of(groups.df.filter(fits))
        if q.times:
            groups = groups.of(self.in_time(groups.df, q.times))
        return groups, names

    def lone(self, e) -> Groups:
        """One group per match."""
        if isinstance(e, Link):
            return self.chain(e)[0]
        rows = self.rows(e)
        if rows.unequal:
            raise QueryError(f"!${rows.unequal[0].var} refers to a variable that no earlier event binds")
        return singles(rows)

    def alike(self, bodies: list) -> tuple:
        """The conditions of a comma row, if whether an event could stand in another's place is
        known from the event alone: all are conditions, with the same variables of single
        values on the same fields. Else none."""
        if any(isinstance(e, Link) for e in bodies):
            return ()
        uses = [self.predicates.variables(e) for e in bodies]
        first = uses[0]
        simple = len({v for v, _, _ in first}) == len(first) and not any(neg or n == MENTIONED or self.corpus.is_list(n) for _, n, neg in first)
        return tuple(bodies) if simple and all(sorted(u) == sorted(first) for u in uses) else ()

    def event_set(self, e, leg: int, legs: tuple = ()) -> Rows:
        """A comma item as rows; a NOT_ link is the set of its left events."""
        if not isinstance(e, Link):
            return self.rows(e, leg, legs)
        g = self.chain(e)[0]
        df = g.df.select(F.element_at("m", 1).alias("member"), *[F.col(BOUND + v).alias("u_" + v) for v in g.bound])
        df = df.select(F.col("member.p").alias("p"), F.col("member.t").alias("t"), F.col("member").withField("leg", F.lit(leg)).alias("member"), *["u_" + v for v in g.bound])
        return Rows(df, tuple(Use(v, "u_" + v, is_list) for v, is_list in g.bound.items()))

    def stages(self, s: Stages, window: Span | None) -> tuple[Groups, Span | None]:
        """Subqueries, and the window that is left for the whole. Variables don't cross."""
        parts = [self.inner(s.head), *[self.inner(n.query) for n in s.rest]]
        if not s.rest:
            if window is None or window.axis == "time":
                return parts[0], window
            return cooccur.groups_together(parts, AXIS[window.axis], window.size), None
        if s.rest[0].link is None:
            span = window or Span("position", DEFAULT_WINDOW)
            return cooccur.groups_together(parts, self.axis(span), span.size), None
        found = parts[0]
        for n, right in zip(s.rest, parts[1:], strict=True):
            found = group_links.link(found, right, self.axis(n.link.window), n.link.window.size, n.link.forward, n.link.negative)
        return found, window

    def inner(self, q: Query) -> Groups:
        """A subquery's groups, without its variables."""
        groups, _ = self.body(q)
        df, _ = self.cut(groups.df, q, {f: self.corpus.schema[f].dataType for f in self.fields})
        return Groups(df.select("m", "o"), {}, groups.axes)

    def in_time(self, df: DataFrame, b: Between) -> DataFrame:
        """Members outside the times go, and groups of which nothing is left."""
        self.corpus.require_time("a time filter")

        def fits(x: Column) -> Column:
            ok = x["t"].isNotNull()
            for moment, is_low in ((b.low, True), (b.high, False)):
                if moment is None:
                    continue
                us = F.lit(self.us(moment)).cast("long")
                if b.inclusive:
                    ok = ok & ((x["t"] >= us) if is_low else (x["t"] <= us))
                else:
                    ok = ok & ((x["t"] > us) if is_low else (x["t"] < us))
            return ok

        return df.withColumn("m", F.filter("m", fits)).filter(F.size("m") > 0)

    def us(self, m: Moment) -> int:
        """A moment in microseconds."""
        return self.now_us - m.ago if m.text is None else moment_us(m.text)
