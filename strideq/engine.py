"""The engine: one corpus, dictionaries, and queries in either syntax."""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideq.errors import ConfigError, QueryError
from strideq.operators.frames import BOUND
from strideq.plans.ir import Query
from strideq.plans.planner import Planned, Planner
from strideq.plans.syntax import parse
from strideq.sources.corpus import Corpus, CorpusSpec


@dataclass
class Result:
    """Groups of ids; ``names`` by slot leg, ``bindings`` of variables by group."""

    groups: list[list[Any]]
    names: tuple[str | None, ...] = ()
    bindings: list[dict[str, Any]] = field(default_factory=list)


@dataclass
class Grouped:
    """Groups of ids by key."""

    groups: dict[str, list[list[Any]]]

    @property
    def counts(self) -> dict[str, int]:
        """Number of groups by key."""
        return {k: len(v) for k, v in self.groups.items()}


@dataclass
class Aggregate:
    """One value, or one by key."""

    value: Any = None
    by_key: dict[str, Any] | None = None


class Engine:
    """Runs queries over one corpus."""

    def __init__(self, corpus: Corpus | DataFrame, spec: CorpusSpec | None = None, dictionaries: dict | None = None, dialect: str = "auto"):
        self.corpus = corpus if isinstance(corpus, Corpus) else Corpus(corpus, spec)
        self.dictionaries = {**self.corpus.spec.dictionaries, **(dictionaries or {})}
        self.dialect = dialect

    # -- configuration --------------------------------------------------------
    @classmethod
    def from_config(cls, spark: SparkSession, config: dict) -> Engine:
        """An engine from a dictionary: ``corpus`` (path, format), CorpusSpec's settings,
        ``dictionaries``, ``dialect``. Unknown keys are errors."""
        from strideq.sources.ingest import load_table

        known = {"corpus", "dictionaries", "dialect", *CorpusSpec.__dataclass_fields__}
        unknown = set(config) - known
        if unknown:
            raise ConfigError(f"unknown settings: {', '.join(sorted(unknown))}")
        if "corpus" not in config:
            raise ConfigError("a configuration names its corpus")
        settings = {k: v for k, v in config.items() if k in CorpusSpec.__dataclass_fields__ and k != "dictionaries"}
        if "text_fields" in settings:
            settings["text_fields"] = tuple(settings["text_fields"])
        spec = CorpusSpec(**settings)
        return cls(load_table(spark, config["corpus"], spec), dictionaries=config.get("dictionaries"), dialect=config.get("dialect", "auto"))

    def add_dictionary(self, name: str, terms: list[str], match: str | None = None) -> None:
        """Add or replace a dictionary."""
        if match not in (None, "stem", "token", "substring"):
            raise ConfigError(f"unknown match mode {match!r}")
        self.dictionaries[name] = {"terms": list(terms), "match": match} if match else list(terms)

    def remove_dictionary(self, name: str) -> None:
        """Forget a dictionary."""
        if name not in self.dictionaries:
            raise ConfigError(f"no dictionary {name!r}")
        del self.dictionaries[name]

    def get_dictionaries(self) -> dict:
        """All dictionaries."""
        return dict(self.dictionaries)

    # -- queries --------------------------------------------------------------
    def to_ir(self, query: str) -> Query:
        """The tree of a query."""
        return parse(query, self.dialect)

    def planned(self, query: str | Query, dictionaries: dict | None = None, now_us: int | None = None) -> Planned:
        """The plan with what is known about it. ``dictionaries`` add to the engine's for
        this query alone; ``now_us`` is what relative times count from."""
        q = self.to_ir(query) if isinstance(query, str) else query
        own = {**self.dictionaries, **(dictionaries or {})}
        return Planner(self.corpus, own, time.time_ns() // 1000 if now_us is None else now_us).plan(q)

    def plan(self, query: str | Query, **options) -> DataFrame:
        """A lazy DataFrame: groups (``ids``, ``positions``, variables), or an aggregate."""
        p = self.planned(query, **options)
        if p.kind == "aggregate":
            return p.df
        bound = [c for c in p.df.columns if c.startswith(BOUND)]
        key = ["key"] if p.kind == "grouped" else []
        return p.df.select(*key, F.transform("m", lambda x: x["id"]).alias("ids"), F.transform("m", lambda x: x["p"]).alias("positions"), *bound)

    def wide(self, query: str | Query, slots: int, **options) -> DataFrame:
        """Positions of groups as columns p0, p1, ...; null where a group is shorter."""
        p = self.planned(query, **options)
        return p.df.select(*[F.get("m", F.lit(i))["p"].alias(f"p{i}") for i in range(slots)])

    def long(self, query: str | Query, **options) -> DataFrame:
        """A row per member: group, slot, position, id. Numbering the groups needs a global
        order, so this is for results that are looked at."""
        p = self.planned(query, **options)
        if p.kind != "groups":
            raise QueryError("only groups have members")
        bound = [c for c in p.df.columns if c.startswith(BOUND)]
        n = F.row_number().over(Window.orderBy("o")) - 1
        return p.df.withColumn("group", n).select("group", F.posexplode("m").alias("slot", "x"), *bound).select("group", "slot", F.col("x.p").alias("position"), F.col("x.id").alias("id"), *bound)

    def execute(self, query: str | Query, **options) -> Result | Grouped | Aggregate:
        """The answer as Python values, in natural order unless the query orders."""
        p = self.planned(query, **options)
        if p.kind == "aggregate":
            rows = p.df.collect()
            if "key" in p.df.columns:
                return Aggregate(by_key={r["key"]: r["value"] for r in rows})
            return Aggregate(rows[0]["value"] if rows else None)
        df = p.df if p.is_ordered else p.df.orderBy("o", F.transform("m", lambda x: x["p"]))
        rows = df.select(*(["key"] if p.kind == "grouped" else []), "m", *[c for c in df.columns if c.startswith(BOUND)]).collect()
        ids = [[x["id"] for x in r["m"]] for r in rows]
        if p.kind == "grouped":
            found: dict[str, list] = {}
            for r, own in zip(rows, ids, strict=True):
                found.setdefault(r["key"], []).append(own)
            return Grouped(found)
        bound = [c for c in df.columns if c.startswith(BOUND)]
        return Result(ids, p.names, [{c[len(BOUND) :]: r[c] for c in bound} for r in rows] if bound else [])

    def page(self, query: str | Query, offset: int = 0, limit: int = 50, order: str = "position", reverse: bool = False, **options) -> list[list[Any]]:
        """Groups ``offset`` to ``offset + limit`` in a display order: the query's own, or by
        ``size``, largest first and equal ones in the query's order; ``reverse`` turns either
        around. What is fetched is the page."""
        if order not in ("position", "size"):
            raise ConfigError(f"unknown display order {order!r}: position or size")
        p = self.planned(query, **options)
        if p.kind != "groups":
            raise QueryError("only groups have pages")
        df = p.df
        if p.is_ordered:
            df = df.withColumn("at_", F.monotonically_increasing_id())  # a sorted frame
            own = [F.col("at_")]
        else:
            own = [F.col("o"), F.transform("m", lambda x: x["p"])]
        size = [F.desc(F.size("m"))] if order == "size" else []
        down = [F.asc(F.size("m"))] if order == "size" else []
        keys = [*down, *[c.desc() for c in own]] if reverse else [*size, *own]
        rows = df.orderBy(*keys).offset(max(0, offset)).limit(max(0, limit)).select(F.transform("m", lambda x: x["id"]).alias("ids")).collect()
        return [list(r["ids"]) for r in rows]

    def with_spec(self, **changes) -> Engine:
        """The same corpus with other settings."""
        spec = replace(self.corpus.spec, **changes)
        return Engine(Corpus(self.corpus.df.drop("t_us"), spec), dictionaries=self.dictionaries, dialect=self.dialect)

    def validate(self, query: str) -> list:
        """Findings about a query: errors, warnings and notes with codes."""
        from strideq.plans.validate import validate

        return validate(query, self)
