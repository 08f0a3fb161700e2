"""A corpus: one ordered table of events, and what is known about it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from strideq.errors import CorpusError, QueryError
from strideq.functions.times import micros
from strideq.sources.storage import written


@dataclass(frozen=True)
class CorpusSpec:
    """Names and settings of a corpus."""

    id: str = "id"
    time: str | None = "timestamp"
    time_unit: str | None = "s"
    user: str = "user"
    text_fields: tuple[str, ...] = ("text", "content", "message")
    text_match: str = "stem"
    tokenizer: str | Callable[[str], list[str]] = "unicode"
    language: str = "english"
    dictionaries: dict = field(default_factory=dict)
    quantifier_ceiling: int | None = None
    embedding: str = "emb"
    embedding_model: str | None = None
    embedder: Callable[[list[str]], list[list[float]]] | None = None
    feature_names: tuple[str, ...] = ()
    most_names: int = 5000


#: The column that says where a row was read; it goes when positions are assigned.
PLACE = "place_"


def placed(df: DataFrame, source: int = 0) -> DataFrame:
    """``df`` with ``PLACE``: the number of its source, the file, the split and the place in
    it. Files are in the order of their names. Spark deals splits to tasks by size, so the
    order in which rows arrive is not the order of the files. A frame that isn't read from
    files has the order of its partitions."""
    if PLACE in df.columns:
        return df
    nth = F.monotonically_increasing_id()
    try:
        meta = df.metadataColumn("_metadata")
        out = df.withColumn(PLACE, F.struct(F.lit(source).alias("source"), meta["file_path"].alias("file"), meta["file_block_start"].alias("at"), nth.alias("nth")))
        out.schema  # noqa: B018  (resolves the column)
        return out
    except AnalysisException:
        return df.withColumn(PLACE, F.struct(F.lit(source).alias("source"), F.lit("").alias("file"), F.lit(0).cast("long").alias("at"), nth.alias("nth")))


def numbered(df: DataFrame, order: list[Column] | None = None, name: str = "position", then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``df`` with a dense position from 0, by ``order`` (or as the files are, see
    ``placed``). ``then`` adds columns row by row when rows are in order: they are neither
    sorted nor made for the sample of the order's ranges.

    Rows are range-partitioned and sorted, and written with their partition and place in
    it; a position is the place plus the rows of the partitions before, of which there is
    one number per partition. No task sees all rows, and rows are written once.
    """
    if order is None:
        df = placed(df)
        order = [F.col(PLACE)]
    ordered = df.orderBy(*order).drop(PLACE)
    ordered = ordered.withColumn("part_", F.spark_partition_id()).withColumn("nth_", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    kept = written(then(ordered) if then else ordered, "placed")
    counts = {r["part_"]: r["n"] for r in kept.groupBy("part_").agg(F.count(F.lit(1)).alias("n")).collect()}
    base, before = [], 0
    for part in range(max(counts, default=-1) + 1):
        base.append(before)
        before += counts.get(part, 0)
    at = F.get(F.lit(base or [0]).cast("array<bigint>"), F.col("part_")) + F.col("nth_")
    return kept.withColumn(name, at).drop("part_", "nth_")


#: The annotation columns and their types.
ANNOTATIONS = {"is_question": "boolean", "has_link": "boolean", "mentions": "array<string>", "entities": "array<string>"}


def is_annotation(field: StructField) -> bool:
    """Whether an annotation wrote a column: it has the stamp and the right type."""
    return bool(field.metadata.get("annotation")) and field.dataType.simpleString() == ANNOTATIONS.get(field.name)


class Corpus:
    """The events as a DataFrame with ``position`` and ``t_us``."""

    def __init__(self, df: DataFrame, spec: CorpusSpec | None = None, check: bool = False):
        self.spec = spec or CorpusSpec()
        if self.spec.id not in df.columns:
            raise CorpusError(f"no column {self.spec.id!r} for ids")
        if "position" not in df.columns:
            df = numbered(df)
        if self.spec.time and self.spec.time in df.columns:
            df = df.withColumn("t_us", micros(F.col(self.spec.time), df.schema[self.spec.time].dataType, self.spec.time_unit))
        else:
            df = df.withColumn("t_us", F.lit(None).cast("long"))
        self.df = df.withColumn("position", F.col("position").cast("long"))
        self.schema: StructType = self.df.schema
        if self.spec.embedding_model and self.spec.embedding in self.df.columns:
            made = self.schema[self.spec.embedding].metadata.get("embedding_model")
            if made and made != self.spec.embedding_model:
                raise CorpusError(f"{self.spec.embedding!r} was made by {made!r}, and queries are to be encoded by {self.spec.embedding_model!r}")
        self._names: list[str] | None = None
        self._checked: dict[str, bool] = {}
        if check:
            self.check()

    @property
    def spark(self) -> SparkSession:
        """The session of the events."""
        return self.df.sparkSession

    def check(self) -> list[str]:
        """Raise on null or duplicate ids, or positions that aren't dense from 0; return
        warnings, such as time going backwards."""
        own = F.col(f"`{self.spec.id}`")
        if self.df.filter(own.isNull()).limit(1).count():
            raise CorpusError("an event has no id")
        twice = self.df.groupBy(own).count().filter("count > 1").limit(1).collect()
        if twice:
            raise CorpusError(f"the id {twice[0][0]!r} is there more than once")
        r = self.df.agg(F.count(F.lit(1)), F.min("position"), F.max("position"), F.count_distinct("position")).first()
        if r[0] and (r[1] != 0 or r[2] != r[0] - 1 or r[3] != r[0]):
            raise CorpusError("positions are not the row numbers from 0")
        found = []
        # Neighbours meet by an equi-join on position, not in one sorted window.
        a, b = self.df.select("position", "t_us"), self.df.select((F.col("position") - 1).alias("position"), F.col("t_us").alias("next_us"))
        if a.join(b, "position").filter("next_us < t_us").limit(1).count():
            found.append("time goes backwards somewhere in position order")
        return found

    def field(self, name: str) -> str:
        """A field's column; ``user`` stands for the author field."""
        return self.spec.user if name == "user" and "user" not in self.df.columns else name

    def has(self, name: str) -> bool:
        """Whether the corpus has a field."""
        return name in self.df.columns

    def is_list(self, name: str) -> bool:
        """Whether a field holds lists."""
        return self.has(name) and isinstance(self.schema[name].dataType, ArrayType)

    def text_columns(self, what: str) -> list[str]:
        """The text fields there are; none is an error."""
        own = [c for c in self.spec.text_fields if self.has(c)]
        if not own:
            raise QueryError(f"{what} reads {', '.join(self.spec.text_fields)}, and the corpus has none of them")
        return own

    def require_time(self, what: str) -> None:
        """Time must be readable somewhere, or measuring it is refused."""
        if "time" not in self._checked:
            self._checked["time"] = bool(self.spec.time) and self.has(self.spec.time) and self.df.filter("t_us is not null").limit(1).count() > 0
        if not self._checked["time"]:
            raise QueryError(f"{what} measures time, and the corpus has no readable {self.spec.time or 'time field'}")

    def names(self) -> list[str]:
        """The distinct authors, for mentions; refused beyond a bound, since they become one
        pattern."""
        if self._names is None:
            if not self.has(self.spec.user):
                raise QueryError(f"mentions need authors, and the corpus has no {self.spec.user!r}")
            most = self.spec.most_names
            found = self.df.select(F.col(self.spec.user).cast("string").alias("n")).dropna().distinct().limit(most + 1).collect()
            if len(found) > most:
                raise QueryError(f"more than {most} authors: annotate the corpus with a mentions column first")
            self._names = [r["n"] for r in found]
        return self._names

    def with_features(self, features: DataFrame) -> Corpus:
        """The corpus with named sets of ids (columns ``feature``, ``id``) as one list column."""
        from dataclasses import replace

        sets = features.select(F.col("id").alias("feature_id_"), "feature").distinct().groupBy("feature_id_").agg(F.collect_set("feature").alias("features"))
        names = tuple(sorted(r[0] for r in features.select("feature").distinct().collect()))
        joined = self.df.drop("features").join(sets, self.df[self.spec.id] == sets["feature_id_"], "left").drop("feature_id_")
        return Corpus(joined, replace(self.spec, feature_names=names))
