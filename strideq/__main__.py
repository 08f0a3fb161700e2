"""Command line: ``python -m strideq ingest|query ...``."""

from __future__ import annotations

import argparse
import json
from importlib import import_module
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strideq.engine import Aggregate, Engine, Grouped
from strideq.errors import ConfigError, CorpusError
from strideq.sources import ingest, logs
from strideq.sources.corpus import CorpusSpec


def parser() -> argparse.ArgumentParser:
    """The arguments."""
    p = argparse.ArgumentParser(prog="strideq")
    commands = p.add_subparsers(dest="command", required=True)
    i = commands.add_parser("ingest", help="sources to a canonical Parquet stream")
    i.add_argument("format", choices=["table", *logs.FORMATS])
    i.add_argument("paths", nargs="+", help="sources, the target last")
    i.add_argument("--id", default="id")
    i.add_argument("--time", default="timestamp")
    i.add_argument("--sort")
    i.add_argument("--keep", nargs="*")
    i.add_argument("--time-unit", choices=["s", "ms", "us", "ns"])
    i.add_argument("--source-col")
    i.add_argument("--annotate", nargs="*", default=[], choices=["questions", "links", "mentions", "entities"])
    i.add_argument("--actor", default="user", help="the column of authors, for mentions")
    i.add_argument("--tagger", help="module:function from texts to lists of labels, for entities")
    i.add_argument("--embed", metavar="COLUMN", help="text column to embed")
    i.add_argument("--encoder", help="module:function from texts to vectors, for --embed")
    i.add_argument("--model", help="the encoder's name, stamped on the vectors")
    i.add_argument("--judge", metavar="FILE", help="JSON list of questions")
    i.add_argument("--client", help="module:function from rows and questions to answers, for --judge")
    i.add_argument("--index", nargs="*", default=[], metavar="COLUMN", help="text columns whose tokens and stems are written")
    q = commands.add_parser("query", help="one query over a corpus")
    q.add_argument("corpus")
    q.add_argument("query")
    q.add_argument("--id", default="id")
    q.add_argument("--time", default="time")
    q.add_argument("--user", default="user")
    return p


def loaded(name: str | None):
    """A function named ``module:function``."""
    module, colon, function = (name or "").partition(":")
    if not colon:
        raise ConfigError("name a function as module:function")
    return getattr(import_module(module), function)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    """Run a command."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("strideq").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "ingest":
        *sources, target = a.paths
        if a.format == "table":
            df = ingest.normalize(ingest.read_sources(spark, sources, a.id, a.source_col), a.id, a.time, a.sort, a.keep, a.time_unit)
        elif len(sources) != 1:
            raise CorpusError(f"{a.format}: one log folder at a time")
        else:
            df = logs.read_logs(spark, sources[0], a.format)
        if a.annotate:
            names = df.select(F.col(f"`{a.actor}`").alias("name")) if "mentions" in a.annotate else None
            df = ingest.annotate(df, a.annotate, list(CorpusSpec().text_fields), names, loaded(a.tagger) if a.tagger else None)
        if a.judge:
            questions = [ingest.Question(**q) for q in json.loads(Path(a.judge).read_text(encoding="utf-8"))]
            df = ingest.judged(df, questions, loaded(a.client))
        if a.embed:
            df = ingest.embed(df, loaded(a.encoder), a.embed, model=a.model)
        if a.index:
            df = ingest.indexed(df, tuple(a.index))
        ingest.write(df, target)
        print(json.dumps(ingest.describe(spark.read.parquet(target)), default=str))
        return
    found = Engine(ingest.load_table(spark, a.corpus, CorpusSpec(id=a.id, time=a.time, user=a.user))).execute(a.query)
    if isinstance(found, Aggregate):
        print(json.dumps(found.by_key if found.by_key is not None else found.value, default=str))
    elif isinstance(found, Grouped):
        print(json.dumps(found.groups, default=str))
    else:
        for g in found.groups:
            print(json.dumps(g, default=str))


if __name__ == "__main__":
    main()
