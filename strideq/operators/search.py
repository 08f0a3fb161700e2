"""Ranked scouting: BM25 over tokens, and similarity; both outside the algebra."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideq.errors import QueryError
from strideq.functions import text as T
from strideq.functions.vectors import cosine
from strideq.sources.corpus import Corpus


def scout(corpus: Corpus, words: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The ``k`` best events for some words by BM25, ties in load order: position, id, score."""
    terms = list(dict.fromkeys(T.tokens_of(words, corpus.spec.tokenizer)))
    if not terms:
        raise QueryError("the search has no letters or digits")
    fields = corpus.text_columns("a text search")
    own = F.concat(*[T.tokens(F.col(f"`{c}`"), corpus.spec.tokenizer) for c in fields])
    df = corpus.df.select("position", F.col(f"`{corpus.spec.id}`").alias("id"), own.alias("w"))
    df = df.select("position", "id", F.size("w").alias("n"), *[_count(t).alias(f"f{i}") for i, t in enumerate(terms)])
    stats = df.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), *[F.sum((F.col(f"f{i}") > 0).cast("long")).alias(f"d{i}") for i in range(len(terms))]).first()
    met = df.filter(" OR ".join(f"f{i} > 0" for i in range(len(terms))))
    score = F.lit(0.0)
    for i in range(len(terms)):
        seen = stats[f"d{i}"] or 0
        idf = math.log(1 + (stats["docs"] - seen + 0.5) / (seen + 0.5))
        score = score + idf * F.col(f"f{i}") * (k1 + 1) / (F.col(f"f{i}") + k1 * (1 - b + b * F.col("n") / (stats["mean"] or 1.0)))
    return met.select("position", "id", score.alias("score")).orderBy(F.desc("score"), "position").limit(k)


def _count(term: str) -> Column:
    return F.size(F.filter("w", lambda x: x == F.lit(term)))


def similar(corpus: Corpus, text: str, k: int, threshold: float | None = None) -> DataFrame:
    """The ``k`` events most similar to a text, at least ``threshold`` if that is given, ties
    in load order: position, id, score; and ``total``, how many there are without ``k``."""
    spec = corpus.spec
    if not corpus.has(spec.embedding) or spec.embedder is None:
        raise QueryError("similarity needs an embedding column and an embedder")
    score = cosine(F.col(f"`{spec.embedding}`"), [float(x) for x in spec.embedder([text])[0]])
    df = corpus.df.select("position", F.col(f"`{spec.id}`").alias("id"), score.alias("score")).filter("score is not null")
    if threshold is not None:
        df = df.filter(F.col("score") >= threshold)
    total = df.agg(F.count(F.lit(1)).alias("total"))  # one row
    return df.orderBy(F.desc("score"), "position").limit(k).join(F.broadcast(total))
