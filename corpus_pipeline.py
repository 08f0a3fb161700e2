"""A corpus pipeline in five stages; every stage reads what the one before it wrote.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: all but the last the
columns of documents, those kept. A stage judges every row of its own input. An empty
table gives an empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideq.llm import jaccard_join, language_id, packing, quality_mil, substring_dedup
from strideq.llm.common import fold, hint_small, saved, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted; null texts are judged by their other evidence."""
    return language_id.kept(docs, language_id.fit(docs, "lang"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good; null texts are scored as
    empty ones. Without labels nothing goes."""
    out = quality_mil.score(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return out.filter("score >= 0.3").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join: the least id. Rows without an
    id stay if no row with one is in their class; rows repeated in full are one document."""
    classes = jaccard_join.join(docs.select("doc_id", "text"), keep=("text_key",))
    # Only rows that go are carried back, so texts meet no more than those.
    goes = F.col("class_id").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") != F.col("class_id")))
    gone, _ = saved(classes.filter(goes).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct(), "gone")
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id_"), F.xxhash64("text").alias("key_"))
    kept = marked.join(hint_small(gone), F.col("id_").eqNullSafe(F.col("gone_id")) & (F.col("key_") == F.col("gone_key")), "left_anti")
    return kept.select("row.*")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated spans; those of which nothing remains go. Null and empty
    texts have no spans and stay."""
    out = substring_dedup.dedup(docs)
    out = out.filter((F.size("removed") == 0) | (F.length(F.trim("clean_text")) > 0))
    same = [F.col("clean_text").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    own = out.select(*same)
    return own.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else own


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences; a null or empty text has its end id alone."""
    return packing.packed(docs)


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("packing", packed),
]

#: SQL can't express the trained stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs, _ = saved(docs, f"stage-{name}")
    return docs
