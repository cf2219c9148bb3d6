"""The engine's views of the test tables: records, questions and turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

#: The instant at which recency is measured.
NOW = "2024-03-01 00:00:00"
#: The as-of bound of odd questions.
AS_OF = "2024-01-10 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as memory records, with their vectors and tags."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    good = table(spark, folder, "labels").where("quality = 1 AND doc_id % 17 = 0").select("doc_id", F.lit("pinned").alias("pin"))
    words = F.slice(F.filter(text.tokens(F.col("text")), lambda w: F.length(w) >= 6), 1, 8)
    id_ = F.col("doc_id")
    created = F.timestamp_seconds(F.lit(1704067200) + id_ * 3600)
    return docs.join(vectors, "doc_id", "left").join(good, "doc_id", "left").select(
        id_.alias("id"),
        F.col("text").alias("content"),
        F.substring("text", 1, 200).alias("context_summary"),
        F.concat(F.lit("p"), id_ % 3).alias("agent_type"),
        (id_ % 2).alias("user_id"),
        F.when(F.col("lang") == "en", "en").otherwise("other").alias("project_id"),
        F.lit("c0").alias("customer_id"),
        created.alias("created_at"),
        F.when(id_ % 11 != 0, F.timestamp_seconds(F.lit(1704067200) + id_ * 3600 - (id_ % 30) * 86400)).alias("occurred_at"),
        (id_ % 5).alias("hit_count"),
        (id_ % 13 != 0).alias("is_active"),
        "embedding",
        F.sort_array(F.array_distinct(F.concat(words, F.array(F.concat(F.lit("by:u"), id_ % 2)), F.when(F.col("pin").isNotNull(), F.array("pin")).otherwise(F.array().cast("array<string>"))))).alias("tags"),
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items as questions: qid, query, vector, as_of."""
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    items = table(spark, folder, "benchmark").join(vectors, "item_id", "left")
    return items.select(F.col("item_id").alias("qid"), F.col("text").alias("query"), "vector", F.when(F.col("item_id") % 2 == 1, F.lit(AS_OF).cast("timestamp")).alias("as_of"))


def turns(spark: SparkSession, folder: str) -> DataFrame:
    said = table(spark, folder, "conversations")
    return said.select("conv_id", F.col("turn").alias("turn_pos"), F.concat(F.lit("D"), "conv_id", F.lit(":"), "turn").alias("turn_id"), F.col("role").alias("speaker"), "text", F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 86400 + F.col("turn") * 60).alias("occurred_at"))
