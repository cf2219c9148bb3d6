"""Ingest as pure plans: facts in, rows to append out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing, text

#: Namespace of ids that are derived from names.
NAMESPACE = "6f0d7c1e-52a4-4d0b-9a57-3b0f5a2c9e11"

_SCOPE = ["user_id", "agent_type", "project_id"]


def new_facts(facts: DataFrame, existing: DataFrame) -> DataFrame:
    """Facts (scope, pos, summary, ...) that are not blank, the first of equal summaries in a scope, and not stored and active there."""
    stated = facts.withColumn("summary", F.trim("summary")).where("summary <> ''")
    first = Window.partitionBy(*_SCOPE, "summary").orderBy("pos")
    once = stated.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    stored = existing.where("is_active").select(*_SCOPE, F.col("context_summary").alias("summary")).distinct()
    same = [once[c].eqNullSafe(stored[c]) for c in (*_SCOPE, "summary")]
    return once.join(stored, same, "left_anti")


def unseen_sources(messages: DataFrame, existing: DataFrame, source: str = "source_message_id", summary: str | None = None) -> DataFrame:
    """Messages whose source id (with ``summary``, whose pair of both) is stored nowhere, in no scope; those without a source id are new."""
    key = [source, summary] if summary else [source]
    return messages.join(existing.select(*key).distinct(), key, "left_anti")


def receipts(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each request (id, digest) with its outcome: new, repeated (same payload) or conflict (another payload)."""
    known = ledger.select("id", F.col("payload_sha256").alias("_known"))
    outcome = F.when(F.col("_known").isNull(), "new").when(F.col("_known") == F.col("digest"), "repeated").otherwise("conflict")
    return requests.join(known, "id", "left").withColumn("outcome", outcome).drop("_known")


def as_records(facts: DataFrame, now: Column) -> DataFrame:
    """Facts as rows to append: valid from when they occurred, else from now; search text and labels derived."""
    key = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _SCOPE), "summary")
    return facts.select(
        hashing.uuid5(NAMESPACE, key).alias("id"),
        *_SCOPE,
        text.first_nonblank(F.col("content"), F.col("summary")).alias("content"),
        F.col("summary").alias("context_summary"),
        now.alias("created_at"),
        "occurred_at",
        F.coalesce("occurred_at", now).alias("valid_from"),
        F.lit(True).alias("is_active"),
        F.lit(0).cast("long").alias("hit_count"),
        F.array_sort(F.array_distinct(F.filter(F.transform("tags", text.normalize_label), lambda t: t != ""))).alias("tags"),
        *(c for c in ("customer_id", "agent_summary") if c in facts.columns),
    )


def reconciled_tags(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Tags (scope_key, label) of rows that the registry lacks, with repeatable ids."""
    wanted = rows.select(text.scope_key(F.col("user_id"), F.col("agent_type"), F.col("project_id")).alias("scope_key"), F.explode("tags").alias("raw"))
    labels = wanted.select("scope_key", text.normalize_label(F.col("raw")).alias("label")).where("label <> ''").distinct()
    missing = labels.join(registry.select("scope_key", "label"), ["scope_key", "label"], "left_anti")
    return missing.withColumn("id", hashing.uuid5(NAMESPACE, F.concat_ws("|", "scope_key", "label")))


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """The first chunk (by pos) of each content in a world."""
    first = Window.partitionBy("world", "digest").orderBy("pos")
    return chunks.withColumn("digest", hashing.payload_digest(F.col("text"))).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def identity_conflicts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that stand for more than one content."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("contents")).where("contents > 1")


def invalid(messages: DataFrame) -> DataFrame:
    """Messages with the reason for which they are refused."""
    reason = F.when(F.length(F.trim(F.coalesce("content", F.lit("")))) == 0, "blank content").when(~F.col("role").isin("user", "assistant"), "unknown role").when(~F.col("timestamp").between(-62135596800000, 253402300799999), "timestamp out of range")
    return messages.withColumn("reason", reason).where("reason IS NOT NULL")
