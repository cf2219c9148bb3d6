"""Read-only browsing of records: filters, orders, pages, cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..schema import RECORD
from .recall import contributors
from .scope import Caller, row_scope


def any_term(query: str) -> Column:
    """Content or summary has any of the query's terms; a query without terms is looked for as it is."""
    hay = text.haystack(F.col("content"), F.col("context_summary"))
    terms = text.query_terms(F.lit(query))
    raw = F.lower(hay).like("%" + query.lower() + "%")
    return F.when(F.size(terms) > 0, text.term_overlap(terms, hay) > 0).otherwise(raw)


def all_tokens(query: str) -> Column:
    """Every term is one of the content's tokens."""
    held = text.tokens(text.haystack(F.col("content"), F.col("context_summary")))
    return F.forall(text.query_terms(F.lit(query)), lambda t: F.array_contains(held, t))


def any_tag(labels: list[str]) -> Column:
    """Any of the labels, normalised; all blank: no filter."""
    wanted = F.filter(F.transform(F.array(*(F.lit(x) for x in labels)), text.normalize_label), lambda x: x != "") if labels else F.array().cast("array<string>")
    return (F.size(wanted) == 0) | F.arrays_overlap(F.col("tags"), wanted)


def ordering(order: str) -> list[Column]:
    first = {"recency": [], "hits": [F.desc("hit_count")], "occurred": [F.desc_nulls_last("occurred_at")]}[order]
    return [*first, F.desc("created_at"), F.col("id")]


def page(records: DataFrame, order: str = "recency", offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of an order; negative numbers count as 0."""
    return records.orderBy(*ordering(order)).offset(max(0, offset)).limit(max(0, limit))


def nearest(records: DataFrame, vector: Column, limit: int) -> DataFrame:
    """Records with vectors by cosine to a query vector, nearest first."""
    close = records.where("embedding IS NOT NULL").withColumn("cosine", F.round(vectors.cosine(F.col("embedding"), vector), 9))
    return close.orderBy(F.desc("cosine"), "id").limit(max(0, limit))


def _stamped(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias(name)


def cells(records: DataFrame, caller: Caller) -> DataFrame:
    """The full cell of each record, one column for each of its 31 keys: contributors split from the tags, ids and times as text, the vector
    and the search words by presence only. What a table of records lacks is null."""
    kinds = {f.name: f.dataType for f in RECORD.fields}
    rows = records.withColumns({name: F.lit(None).cast(kind) for name, kind in kinds.items() if name not in records.columns})
    plain = F.array_sort(F.filter("tags", lambda t: ~F.startswith(t, F.lit("by:"))))
    text_of = lambda *names: [F.col(c).cast("string").alias(c) for c in names]
    return rows.select(
        *text_of("id", "content", "context_summary", "agent_summary", "user_id", "agent_type", "project_id", "customer_id", "session_id", "memory_tier", "discipline", "authority", "superseded_by_id", "parent_id", "last_hit_by", "source_message_id"),
        F.trim(text.first_nonblank(F.col("context_summary"), F.col("content"))).alias("summary"),
        F.array_join(plain, ",").alias("tags"),
        contributors(F.col("tags")).alias("by"),
        row_scope(caller).alias("scope"),
        *(_stamped(c) for c in ("occurred_at", "created_at", "last_used_at", "valid_from", "valid_to")),
        "is_active",
        "hit_count",
        "salience",
        F.col("embedding").isNotNull().alias("has_embedding"),
        F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("embedding_dim"),
        F.col("content_tokens").isNotNull().alias("has_tsv"),
    )


def by_id(records: DataFrame, record_id: object) -> DataFrame:
    return records.where(F.col("id") == F.lit(record_id)).limit(1)
