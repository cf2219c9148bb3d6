"""Supersession and merging: functions from records to records; nothing is deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing, text
from ..sources.shared import written
from .ingest import NAMESPACE


def superseded(records: DataFrame, groups: DataFrame) -> DataFrame:
    """Conflict groups (group_id, id): the newest wins, the others end when it begins and point to it; all stay active."""
    rows = records.join(groups, "id")
    winners = rows.groupBy("group_id").agg(F.max(F.struct("valid_from", "created_at", "id")).alias("w"))
    lost = rows.join(winners, "group_id").where(F.col("id") != F.col("w.id"))
    return lost.select("group_id", "id", F.col("w.id").alias("superseded_by_id"), F.col("w.valid_from").alias("valid_to"), "is_active")


def union_text(created_at: str, id_: str) -> Column:
    """The distinct texts that are not blank in order of writing, joined by `` ; ``: of a record the summary, else the content."""
    stated = F.trim(text.first_nonblank(F.col("context_summary"), F.col("content")))
    ordered = F.array_sort(F.collect_list(F.struct(created_at, id_, stated.alias("t"))))
    return F.array_join(F.array_distinct(F.filter(F.transform(ordered, lambda x: x["t"]), lambda t: t != "")), " ; ")


def _root(group_id: Column) -> Column:
    return hashing.uuid5(NAMESPACE, F.concat(F.lit("root|"), group_id.cast("string")))


def roots(records: DataFrame, groups: DataFrame) -> DataFrame:
    """One new record for each group (group_id, id): united text and tags, earliest times, the newest source's identity, no hits yet."""
    rows = records.join(groups, "id")
    newest = lambda c: F.max_by(c, F.struct("created_at", "id")).alias(c)
    out = rows.groupBy("group_id").agg(
        union_text("created_at", "id").alias("context_summary"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"),
        F.min("created_at").alias("created_at"),
        F.min("occurred_at").alias("occurred_at"),
        newest("user_id"),
        newest("agent_type"),
        newest("project_id"),
        newest("customer_id"),
        F.lit(0).cast("long").alias("hit_count"),
        F.count("*").alias("sources"),
    )
    return out.withColumns({"id": _root(F.col("group_id")), "valid_from": F.coalesce("occurred_at", "created_at")})


def archived(records: DataFrame, groups: DataFrame, ended: Column | None = None) -> DataFrame:
    """``records`` with the groups' sources inactive below their root; those of merges by hand (``ended``) end then, superseded by it."""
    out = records.join(groups.select("id", _root(F.col("group_id")).alias("_root")), "id", "left")
    had = lambda c, kind: F.col(c) if c in records.columns else F.lit(None).cast(kind)
    gone = F.col("_root").isNotNull()
    changed = {"is_active": F.col("is_active") & ~gone, "parent_id": F.coalesce("_root", had("parent_id", "string"))}
    if ended is not None:
        changed |= {"valid_to": F.when(gone, ended).otherwise(had("valid_to", "timestamp")), "superseded_by_id": F.coalesce("_root", had("superseded_by_id", "string"))}
    return out.withColumns(changed).drop("_root")


def manually_superseded(records: DataFrame, pairs: DataFrame, now: Column) -> DataFrame:
    """``records`` with those of (id, by) ended now, inactive, pointing to what replaced them."""
    out = records.join(pairs, "id", "left")
    gone = F.col("by").isNotNull()
    return out.withColumns({"is_active": F.col("is_active") & ~gone, "valid_to": F.when(gone, now), "superseded_by_id": F.col("by")}).drop("by")


def merge_groups(records: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested merges (group_id, pos, id) with repeated ids dropped, that have two or more records of one four-part scope."""
    first = Window.partitionBy("group_id", "id").orderBy("pos")
    once = requested.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    scoped = once.join(records.select("id", F.struct("user_id", "agent_type", "project_id", "customer_id").alias("scope")), "id")
    good = scoped.groupBy("group_id").agg(F.count("*").alias("n"), F.count_distinct("scope").alias("scopes")).where("n >= 2 AND scopes = 1")
    return scoped.join(good.select("group_id"), "group_id", "left_semi").select("group_id", "id")


def chains(records: DataFrame) -> DataFrame:
    """(id, current, depth): what each superseded record has become, and by how many steps.

    Pointers are doubled: each round joins what a record points to with where that points, so a chain of n steps takes about
    log2(n) rounds, each a written table. Of repeated ids the largest successor counts. Records that supersede each other in a ring have no end and are an error.
    """
    edges = records.where("superseded_by_id IS NOT NULL").groupBy("id").agg(F.max("superseded_by_id").alias("current"))
    walk = written(edges.select("id", "current", F.lit(1).cast("long").alias("depth")), "chains")
    total, reached = walk.count(), 0
    while True:
        on = walk.select(F.col("id").alias("current"), F.col("current").alias("further"), F.col("depth").alias("more"))
        longer = walk.join(on, "current", "left")
        walk = written(longer.select("id", F.coalesce("further", "current").alias("current"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "chains")
        depth = walk.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("n")).first().n
        if depth > total:
            raise ValueError("records supersede each other in a ring")
        if depth == reached:
            return walk
        reached = depth


def latest_runs(ledger: DataFrame, runs: DataFrame) -> DataFrame:
    """The ledger after some runs: the last one of each scope."""
    newest = Window.partitionBy("scope_key").orderBy(F.desc("last_run_at"), F.desc("id"))
    return ledger.unionByName(runs).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
