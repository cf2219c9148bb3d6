"""Consolidation: the near-duplicates of every pool in one pass, routed by what a classifier says of each group.

Of a conflict the newest fact wins and the others end, restatements go under a new root, distinct facts stay as they
are. Nothing is deleted. What models say comes as tables: ``relations`` (group_id, reply) and ``merged`` (group_id, text).
Without ``relations`` every group is merged, without ``merged`` a root unites its sources' texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing, parsing, text
from ..sources.shared import written
from . import evaluation, grouping, lifecycle
from .ingest import NAMESPACE
from .scope import current, never_merge

#: A pool: near-duplicates of another one are never looked at.
SCOPE = ("user_id", "agent_type", "project_id")


def candidates(records: DataFrame, never: tuple[str, ...]) -> DataFrame:
    """Active, current records with a vector that no tag protects."""
    return never_merge(records.where(F.col("is_active") & current() & F.col("embedding").isNotNull()), never)


def groups(records: DataFrame, threshold: float, never: tuple[str, ...], max_groups: int = 0) -> DataFrame:
    """(group_id, id): near-duplicate groups; of each pool the first ``max_groups`` in order of writing (0: all)."""
    pairs = grouping.near_pairs(candidates(records, never), list(SCOPE), threshold)
    found = grouping.groups(pairs).select(F.col("anchor").alias("group_id"), "id")
    if not max_groups:
        return found
    anchors = records.select(*SCOPE, "id", "created_at").join(found.select(F.col("group_id").alias("id")).distinct(), "id", "left_semi")
    first = anchors.withColumn("_n", F.row_number().over(Window.partitionBy(*SCOPE).orderBy("created_at", "id"))).where(F.col("_n") <= max_groups)
    return found.join(first.select(F.col("id").alias("group_id")), "group_id", "left_semi")


def routes(records: DataFrame, groups: DataFrame, relations: DataFrame | None = None, merged: DataFrame | None = None) -> DataFrame:
    """(group_id, scope_key, n, route, text, calls): conflict, distinct, merge, or error where there is no text to merge into."""
    scope_key = text.scope_key(*(F.col(c) for c in SCOPE))
    rows = records.withColumn("scope_key", scope_key).join(groups, "id")
    out = rows.groupBy("group_id").agg(F.count("*").alias("n"), F.max_by("scope_key", F.struct("created_at", "id")).alias("scope_key"), lifecycle.union_text("created_at", "id").alias("text"))
    relation, calls = F.lit("restatement"), F.lit(0)
    if relations is not None:
        out = out.join(relations.select("group_id", "reply"), "group_id", "left")
        relation, calls = parsing.relation(F.col("reply")), F.lit(1)
    if merged is not None:
        out = out.drop("text").join(merged.select("group_id", F.trim("text").alias("text")), "group_id", "left")
        calls = calls + (relation == "restatement").cast("int")
    route = F.when(relation == "conflict", "conflict").when(relation == "distinct_facts", "distinct").when(F.coalesce("text", F.lit("")) == "", "error").otherwise("merge")
    return out.select("group_id", "scope_key", "n", route.alias("route"), "text", calls.alias("calls"))


def applied(records: DataFrame, groups: DataFrame, routes: DataFrame) -> DataFrame:
    """``records`` (with valid_from, valid_to, parent_id, superseded_by_id; text ids) after the pass, roots added; roots are yet without a vector."""
    of = lambda route: groups.join(routes.where(F.col("route") == route).select("group_id"), "group_id", "left_semi")
    ended = lifecycle.superseded(records, of("conflict")).select("id", F.col("superseded_by_id").alias("_by"), F.col("valid_to").alias("_ends"))
    after = lifecycle.archived(records, of("merge")).join(ended, "id", "left")
    after = after.withColumns({"superseded_by_id": F.coalesce("_by", "superseded_by_id"), "valid_to": F.coalesce("_ends", "valid_to")}).drop("_by", "_ends")
    roots = lifecycle.roots(records, of("merge")).join(routes.select("group_id", F.col("text").alias("content")), "group_id")
    roots = roots.withColumns({"context_summary": F.col("content"), "is_active": F.lit(True)}).drop("group_id", "sources")
    return after.unionByName(roots, allowMissingColumns=True)


def report(records: DataFrame, routes: DataFrame) -> DataFrame:
    """Counters of each scope, of those without a group too."""
    n, route = F.col("n"), F.col("route")
    held = records.where("is_active").groupBy(text.scope_key(*(F.col(c) for c in SCOPE)).alias("scope_key")).agg(F.count("*").alias("memories_before"))
    total = lambda condition, value: F.sum(F.when(condition, value).otherwise(0))
    found = routes.groupBy("scope_key").agg(
        F.count("*").alias("groups"),
        F.count_if(route == "merge").alias("synthesized"),
        total(route == "merge", n).alias("archived"),
        total(route == "conflict", n - 1).alias("superseded"),
        F.count_if(route == "error").alias("errors"),
        F.sum("calls").alias("cost_calls"),
    )
    every = held.join(found, "scope_key", "left").fillna(0)
    return every.withColumn("memories_after", F.col("memories_before") - F.col("archived") + F.col("synthesized"))


def runs(report: DataFrame, now: Column) -> DataFrame:
    """The runs' ledger rows, one for each scope."""
    id_ = hashing.uuid5(NAMESPACE, F.concat(F.lit("run|"), F.col("scope_key")))
    return report.select(id_.alias("id"), "scope_key", now.alias("last_run_at"), F.col("synthesized").alias("groups_merged"), F.col("archived").alias("rows_archived"), "cost_calls")


def merged_texts(records: DataFrame, members: DataFrame) -> DataFrame:
    """(id, text) of the records after groups (anchor, id) have been merged: a group has its anchor's id and its distinct texts."""
    stated = F.trim(text.first_nonblank(F.col("context_summary"), F.col("content")))
    grouped = records.join(members, "id")
    roots = grouped.groupBy("anchor").agg(lifecycle.union_text("created_at", "id").alias("text")).select(F.col("anchor").alias("id"), "text")
    return records.join(members.select("id"), "id", "left_anti").select("id", stated.alias("text")).unionByName(roots)


def needle_recall(memories: DataFrame, questions: DataFrame, needles: DataFrame, k: int) -> DataFrame:
    """(qid, recall): the share of a question's needles (qid, needle) that stand in any of the ``k`` memories (id, text) recalled for it."""
    recalled = evaluation.stub_recall(questions, memories, k).join(memories, "id").select("qid", F.lower("text").alias("said"))
    found = needles.join(recalled, "qid").where(F.contains("said", F.lower("needle"))).select("qid", "needle").distinct().withColumn("found", F.lit(1))
    return needles.join(found, ["qid", "needle"], "left").groupBy("qid").agg((F.count("found") / F.count("*")).alias("recall"))


def recall_by_threshold(records: DataFrame, pairs: DataFrame, thresholds: tuple[float, ...], questions: DataFrame, needles: DataFrame, k: int) -> DataFrame:
    """One row a threshold: memories before and after merging what is nearer than it, needle recall before and after, what of it is kept and lost.

    ``pairs`` are those at the lowest threshold; ``questions`` are (qid, text), ``needles`` (qid, needle), each once.
    """
    nobody = records.select(F.col("id").alias("anchor"), "id").limit(0)
    before = written(needle_recall(merged_texts(records, nobody), questions, needles, k), "before")
    n, mean = records.count(), before.agg(F.avg("recall").alias("m")).first().m
    out = []
    for threshold in thresholds:
        memories = written(merged_texts(records, grouping.groups(pairs.where(F.col("cosine") >= threshold))), "memories")
        after = written(needle_recall(memories, questions, needles, k), "after")
        means = after.agg(F.avg("recall").alias("recall_after"))
        kept = evaluation.retention(before, after).crossJoin(F.broadcast(means))  # one row each
        out.append(kept.select(F.lit(threshold).alias("tau"), F.lit(n).alias("memories_before"), F.lit(memories.count()).alias("memories_after"), F.lit(mean).alias("recall_before"), "recall_after", "retention", "lost", "dropped"))
    return reduce(DataFrame.unionByName, out)
