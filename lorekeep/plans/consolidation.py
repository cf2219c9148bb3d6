"""Queries of near-duplicate groups and of consolidation, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import consolidation as C
from ..operators import evaluation as E
from ..operators import grouping, lifecycle
from ..sources import tables as T
from ..sources.shared import written
from . import prelude as P
from .lifecycle import uuid_sql
from .recall import CONFIG

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: The test vectors are far apart, so records are near at less than the default.
TAU = 0.3
TAUS = (0.30, 0.35, 0.40)


def _add(name: str, sql: str):
    def put(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return put


def _pool_sql(more: str = "") -> str:
    return f"pool AS (SELECT id, user_id, agent_type, project_id, embedding FROM records WHERE is_active AND embedding IS NOT NULL AND NOT list_has_any(tags, ['confidential', 'pinned']){more})"


_PAIRS = f"near AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.embedding, b.embedding), 9) AS cosine FROM pool AS a JOIN pool AS b ON b.user_id = a.user_id AND b.agent_type = a.agent_type AND b.project_id = a.project_id AND a.id < b.id WHERE round(list_cosine_similarity(a.embedding, b.embedding), 9) >= {TAU})"


def _greedy(s: str = "") -> tuple[str, ...]:
    """In order, a record joins the first anchor near it, else it is an anchor; ``s`` ends the names of tables."""
    return (
        f"ordered{s} AS (SELECT p.id, row_number() OVER (ORDER BY p.id) AS n, (SELECT list(x.a) FROM near{s} AS x WHERE x.b = p.id) AS before FROM pool AS p WHERE p.id IN (SELECT a FROM near{s} UNION SELECT b FROM near{s}))",
        f"walk{s} AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS anchors, NULL::BIGINT AS id, NULL::BIGINT AS anchor UNION ALL SELECT o.n, CASE WHEN list_has_any(coalesce(o.before, []), w.anchors) THEN w.anchors ELSE list_append(w.anchors, o.id) END, o.id, list_min(list_intersect(coalesce(o.before, []), w.anchors)) FROM walk{s} AS w JOIN ordered{s} AS o ON o.n = w.n + 1)",
        f"members{s} AS (SELECT anchor, id FROM walk{s} WHERE anchor IS NOT NULL)",
        f"grouped{s} AS (SELECT anchor, id FROM members{s} UNION SELECT anchor, anchor FROM members{s})",
    )


def _pairs(spark, d) -> DataFrame:
    rows = T.records(spark, d).withColumn("valid_to", F.lit(None).cast("timestamp"))
    return grouping.near_pairs(C.candidates(rows, CONFIG.never_merge), list(C.SCOPE), TAU)


@_add("near_dup_pairs", P.query(P.RECORDS, _pool_sql(), _PAIRS, select="SELECT a, b, cosine FROM near"))
def near_dup_pairs(spark, d):
    return _pairs(spark, d).select("a", "b", "cosine")


@_add("near_dup_groups", P.query(P.RECORDS, _pool_sql(), _PAIRS, *_greedy(), select="SELECT anchor, id FROM grouped", recursive=True))
def near_dup_groups(spark, d):
    return grouping.groups(_pairs(spark, d))


@_add(
    "tau_sweep",
    P.query(
        P.RECORDS, _pool_sql(), _PAIRS, *(x for i, t in enumerate(TAUS) for x in (f"near_{i} AS (SELECT * FROM near WHERE cosine >= {t})", *_greedy(f"_{i}"))),
        "held AS (SELECT count(*) AS n FROM records WHERE is_active)",
        select=" UNION ALL ".join(f"SELECT {t}::DOUBLE AS tau, count(DISTINCT anchor) AS groups, count(*) AS archived, (SELECT n FROM held) - count(*) + count(DISTINCT anchor) AS memories_after, round((count(*) - count(DISTINCT anchor)) * 100.0 / (SELECT n FROM held), 6)::DOUBLE AS reduction FROM grouped_{i}" for i, t in enumerate(TAUS)),
        recursive=True,
    ),
)
def tau_sweep(spark, d):
    """What merging would take away at several thresholds; pairs are sought once, at the lowest."""
    near = written(_pairs(spark, d), "near")
    held = T.records(spark, d).where("is_active").count()
    each = [grouping.groups(near.where(F.col("cosine") >= t)).agg(F.lit(t).alias("tau"), F.count_distinct("anchor").alias("groups"), F.count("*").alias("archived")) for t in TAUS]
    after = F.lit(held) - F.col("archived") + F.col("groups")
    return reduce(DataFrame.unionByName, each).select("tau", "groups", "archived", after.alias("memories_after"), F.round(E.reduction(F.lit(held), after), 6).alias("reduction"))


_K = 10


def _recalled(s: str, members: str) -> tuple[str, ...]:
    """The needle recall of each question after groups have been merged."""
    return (
        f"mem{s} AS (SELECT id, text FROM txt WHERE id NOT IN (SELECT id FROM {members}) UNION ALL SELECT anchor, string_agg(text, ' ; ' ORDER BY n) FROM (SELECT anchor, text, min(t.id) AS n FROM {members} AS g JOIN txt AS t ON t.id = g.id WHERE text <> '' GROUP BY anchor, text) GROUP BY anchor)",
        f"bag{s} AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM mem{s}) GROUP BY ALL)",
        f"big{s} AS (SELECT id, sum(n) AS n FROM bag{s} GROUP BY id)",
        f"com{s} AS (SELECT q.qid, m.id, sum(least(q.n, m.n)) AS common FROM qbag AS q JOIN bag{s} AS m ON m.t = q.t GROUP BY ALL)",
        f"top{s} AS (SELECT c.qid, c.id FROM com{s} AS c JOIN qbig AS q ON q.qid = c.qid JOIN big{s} AS m ON m.id = c.id QUALIFY row_number() OVER (PARTITION BY c.qid ORDER BY common::DOUBLE / (q.n + m.n - common) DESC, c.id) <= {_K})",
        f"rec{s} AS (SELECT n.qid, count(DISTINCT n.needle) FILTER (WHERE contains(lower(m.text), n.needle)) * 1.0 / count(DISTINCT n.needle) AS r FROM needles AS n LEFT JOIN top{s} AS t ON t.qid = n.qid LEFT JOIN mem{s} AS m ON m.id = t.id GROUP BY n.qid)",
    )


@_add(
    "tau_recall",
    P.query(
        P.RECORDS, P.QUESTIONS, _pool_sql(), _PAIRS, *(x for i, t in enumerate(TAUS) for x in (f"near_{i} AS (SELECT * FROM near WHERE cosine >= {t})", *_greedy(f"_{i}"))),
        "txt AS (SELECT p.id, trim(coalesce(nullif(context_summary, ''), content)) AS text FROM pool AS p JOIN records AS r ON r.id = p.id)",
        "qbag AS (SELECT qid, t, count(*) AS n FROM (SELECT qid, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS t FROM questions) GROUP BY ALL)", "qbig AS (SELECT qid, sum(n) AS n FROM qbag GROUP BY qid)",
        f"needles AS (SELECT DISTINCT qid, unnest(list_slice({P.terms('query')}, 1, 3)) AS needle FROM questions)", "nobody AS (SELECT id AS anchor, id FROM pool LIMIT 0)",
        *_recalled("", "nobody"), *(x for i in range(len(TAUS)) for x in _recalled(f"_{i}", f"grouped_{i}")),
        select=" UNION ALL ".join(f"SELECT {t}::DOUBLE AS tau, (SELECT count(*) FROM pool) AS memories_before, (SELECT count(*) FROM mem_{i}) AS memories_after, round(avg(b.r), 9) AS recall_before, round(avg(a.r), 9) AS recall_after, round(CASE WHEN avg(b.r) > 0 THEN avg(a.r) / avg(b.r) ELSE 1.0 END, 9) AS retention, count(*) FILTER (WHERE a.r < b.r) AS lost, count(*) FILTER (WHERE b.r > 0 AND a.r = 0) AS dropped FROM rec AS b JOIN rec_{i} AS a ON a.qid = b.qid" for i, t in enumerate(TAUS)),
        recursive=True,
    ),
)
def tau_recall(spark, d):
    """What recall keeps of a question's first three terms when near-duplicates are merged, at several thresholds."""
    rows = C.candidates(T.records(spark, d).withColumn("valid_to", F.lit(None).cast("timestamp")), CONFIG.never_merge)
    asked = T.questions(spark, d)
    needles = asked.select("qid", F.explode(F.array_distinct(text.query_terms(F.col("query"), 3))).alias("needle"))
    out = C.recall_by_threshold(rows, written(_pairs(spark, d), "near"), TAUS, asked.select("qid", F.col("query").alias("text")), needles, _K)
    return out.select("tau", "memories_before", "memories_after", *(F.round(c, 9).alias(c) for c in ("recall_before", "recall_after", "retention")), "lost", "dropped")


# a pass: every seventh record has ended; replies of a classifier follow from a group's id

_KEY = "user_id || '|' || agent_type || '|' || project_id"
_ROUTED = (
    P.RECORDS,
    _pool_sql(" AND id % 7 <> 0"),
    _PAIRS,
    *_greedy(),
    f"sources AS (SELECT g.anchor AS group_id, {_KEY} AS scope_key, r.* FROM grouped AS g JOIN records AS r ON r.id = g.id)",
    r"routes AS (SELECT group_id, any_value(scope_key) AS scope_key, count(*) AS n, CASE WHEN group_id % 3 = 0 THEN 'conflict' WHEN group_id % 3 = 2 THEN 'distinct' WHEN NOT bool_or(length(regexp_replace(coalesce(content, ''), '\s+', '', 'g')) > 0) THEN 'error' ELSE 'merge' END AS route FROM sources GROUP BY group_id)",
    f"held AS (SELECT {_KEY} AS scope_key, count(*) AS memories_before FROM records WHERE is_active GROUP BY 1)",
    "found AS (SELECT scope_key, count(*) AS groups, count(*) FILTER (WHERE route = 'merge') AS synthesized, sum(CASE WHEN route = 'merge' THEN n ELSE 0 END)::BIGINT AS archived, sum(CASE WHEN route = 'conflict' THEN n - 1 ELSE 0 END)::BIGINT AS superseded, count(*) FILTER (WHERE route = 'error') AS errors FROM routes GROUP BY 1)",
    "report AS (SELECT h.scope_key, coalesce(groups, 0) AS groups, coalesce(synthesized, 0) AS synthesized, coalesce(archived, 0) AS archived, coalesce(superseded, 0) AS superseded, coalesce(errors, 0) AS errors, coalesce(groups, 0) AS cost_calls, memories_before, memories_before - coalesce(archived, 0) + coalesce(synthesized, 0) AS memories_after FROM held AS h LEFT JOIN found AS f ON f.scope_key = h.scope_key)",
)


def _records(spark, d) -> DataFrame:
    """Records with what a life has: beginnings, ends and text ids."""
    rows = T.records(spark, d)
    none = F.lit(None).cast("string")
    return rows.withColumns({"valid_from": F.coalesce("occurred_at", T.now()), "valid_to": F.when(F.col("id") % 7 == 0, F.col("created_at")), "parent_id": none, "superseded_by_id": none, "id": F.col("id").cast("string")})


def _routed(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _records(spark, d)
    groups = written(C.groups(rows, TAU, CONFIG.never_merge), "groups")
    at = F.col("group_id").cast("long") % 3
    replies = groups.select("group_id").distinct().select("group_id", F.when(at == 0, " Conflict").when(at == 1, "restatement").otherwise("can't tell").alias("reply"))
    return rows, groups, written(C.routes(rows, groups, replies), "routes")


@_add("consolidation_report", P.query(*_ROUTED, select="SELECT * FROM report", recursive=True))
def consolidation_report(spark, d):
    rows, _, routes = _routed(spark, d)
    return C.report(rows, routes)


@_add(
    "consolidated_records",
    P.query(
        *_ROUTED,
        "ended AS (SELECT id, first(id) OVER w AS by, first(vf) OVER w AS ends FROM (SELECT s.*, coalesce(s.occurred_at, TIMESTAMP '2024-03-01') AS vf FROM sources AS s JOIN routes AS t ON t.group_id = s.group_id WHERE route = 'conflict') WINDOW w AS (PARTITION BY group_id ORDER BY vf DESC, created_at DESC, id DESC) QUALIFY row_number() OVER w > 1)",
        f"rooted AS (SELECT s.id, {uuid_sql('(' + chr(39) + 'root|' + chr(39) + ' || s.group_id::VARCHAR)')} AS root FROM sources AS s JOIN routes AS t ON t.group_id = s.group_id WHERE route = 'merge')",
        select=f"SELECT r.id::VARCHAR AS id, r.is_active AND o.id IS NULL AS is_active, r.hit_count, o.root AS parent_id, e.by::VARCHAR AS superseded_by_id, {P.stamp('coalesce(e.ends, CASE WHEN r.id % 7 = 0 THEN r.created_at END)')} AS valid_to FROM records AS r LEFT JOIN rooted AS o ON o.id = r.id LEFT JOIN ended AS e ON e.id = r.id UNION ALL SELECT DISTINCT root, true, 0, NULL, NULL, NULL FROM rooted",
        recursive=True,
    ),
)
def consolidated_records(spark, d):
    """All records after the pass, roots among them."""
    rows, groups, routes = _routed(spark, d)
    return C.applied(rows, groups, routes).select("id", "is_active", "hit_count", "parent_id", "superseded_by_id", F.date_format("valid_to", "yyyy-MM-dd HH:mm:ss").alias("valid_to"))


@_add("consolidation_ledger", P.query(*_ROUTED, select=f"SELECT {uuid_sql('(' + chr(39) + 'run|' + chr(39) + ' || scope_key)')} AS id, scope_key, CASE WHEN groups > 0 THEN '2024-03-01 00:00:00' ELSE '2024-02-29 00:00:00' END AS last_run_at, synthesized AS groups_merged, archived AS rows_archived, cost_calls FROM report", recursive=True))
def consolidation_ledger(spark, d):
    """The ledger after a run of the scopes with groups over one of all scopes, a day before."""
    rows, _, routes = _routed(spark, d)
    report = written(C.report(rows, routes), "report")
    before = C.runs(report, F.date_sub(T.now(), 1).cast("timestamp"))
    return lifecycle.latest_runs(before, C.runs(report.where("groups > 0"), T.now())).withColumn("last_run_at", F.date_format("last_run_at", "yyyy-MM-dd HH:mm:ss"))


@_add("consolidation_max_groups", P.query(*_ROUTED, select="SELECT group_id::VARCHAR AS group_id, id::VARCHAR AS id FROM sources QUALIFY dense_rank() OVER (PARTITION BY scope_key ORDER BY group_id) <= 2", recursive=True))
def consolidation_max_groups(spark, d):
    """The groups of a pass that takes two of each pool."""
    return C.groups(_records(spark, d), TAU, CONFIG.never_merge, max_groups=2)
