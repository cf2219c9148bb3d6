"""Queries of ingest, lifecycle, grouping and merging, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, text
from ..operators import ingest, lifecycle, merge
from ..sources import tables as T
from . import prelude as P

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

NS = ingest.NAMESPACE
_HEX = NS.replace("-", "")


def uuid_sql(name: str) -> str:
    """The name-based UUID of a text, in SQL."""
    h = f"sha1(from_hex('{_HEX}') || encode({name}))"
    return f"substring({h}, 1, 8) || '-' || substring({h}, 9, 4) || '-5' || substring({h}, 14, 3) || '-' || substring('89ab', (('0x' || substring({h}, 17, 1))::INTEGER % 4) + 1, 1) || substring({h}, 18, 3) || '-' || substring({h}, 21, 12)"


def _add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def _stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def _facts(spark, d):
    """The inactive half of the documents again, as facts; the others are stored."""
    rows = T.records(spark, d)
    return rows.select("user_id", "agent_type", "project_id", F.col("id").alias("pos"), F.col("context_summary").alias("summary"), "content", "occurred_at", "tags")


_STORED = "stored AS (SELECT * FROM records WHERE id % 2 = 0)"
_FACTS = "facts AS (SELECT user_id, agent_type, project_id, id AS pos, trim(context_summary) AS summary, content, occurred_at, tags FROM records)"
_ONCE = "once AS (SELECT * FROM facts WHERE summary <> '' QUALIFY row_number() OVER (PARTITION BY user_id, agent_type, project_id, summary ORDER BY pos) = 1)"
_FRESH = "fresh AS (SELECT o.* FROM once AS o WHERE NOT EXISTS (SELECT 1 FROM stored AS s WHERE s.is_active AND s.user_id = o.user_id AND s.agent_type = o.agent_type AND s.project_id IS NOT DISTINCT FROM o.project_id AND s.context_summary = o.summary))"


def _fresh(spark, d):
    return ingest.new_facts(_facts(spark, d), T.records(spark, d).where("id % 2 = 0"))


@_add("ingest_dedup", P.query(P.RECORDS, _STORED, _FACTS, _ONCE, _FRESH, select="SELECT pos FROM fresh"))
def ingest_dedup(spark, d):
    return _fresh(spark, d).select("pos")


_KEY = "user_id || '|' || agent_type || '|' || project_id || '|' || summary"


@_add("ingest_verbatim", P.query(P.RECORDS, _STORED, _FACTS, _ONCE, _FRESH, select=f"SELECT {uuid_sql(_KEY)} AS id, summary AS context_summary, CASE WHEN occurred_at IS NULL THEN '2024-03-01 00:00:00' ELSE {P.stamp('occurred_at')} END AS valid_from, array_to_string(list_sort(list_distinct(list_filter(list_transform(tags, lambda t: {P.label('t')}), lambda t: t <> ''))), ',') AS tags FROM fresh"))
def ingest_verbatim(spark, d):
    return ingest.as_records(_fresh(spark, d), T.now()).select("id", "context_summary", _stamp("valid_from"), F.array_join("tags", ",").alias("tags"))


@_add("write_rows", P.query(P.RECORDS, select=f"SELECT id, CASE WHEN occurred_at IS NULL THEN '2024-03-01 00:00:00' ELSE {P.stamp('occurred_at')} END AS valid_from, user_id || '|' || agent_type || '|' || project_id AS scope_key FROM records"))
def write_rows(spark, d):
    rows = T.records(spark, d).withColumn("valid_from", F.coalesce("occurred_at", T.now()))
    return rows.select("id", _stamp("valid_from"), text.scope_key(F.col("user_id"), F.col("agent_type"), F.col("project_id")).alias("scope_key"))


@_add("scope_key", P.query(P.RECORDS, select="SELECT user_id || '|' || agent_type || '|' || CASE WHEN project_id = 'en' THEN 'global' ELSE project_id END AS scope_key, count(*) AS n FROM records GROUP BY 1"))
def scope_key(spark, d):
    rows = T.records(spark, d).withColumn("project_id", F.when(F.col("project_id") != "en", F.col("project_id")))
    return rows.groupBy(text.scope_key(F.col("user_id"), F.col("agent_type"), F.col("project_id")).alias("scope_key")).agg(F.count("*").alias("n"))


@_add("ingest_idempotent", "SELECT conv_id, turn FROM conversations WHERE turn % 2 = 1 OR conv_id % 3 = 0")
def ingest_idempotent(spark, d):
    said = T.table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("source_message_id"))
    stored = said.where("turn % 2 = 0 AND conv_id % 3 <> 0")
    return ingest.unseen_sources(said, stored).select("conv_id", "turn")


@_add("ingest_idempotent_summary", "SELECT conv_id, turn FROM conversations WHERE turn % 4 <> 0 OR conv_id % 3 = 0")
def ingest_idempotent_summary(spark, d):
    """With summaries: of what is stored, half has another one."""
    said = T.table(spark, d, "conversations").select("conv_id", "turn", "text", F.concat_ws(":", "conv_id", "turn").alias("source_message_id"))
    stored = said.where("turn % 2 = 0 AND conv_id % 3 <> 0").withColumn("text", F.when(F.col("turn") % 4 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return ingest.unseen_sources(said, stored, summary="text").select("conv_id", "turn")


@_add("receipts", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'new' WHEN event_id % 5 = 0 THEN 'conflict' ELSE 'repeated' END AS outcome FROM events")
def receipts(spark, d):
    events = T.table(spark, d, "events")
    requests = events.select("event_id", F.col("event_id").alias("id"), hashing.payload_digest(F.col("props")).alias("digest"))
    ledger = events.where("event_id % 3 <> 0").select(F.col("event_id").alias("id"), hashing.payload_digest(F.concat("props", F.when(F.col("event_id") % 5 == 0, "x").otherwise(""))).alias("payload_sha256"))
    return ingest.receipts(requests, ledger).select("event_id", "outcome")


@_add("reconcile_tags", P.query(P.RECORDS, f"wanted AS (SELECT DISTINCT scope_key, {P.label('raw')} AS label FROM (SELECT user_id || '|' || agent_type || '|' || project_id AS scope_key, unnest(tags) AS raw FROM records))", select=f"SELECT scope_key, label, {uuid_sql(chr(39).join(['scope_key || ', '|', ' || label']))} AS id FROM wanted WHERE label <> '' AND NOT (scope_key LIKE '0|%' AND length(label) % 2 = 0)"))
def reconcile_tags(spark, d):
    rows = T.records(spark, d).select("user_id", "agent_type", "project_id", "tags")
    known = ingest.reconciled_tags(rows, spark.createDataFrame([], "scope_key string, label string")).where("scope_key LIKE '0|%' AND length(label) % 2 = 0")
    return ingest.reconciled_tags(rows, known).select("scope_key", "label", "id")


@_add("chunk_dedup", "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id % 7, text ORDER BY conv_id, turn) = 1")
def chunk_dedup(spark, d):
    said = T.table(spark, d, "conversations").select("conv_id", "turn", (F.col("conv_id") % 7).alias("world"), F.struct("conv_id", "turn").alias("pos"), "text")
    return ingest.distinct_chunks(said).select("conv_id", "turn")


@_add("identity_conflicts", "SELECT source, count(DISTINCT lang) AS contents FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def identity_conflicts(spark, d):
    return ingest.identity_conflicts(T.table(spark, d, "documents"), "source", "lang")


@_add("dedup_ids", "SELECT doc_id % 97 AS id, min(doc_id) AS pos FROM documents GROUP BY 1")
def dedup_ids(spark, d):
    ids = T.table(spark, d, "documents").select((F.col("doc_id") % 97).alias("id"), F.col("doc_id").alias("pos"))
    return ids.groupBy("id").agg(F.min("pos").alias("pos"))


# groups: every nine consecutive records of a pool are one
_GROUPS = "grouped AS (SELECT id, id // 9 AS group_id FROM records WHERE is_active)"


def _groups(spark, d):
    return T.records(spark, d).where("is_active").select("id", F.floor(F.col("id") / 9).alias("group_id"))


def _dated(spark, d):
    return T.records(spark, d).withColumn("valid_from", F.coalesce("occurred_at", T.now()))


@_add("supersede_conflict", P.query(P.RECORDS, _GROUPS, select="SELECT g.group_id, r.id, first(r.id) OVER w AS superseded_by_id, strftime(first(coalesce(r.occurred_at, TIMESTAMP '2024-03-01')) OVER w, '%Y-%m-%d %H:%M:%S') AS valid_to, r.is_active FROM records AS r JOIN grouped AS g ON g.id = r.id WINDOW w AS (PARTITION BY g.group_id ORDER BY coalesce(r.occurred_at, TIMESTAMP '2024-03-01') DESC, r.created_at DESC, r.id DESC) QUALIFY row_number() OVER w > 1"))
def supersede_conflict(spark, d):
    return lifecycle.superseded(_dated(spark, d), _groups(spark, d)).select("group_id", "id", "superseded_by_id", _stamp("valid_to"), "is_active")


_UNION_SQL = "SELECT group_id, string_agg(t, ' ; ' ORDER BY first_at) AS context_summary FROM (SELECT g.group_id, trim(r.context_summary) AS t, min(r.id) AS first_at FROM (SELECT id, CASE WHEN length(regexp_replace(context_summary, '\\s+', '', 'g')) > 0 THEN context_summary WHEN length(regexp_replace(content, '\\s+', '', 'g')) > 0 THEN content ELSE '' END AS context_summary FROM records) AS r JOIN grouped AS g ON g.id = r.id WHERE trim(r.context_summary) <> '' GROUP BY 1, 2) GROUP BY group_id"


@_add("union_summary", P.query(P.RECORDS, _GROUPS, select=_UNION_SQL))
def union_summary(spark, d):
    return lifecycle.roots(T.records(spark, d), _groups(spark, d)).select("group_id", "context_summary")


@_add("merge_tags", P.query(P.RECORDS, _GROUPS, select="SELECT group_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM (SELECT DISTINCT g.group_id, unnest(r.tags) AS tag FROM records AS r JOIN grouped AS g ON g.id = r.id) GROUP BY group_id"))
def merge_tags(spark, d):
    return lifecycle.roots(T.records(spark, d), _groups(spark, d)).select("group_id", F.array_join("tags", ",").alias("tags"))


_ROOT = uuid_sql("'root|' || group_id::VARCHAR")


@_add("merge_root", P.query(P.RECORDS, _GROUPS, select=f"SELECT group_id, {_ROOT} AS id, strftime(min(r.created_at), '%Y-%m-%d %H:%M:%S') AS created_at, strftime(min(r.occurred_at), '%Y-%m-%d %H:%M:%S') AS occurred_at, arg_max(r.user_id, r.id) AS user_id, arg_max(r.agent_type, r.id) AS agent_type, arg_max(r.project_id, r.id) AS project_id, 0 AS hit_count, count(*) AS sources FROM records AS r JOIN grouped AS g ON g.id = r.id GROUP BY group_id"))
def merge_root(spark, d):
    return lifecycle.roots(T.records(spark, d), _groups(spark, d)).select("group_id", "id", _stamp("created_at"), _stamp("occurred_at"), "user_id", "agent_type", "project_id", "hit_count", "sources")


@_add("manual_supersede", P.query(P.RECORDS, select="SELECT id, is_active AND NOT (id % 20 = 3 AND id + 1 < (SELECT count(*) FROM records)) AS is_active, CASE WHEN id % 20 = 3 AND id + 1 < (SELECT count(*) FROM records) THEN id + 1 END AS superseded_by_id FROM records"))
def manual_supersede(spark, d):
    rows = T.records(spark, d)
    pairs = rows.select((F.col("id") - 1).alias("id"), F.col("id").alias("by")).where("id % 20 = 3")
    return lifecycle.manually_superseded(rows, pairs, T.now()).select("id", "is_active", "superseded_by_id")


_ASKED = "asked AS (SELECT id // 12 AS group_id, id AS pos, id FROM records WHERE id % 12 IN (0, 6) OR id % 60 = 1 UNION ALL SELECT id // 12, id + 1000000, id FROM records WHERE id % 12 = 0)"


@_add("manual_merge", P.query(P.RECORDS, _ASKED, "scoped AS (SELECT DISTINCT a.group_id, r.id, r.user_id, r.agent_type, r.project_id, r.customer_id FROM asked AS a JOIN records AS r ON r.id = a.id)", "good AS (SELECT group_id FROM scoped GROUP BY group_id HAVING count(*) >= 2 AND count(DISTINCT (user_id, agent_type, project_id, customer_id)) = 1)", select="SELECT group_id, id FROM scoped WHERE group_id IN (SELECT group_id FROM good)"))
def manual_merge(spark, d):
    rows = T.records(spark, d)
    one = rows.where("id % 12 IN (0, 6) OR id % 60 = 1").select(F.floor(F.col("id") / 12).alias("group_id"), F.col("id").alias("pos"), "id")
    again = rows.where("id % 12 = 0").select(F.floor(F.col("id") / 12).alias("group_id"), (F.col("id") + 1_000_000).alias("pos"), "id")
    return lifecycle.merge_groups(rows, one.unionByName(again))


@_add("supersession_chain", "WITH RECURSIVE edges AS (SELECT doc_id AS id, doc_id + 7 AS nxt FROM documents WHERE doc_id % 3 <> 0 AND doc_id + 7 IN (SELECT doc_id FROM documents)), walk AS (SELECT id, nxt AS cur, 1 AS depth FROM edges UNION ALL SELECT w.id, e.nxt, w.depth + 1 FROM walk AS w JOIN edges AS e ON e.id = w.cur) SELECT id, arg_max(cur, depth) AS current, max(depth) AS depth FROM walk GROUP BY id")
def supersession_chain(spark, d):
    docs = T.table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    then = docs.select((F.col("id") - 7).alias("id"), F.col("id").alias("superseded_by_id")).where("id % 3 <> 0")
    return lifecycle.chains(docs.join(then, "id", "left"))


@_add("ledger_upsert", "SELECT user_id AS scope, max(event_id) AS id FROM events GROUP BY 1")
def ledger_upsert(spark, d):
    """The later half of the events as runs over a ledger of the earlier half; event ids stand for times."""
    runs = T.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("scope_key"), F.col("event_id").alias("last_run_at"))
    half = runs.agg(F.max("id")).first()[0] // 2
    return lifecycle.latest_runs(runs.where(F.col("id") <= half), runs.where(F.col("id") > half)).select(F.col("scope_key").alias("scope"), "id")


@_add("cosine_pairs", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS cosine FROM embeddings AS a JOIN embeddings AS b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, d):
    from ..functions.vectors import cosine

    one = T.table(spark, d, "embeddings").select(F.col("vec_id").alias("a"), F.col("embedding").alias("va"))
    two = T.table(spark, d, "embeddings").select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("vb"))
    return one.join(two, "a").select("a", "b", F.round(cosine(F.col("va"), F.col("vb")), 9).alias("cosine"))


# versions

_MERGE = (
    "base AS (SELECT doc_id AS id, lang, n_chars FROM documents WHERE doc_id % 10 <> 9)",
    "ours AS (SELECT id, lang, CASE WHEN id % 10 IN (1, 3) THEN n_chars + 1 ELSE n_chars END AS n_chars FROM base WHERE id % 10 <> 2 UNION ALL SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 10 = 9)",
    "latest AS (SELECT id, lang, CASE WHEN id % 10 IN (3, 4) THEN n_chars + 2 ELSE n_chars END AS n_chars FROM base WHERE id % 10 <> 5 UNION ALL SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 20 = 19)",
)


def _versions(spark, d):
    docs = T.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "n_chars")
    base, new = docs.where("id % 10 <> 9"), docs.where("id % 10 = 9")
    ours = base.where("id % 10 <> 2").withColumn("n_chars", F.when(F.expr("id % 10 IN (1, 3)"), F.col("n_chars") + 1).otherwise(F.col("n_chars"))).unionByName(new)
    latest = base.where("id % 10 <> 5").withColumn("n_chars", F.when(F.expr("id % 10 IN (3, 4)"), F.col("n_chars") + 2).otherwise(F.col("n_chars"))).unionByName(new.where("id % 20 = 19"))
    return base, ours, latest


_SAME = "{a}.n_chars IS NOT DISTINCT FROM {b}.n_chars AND {a}.lang IS NOT DISTINCT FROM {b}.lang"


@_add("three_way_merge", P.query(*_MERGE, select=f"SELECT id, CASE WHEN {_SAME.format(a='b', b='o')} THEN 'keep' WHEN {_SAME.format(a='b', b='l')} THEN CASE WHEN b.lang IS NULL THEN 'insert' WHEN o.lang IS NULL THEN 'delete' ELSE 'update' END WHEN o.lang IS NULL AND l.lang IS NULL THEN 'none' WHEN b.lang IS NULL AND {_SAME.format(a='o', b='l')} THEN 'none' ELSE 'conflict' END AS action FROM base AS b FULL JOIN ours AS o USING (id) FULL JOIN latest AS l USING (id)"))
def three_way_merge(spark, d):
    return merge.three_way(*_versions(spark, d), "id")


@_add("snapshot_verify", P.query(*_MERGE, select="SELECT side, count(*) AS n FROM (SELECT 'left' AS side, * FROM (SELECT * FROM ours EXCEPT ALL SELECT * FROM latest) UNION ALL SELECT 'right', * FROM (SELECT * FROM latest EXCEPT ALL SELECT * FROM ours)) GROUP BY side"))
def snapshot_verify(spark, d):
    _, ours, latest = _versions(spark, d)
    return merge.differences(ours, latest).groupBy("side").agg(F.count("*").alias("n"))


@_add("coverage_check", "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'missing' ELSE 'extra' END AS state FROM documents WHERE (doc_id % 3 = 0) <> (doc_id % 2 = 0)")
def coverage_check(spark, d):
    ids = T.table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return merge.coverage(ids.where("id % 3 = 0"), ids.where("id % 2 = 0"), "id")


@_add("snapshot_read", "SELECT item_id, text FROM benchmark")
def snapshot_read(spark, d):
    """The benchmark table published to a store of versions and read back."""
    from ..sources.snapshots import Snapshots
    from ..sources.shared import new_path

    store = Snapshots(spark, new_path(spark, "versions"), "item_id", 4)
    store.publish(T.table(spark, d, "benchmark"), None)
    return store.read()


# identifiers

@_add("uuid5", P.query(P.RECORDS, select=f"SELECT id, {uuid_sql('id::VARCHAR')} AS uuid FROM records"))
def uuid5(spark, d):
    return T.records(spark, d).select("id", hashing.uuid5(NS, F.col("id").cast("string")).alias("uuid"))


@_add("payload_digest", "SELECT event_id, sha256(props) AS digest FROM events")
def payload_digest(spark, d):
    return T.table(spark, d, "events").select("event_id", hashing.payload_digest(F.col("props")).alias("digest"))


@_add("card_ids", P.query(P.RECORDS, select="SELECT id, substring(sha1(encode(trim(context_summary))), 1, 12) AS card FROM records"))
def card_ids(spark, d):
    return T.records(spark, d).select("id", hashing.card_id(F.col("context_summary")).alias("card"))


@_add("hash_embedding", P.query(P.QUESTIONS, "raw AS (SELECT qid, query, list_transform(range(0, 384), lambda i: (('0x' || substring(sha256(query), ((i % 32) * 2 + 1)::INTEGER, 2))::INTEGER - 128) / 128.0::DOUBLE) AS v FROM questions)", select="SELECT qid, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 9) AS first, round(v[384] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 9) AS last, len(v)::INTEGER AS width FROM raw"))
def hash_embedding(spark, d):
    made = T.questions(spark, d).select("qid", hashing.hash_embedding(F.col("query")).alias("v"))
    return made.select("qid", F.round(F.col("v")[0], 9).alias("first"), F.round(F.col("v")[383], 9).alias("last"), F.size("v").alias("width"))
