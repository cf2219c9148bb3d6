"""Queries of single functions over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, hashing, parsing, text
from ..operators import ingest
from ..sources import dialogues
from ..sources import tables as T
from . import prelude as P

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def _stamp(column, name: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(name)


@_add("evidence_split", "SELECT doc_id, 'D' || doc_id || ':1,D' || (doc_id + 1) || ':2' AS ids FROM documents")
def evidence_split(spark, d):
    raw = F.concat(F.lit("D"), "doc_id", F.lit(":1;  D"), F.col("doc_id") + 1, F.lit(":2 , D"), "doc_id", F.lit(":1;"))
    return T.table(spark, d, "documents").select("doc_id", F.array_join(text.evidence_ids(raw), ",").alias("ids"))


@_add("split_tags", "SELECT doc_id, lang || '|' || source AS tags FROM documents")
def split_tags(spark, d):
    return T.table(spark, d, "documents").select("doc_id", F.array_join(text.split_tags(F.concat(F.lit(" "), "lang", F.lit(", ,"), "source", F.lit(" "))), "|").alias("tags"))


@_add("photo_tags", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '[Sharing image that shows: ' || lang || ']' WHEN 2 THEN '[Sharing image - query for: ' || source || ']' ELSE '[Sharing image - query: ' || source || '. The image shows: ' || lang || ']' END AS tag FROM documents")
def photo_tags(spark, d):
    caption = F.when(F.col("doc_id") % 2 == 1, F.col("lang"))
    query = F.when(F.col("doc_id") % 4 >= 2, F.col("source")).otherwise("")
    return T.table(spark, d, "documents").select("doc_id", dialogues.photo_tag(caption, query).alias("tag"))


@_add("facts_block", "SELECT conv_id, string_agg('- ' || text, chr(10) ORDER BY turn) AS block FROM conversations GROUP BY 1")
def facts_block(spark, d):
    said = T.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return said.select("conv_id", text.facts_block(F.transform("x", lambda t: t["text"])).alias("block"))


@_add("field_caps", "SELECT doc_id, length(substring(text, 1, 4000)) AS excerpt, length(substring(text, 1, 240)) AS summary, length(substring(text, 1, 300)) AS agent_summary FROM documents")
def field_caps(spark, d):
    cap = lambda n: F.length(F.substring("text", 1, n))
    return T.table(spark, d, "documents").select("doc_id", cap(text.EXCERPT).alias("excerpt"), cap(text.SUMMARY).alias("summary"), cap(text.AGENT_SUMMARY).alias("agent_summary"))


@_add("recency_decay", P.query(P.RECORDS, select=f"SELECT id, round(greatest(epoch_us({P.NOW}) - epoch_us(created_at), 0) / 86400000000.0, 9) AS age, round(pow(2.0, -greatest(epoch_us({P.NOW}) - epoch_us(created_at), 0) / 86400000000.0 / 7.0), 9) AS decay FROM records"))
def recency_decay(spark, d):
    return T.records(spark, d).select("id", F.round(dates.age_days(F.col("created_at"), T.now()), 9).alias("age"), F.round(dates.recency(F.col("created_at"), T.now(), 7.0), 9).alias("decay"))


@_add("millis_to_time", "SELECT event_id, strftime(make_timestamp(1704067200000000 + event_id * 1000000), '%Y-%m-%d %H:%M:%S') AS at FROM events".replace(" AS at FROM", " AS moment FROM"))
def millis_to_time(spark, d):
    return T.table(spark, d, "events").select("event_id", _stamp(dates.from_millis(F.lit(1704067200000) + F.col("event_id") * 1000), "moment"))


@_add("dialogue_dates", "SELECT event_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS moment FROM events")
def dialogue_dates(spark, d):
    """Times written as dialogues write them and read again."""
    events = T.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.select("event_id", _stamp(dates.dialogue_time(F.date_format("ts", "h:mm a 'on' d MMMM, yyyy")), "moment"))


@_add("history_dates", "SELECT event_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS moment FROM events")
def history_dates(spark, d):
    events = T.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.select("event_id", _stamp(dates.history_time(F.date_format("ts", "yyyy/MM/dd (EEE) HH:mm")), "moment"))


@_add("iso_dates", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(date_trunc('second', ts) - INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') END AS moment FROM events")
def iso_dates(spark, d):
    """A date, a time with an offset, and no date at all."""
    events = T.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    said = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 3 == 1, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+03:00"))).otherwise("one day")
    return events.select("event_id", _stamp(dates.iso_instant(said), "moment"))


@_add("date_guard", f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 OR regexp_matches(substring(CASE WHEN doc_id % 3 = 0 THEN text || ' Seen in March.' ELSE text END, 1, {text.EXCERPT}), '{dates.EXPLICIT_DATE}') THEN '2024-01-01 00:00:00' END AS occurred_at FROM documents")
def date_guard(spark, d):
    """Whole texts, a third of them with a month at the end, where a model that reads an excerpt may not see it."""
    said = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" Seen in March."))).otherwise(F.col("text"))
    reference = F.when(F.col("doc_id") % 2 == 0, F.lit("2024-01-05").cast("timestamp"))
    return T.table(spark, d, "documents").select("doc_id", _stamp(dates.guarded_date(F.lit("2024-01-01").cast("timestamp"), said, reference), "occurred_at"))


@_add("anchor_lines", "SELECT doc_id, 'Reference date: ' || strftime(TIMESTAMP '2024-01-01' + to_days((doc_id % 400)::INTEGER), '%Y-%m-%d (%A)') AS line FROM documents")
def anchor_lines(spark, d):
    return T.table(spark, d, "documents").select("doc_id", dates.anchor_line(F.timestamp_seconds(F.lit(1704067200) + (F.col("doc_id") % 400) * 86400)).alias("line"))


@_add("reply_extraction", "SELECT doc_id, 'about ' || source AS summary, lang AS tags, doc_id % 2 = 0 AS worth FROM documents")
def reply_extraction(spark, d):
    reply = F.concat(F.lit('Sure:\n{"summary": " about '), "source", F.lit('", "tags": ["'), "lang", F.lit('", " "], "worth_remembering": '), (F.col("doc_id") % 2 == 0).cast("string"), F.lit("}"))
    x = T.table(spark, d, "documents").select("doc_id", parsing.extraction(reply).alias("x"))
    return x.select("doc_id", "x.summary", F.array_join("x.tags", ",").alias("tags"), "x.worth")


@_add("reply_facts", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS n, lang AS first FROM documents")
def reply_facts(spark, d):
    fact = F.concat(F.lit('{"summary": "'), "lang", F.lit('"}'))
    reply = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Facts: ["), fact, F.lit(", "), fact, F.lit(', {"summary": ""}]'))).otherwise(fact)
    x = T.table(spark, d, "documents").select("doc_id", parsing.atomic_facts(reply).alias("x"))
    return x.select("doc_id", F.size("x").alias("n"), F.col("x")[0]["summary"].alias("first"))


@_add("reply_verdicts", "SELECT doc_id, quality = 1 AS verdict, CASE WHEN toxic = 1 THEN 'conflict' ELSE 'distinct_facts' END AS relation FROM labels")
def reply_verdicts(spark, d):
    said = F.when(F.col("quality") == 1, "It is CORRECT").otherwise("INCORRECT (not CORRECT)")
    kind = F.when(F.col("toxic") == 1, " Conflict").otherwise("maybe")
    return T.table(spark, d, "labels").select("doc_id", parsing.verdict(said).alias("verdict"), parsing.relation(kind).alias("relation"))


@_add("step_targets", "SELECT doc_id, doc_id || ',' || (doc_id + 1) AS ids FROM documents")
def step_targets(spark, d):
    a, b = F.col("doc_id"), F.col("doc_id") + 1
    flat = F.concat(F.lit("["), a, F.lit(", "), b, F.lit("]"))
    nested = F.concat(F.lit("[["), a, F.lit(", 0], ["), b, F.lit(", 3]]"))
    target = F.when(F.col("doc_id") % 2 == 0, flat).otherwise(nested)
    return T.table(spark, d, "documents").select("doc_id", F.array_join(parsing.step_ids(target).cast("array<string>"), ",").alias("ids"))


@_add("event_props", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def event_props(spark, d):
    return T.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@_add("canonical_payload", "SELECT event_id, sha256('{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}') AS digest FROM events")
def canonical_payload(spark, d):
    return T.table(spark, d, "events").select("event_id", hashing.payload_digest(hashing.canonical_json("user_id", "event_type")).alias("digest"))


@_add("refused_messages", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'blank content' WHEN role NOT IN ('user', 'assistant') THEN 'unknown role' ELSE 'timestamp out of range' END AS reason FROM conversations WHERE turn % 3 = 0 OR role NOT IN ('user', 'assistant') OR conv_id % 5 = 0")
def refused_messages(spark, d):
    said = T.table(spark, d, "conversations")
    rows = said.select("conv_id", "turn", "role", F.when(F.col("turn") % 3 != 0, F.col("text")).otherwise(" ").alias("content"), F.when(F.col("conv_id") % 5 == 0, F.lit(10**18)).otherwise(F.lit(0)).alias("timestamp"))
    return ingest.invalid(rows).select("conv_id", "turn", "reason")


@_add("state_records", "SELECT conv_id, turn AS step, 'step ' || turn || ' [' || role || '] ' || text AS record, sha256(text) AS digest FROM conversations")
def state_records(spark, d):
    """Trajectories of states as one text record a state, with a digest of what was seen."""
    paths = T.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("states"))
    each = paths.select("conv_id", F.explode("states").alias("s"))
    return each.select("conv_id", F.col("s.turn").alias("step"), F.concat(F.lit("step "), "s.turn", F.lit(" ["), "s.role", F.lit("] "), "s.text").alias("record"), hashing.payload_digest(F.col("s.text")).alias("digest"))
