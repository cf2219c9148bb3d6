"""Queries that read the benchmark formats, from files made of the test tables, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import dialogues
from ..sources import tables as T
from ..sources.shared import new_path
from . import evaluation

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


@_add("source_histories", "SELECT 'history_q' || conv_id AS conversation_id, 's' || conv_id || ':' || (turn) AS turn_id, role AS speaker, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations WHERE regexp_replace(text, '\\s+', '', 'g') <> ''")
def source_histories(spark, d):
    """The conversations written as chat histories and read by their reader."""
    said = T.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    rows = said.select(
        F.concat(F.lit("q"), "conv_id").alias("question_id"), F.lit("multi-session").alias("question_type"), F.lit("?").alias("question"), F.lit("-").alias("answer"), F.lit("2023/05/07 (Sun) 13:56").alias("question_date"),
        F.array(F.transform("x", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"), F.lit(False).alias("has_answer")))).alias("haystack_sessions"),
        F.array(F.concat(F.lit("s"), "conv_id")).alias("haystack_session_ids"), F.array(F.lit("2023/05/07 (Sun) 13:56")).alias("haystack_dates"), F.array(F.lit("s")).alias("answer_session_ids"),
    )
    path = new_path(spark, "files")
    rows.write.json(path)
    turns, _ = dialogues.histories(spark, path, lines=True)
    return turns.select("conversation_id", "turn_id", "speaker", "text")


@_add("source_long_documents", f"SELECT pos, size, digest FROM ({evaluation.ORACLE['chunk_document']})")
def source_long_documents(spark, d):
    """The documents written as JSON lines and read by their reader."""
    path = new_path(spark, "files")
    T.table(spark, d, "documents").select(F.col("source").alias("input"), F.col("text").alias("context"), F.array("lang").alias("answers")).write.json(path)
    turns, _ = dialogues.long_documents(spark, path)
    return turns.select(F.col("turn_pos").alias("pos"), F.length("text").alias("size"), F.md5(F.encode("text", "UTF-8")).alias("digest"))
