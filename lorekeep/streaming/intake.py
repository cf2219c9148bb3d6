"""Intake of requests into a versioned table: a batch of a stream is one commit, of rows and receipts together.

A request (request_id, user_id, session_id, messages) is taken once: the same payload under its id again does nothing, another one is a conflict and
is not taken. Rows and receipts are rows of one table (``kind``), so one move of the pointer shows both or neither, and a batch that is replayed after
a failure finds its receipts. If a message has no vector the whole batch fails and nothing is written. Nothing is kept on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators.ingest import NAMESPACE, invalid, receipts
from ..sources.shared import written
from ..sources.snapshots import Snapshots

REQUEST = "request_id string, user_id string, session_id string, messages array<struct<role: string, content: string, timestamp: long>>"
STORED = "id string, kind string, payload_sha256 string, user_id string, session_id string, pos int, role string, content string, occurred_at timestamp, embedding array<float>"


class MissingVector(RuntimeError):
    """A message has got no vector: its batch is not stored."""


def _columns() -> list[str]:
    return [x.split()[0] for x in STORED.split(", ")]


def judged(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Requests with id (of the receipt), digest and outcome: new, repeated, conflict, or invalid. Of several in a batch the first payload by digest counts."""
    digest = F.sha2(F.to_json(F.struct("user_id", "session_id", "messages"), {"ignoreNullFields": "false"}), 256)
    named = requests.withColumns({"id": hashing.uuid5(NAMESPACE, F.to_json(F.array(F.lit("request"), "user_id", "request_id"))), "digest": digest})
    said = receipts(named, stored.where("kind = 'receipt'").select("id", "payload_sha256"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("digest"))
    first = F.min("digest").over(Window.partitionBy("id"))
    said = said.withColumns({"_n": place, "_first": first})
    again = F.when(F.col("digest") == F.col("_first"), "repeated").otherwise("conflict")
    outcome = F.when((F.col("outcome") == "new") & (F.col("_n") > 1), again).otherwise(F.col("outcome"))
    messages = named.select("id", "digest", F.explode("messages").alias("m")).select("id", "digest", "m.*")
    bad = invalid(messages.withColumn("timestamp", F.coalesce("timestamp", F.lit(0)))).select("id", "digest", F.lit(True).alias("_bad")).distinct()
    known = said.join(bad, ["id", "digest"], "left")
    empty = F.coalesce(F.size("messages"), F.lit(0)) < 1
    return known.withColumn("outcome", F.when(F.col("_bad") | empty, "invalid").otherwise(outcome)).drop("_n", "_first", "_bad")


def rows_of(taken: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """The rows and receipts of new requests."""
    each = taken.select(F.col("id").alias("receipt"), "user_id", "session_id", F.posexplode("messages").alias("pos", "m"))
    content = F.trim("m.content")
    rows = each.select(
        hashing.uuid5(NAMESPACE, F.to_json(F.array("receipt", F.col("pos").cast("string")))).alias("id"), F.lit("row").alias("kind"), F.lit(None).cast("string").alias("payload_sha256"),
        "user_id", "session_id", "pos", F.col("m.role").alias("role"), content.alias("content"), F.timestamp_millis("m.timestamp").alias("occurred_at"), embed(content).alias("embedding"),
    )
    none = {"session_id": "string", "pos": "int", "role": "string", "content": "string", "occurred_at": "timestamp", "embedding": "array<float>"}
    kept = taken.select("id", F.lit("receipt").alias("kind"), F.col("digest").alias("payload_sha256"), "user_id", *(F.lit(None).cast(kind).alias(name) for name, kind in none.items()))
    return rows.unionByName(kept).select(*_columns())


def commit(batch: DataFrame, table: Snapshots, embed: Callable[[Column], Column]) -> DataFrame:
    """Store a batch; returns its requests with their outcomes. Commits of others meanwhile are merged with, as ``Snapshots.commit`` does."""
    base, _ = table.manifest()
    stored = table.read(base)
    stored = batch.sparkSession.createDataFrame([], STORED) if stored is None else stored
    said = written(judged(batch, stored), "requests")
    fresh = written(rows_of(said.where("outcome = 'new'"), embed), "rows")  # vectors are made once
    missing = fresh.where("kind = 'row' AND embedding IS NULL").select("id").limit(1).collect()
    if missing:
        raise MissingVector(missing[0].id)
    if fresh.limit(1).count():
        table.commit(base, stored.unionByName(fresh))
    return said.select("request_id", "user_id", "outcome")


def intake(requests: DataFrame, table: Snapshots, embed: Callable[[Column], Column], checkpoint: str):
    """The stream's writer: each batch is one ``commit``."""

    def store(batch: DataFrame, _: int) -> None:
        commit(batch, table, embed)

    return requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
