"""Batches of requests: taken once, replayed, in conflict, without vectors, by a stream."""

import pytest
from pyspark.sql import functions as F

from lorekeep.sources.snapshots import Snapshots
from lorekeep.streaming.intake import REQUEST, MissingVector, commit, intake


def embed(content):
    return F.when(content != "no vector", F.array(F.length(content).cast("float")))


def batch(spark, *requests):
    rows = [(i, u, "s", [{"role": role, "content": c, "timestamp": t} for role, c, t in messages]) for i, u, messages in requests]
    return spark.createDataFrame(rows, REQUEST)


ONE = ("r1", "ann", [("user", " hello ", 1700000000000), ("assistant", "there", None)])
TWO = ("r2", "ann", [("user", "again", None)])
OTHER = ("r1", "ann", [("user", "another payload", None)])
SAME_ID = ("r1", "bob", [("user", "mine", None)])


def said(frame):
    return sorted((r.request_id, r.user_id, r.outcome) for r in frame.collect())


def test_commits(spark, tmp_path):
    table = Snapshots(spark, f"file://{tmp_path}/t", "id", 4)
    assert said(commit(batch(spark, ONE, ONE), table, embed)) == [("r1", "ann", "new"), ("r1", "ann", "repeated")]
    rows = table.read().where("kind = 'row'").orderBy("pos").collect()
    assert [(r.content, r.role, r.embedding) for r in rows] == [("hello", "user", [5.0]), ("there", "assistant", [5.0])] and rows[0].occurred_at.year == 2023
    before = table.manifest()
    # a replayed batch, and one in conflict, change nothing: not even the pointer moves
    assert said(commit(batch(spark, ONE), table, embed)) == [("r1", "ann", "repeated")]
    assert said(commit(batch(spark, OTHER), table, embed)) == [("r1", "ann", "conflict")]
    assert table.manifest() == before
    assert said(commit(batch(spark, OTHER, TWO, SAME_ID), table, embed)) == [("r1", "ann", "conflict"), ("r1", "bob", "new"), ("r2", "ann", "new")]
    assert table.read().groupBy("kind").count().collect() and {r.kind: r["count"] for r in table.read().groupBy("kind").count().collect()} == {"row": 4, "receipt": 3}


def test_a_batch_is_stored_whole_or_not(spark, tmp_path):
    table = Snapshots(spark, f"file://{tmp_path}/t", "id", 4)
    with pytest.raises(MissingVector):
        commit(batch(spark, TWO, ("r3", "ann", [("user", "no vector", None)])), table, embed)
    assert table.read() is None
    bad = [("r4", "ann", [("user", "  ", None)]), ("r5", "ann", [("system", "x", None)]), ("r6", "ann", []), ("r7", "ann", [("user", "x", 10**18)])]
    assert {x[2] for x in said(commit(batch(spark, *bad), table, embed))} == {"invalid"} and table.read() is None


def test_stream(spark, tmp_path):
    table = Snapshots(spark, f"file://{tmp_path}/t", "id", 4)
    for i, requests in enumerate(([ONE, TWO], [ONE, SAME_ID])):
        batch(spark, *requests).coalesce(1).write.json(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        intake(stream, table, embed, f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    assert {r.kind: r["count"] for r in table.read().groupBy("kind").count().collect()} == {"row": 4, "receipt": 3}
    # a stream that has lost its checkpoint takes nothing twice
    intake(stream, table, embed, f"{tmp_path}/d").trigger(availableNow=True).start().awaitTermination(120)
    assert table.read().count() == 7
