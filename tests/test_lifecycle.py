"""Grouping, merging, versions, ingest on small known cases."""

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import grouping, ingest, lifecycle, merge
from lorekeep.sources.snapshots import FileStore, HadoopStore, PublicationConflict, Snapshots, open_store

A, B, C, FAR = [1.0, 0.0], [0.98, 0.02], [0.95, 0.05], [0.0, 1.0]


def groups(spark, vectors, tau):
    rows = spark.createDataFrame([(i, "p", v) for i, v in enumerate(vectors)], "id long, pool string, embedding array<float>").withColumn("created_at", F.timestamp_seconds("id"))
    found = grouping.groups(grouping.near_pairs(rows, ["pool"], tau)).collect()
    out = {}
    for r in found:
        out.setdefault(r.anchor, set()).add(r.id)
    return [sorted(v) for _, v in sorted(out.items())]


def test_groups(spark):
    assert groups(spark, [A, B, FAR], 0.85) == [[0, 1]]
    assert groups(spark, [A, B, C, FAR], 0.85) == [[0, 1, 2]]
    assert groups(spark, [A, C], 0.9999) == []


def test_groups_follow_the_greedy_order(spark):
    import math
    import random

    draw = random.Random(3)
    for _ in range(3):
        angles = [draw.uniform(0, 3) for _ in range(25)]
        anchors, expected = [], {}
        for i, a in enumerate(angles):
            near = next((j for j in anchors if math.cos(angles[j] - a) >= 0.97), None)
            if near is None:
                anchors.append(i)
            else:
                expected.setdefault(near, [near]).append(i)
        assert groups(spark, [[math.cos(a), math.sin(a)] for a in angles], 0.97) == [sorted(v) for _, v in sorted(expected.items())]


def test_three_way_merge(spark):
    table = lambda *rows: spark.createDataFrame(list(rows), "id string, hits long, receipt string")
    base = table(("a", 0, None), ("b", 0, None))
    # both count up the same row: a conflict though the values are equal
    actions = {r.id: r.action for r in merge.three_way(base, table(("a", 1, None), ("b", 0, None)), table(("a", 1, None), ("b", 0, None)), "id").collect()}
    assert actions == {"a": "conflict", "b": "keep"}
    with pytest.raises(ValueError, match="concurrent"):
        merge.merged(base, table(("a", 1, None), ("b", 0, None)), table(("a", 1, None), ("b", 0, None)), "id")
    # changes of different rows, and the same receipt inserted twice
    ours, latest = table(("a", 1, None), ("b", 0, None), ("r", 0, "x")), table(("a", 0, None), ("r", 0, "x"))
    assert {tuple(r) for r in merge.merged(base, ours, latest, "id").collect()} == {("a", 1, None), ("r", 0, "x")}


def test_versions(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/s", "id", 4)
    first = spark.createDataFrame([(i, f"v{i}") for i in range(40)], "id long, v string")
    store.publish(first, None)
    base, _ = store.manifest()
    assert merge.differences(store.read(), first).count() == 0
    parts = {p.name for p in (tmp_path / "s/parts").iterdir()}
    store.commit(base, first.withColumn("v", F.when(F.col("id") == 3, "new").otherwise(F.col("v"))))
    assert len({p.name for p in (tmp_path / "s/parts").iterdir()} - parts) == 1  # only the changed partition
    store.commit(base, first.unionByName(spark.createDataFrame([(99, "mine")], "id long, v string")))  # begun before
    rows = {r.id: r.v for r in store.read().collect()}
    assert rows[3] == "new" and rows[99] == "mine" and len(rows) == 41
    with pytest.raises(ValueError, match="concurrent"):
        store.commit(base, first.withColumn("v", F.when(F.col("id") == 3, "other").otherwise(F.col("v"))))
    manifest, _ = store.manifest()
    assert store.damaged() == []
    part, digest = next(iter(manifest["parts"].items()))
    spark.createDataFrame([(1, "forged")], "id long, v string").write.mode("overwrite").parquet(f"{tmp_path}/s/parts/{digest}")
    assert part in store.damaged()
    store.reset(first)
    assert store.read() is None and store.read(base) is not None


def test_store(tmp_path):
    store = FileStore(str(tmp_path / "o"))
    tag = store.put("x", b"1", None)
    with pytest.raises(PublicationConflict):
        store.put("x", b"2", None)
    store.put("x", b"2", tag)
    assert store.get("x")[0] == b"2" and store.get("y") is None
    with pytest.raises(ValueError):
        store.get("../secret")
    for bad in ("s3://b/k", "file://host/x", "file:///a?b"):
        with pytest.raises(ValueError):
            open_store(bad)


def test_second_ingest_writes_nothing(spark):
    facts = spark.createDataFrame([(0, "a", None, 0, "x "), (0, "a", None, 1, "x"), (0, "a", None, 2, "  "), (1, "a", None, 3, "x")], "user_id long, agent_type string, project_id string, pos long, summary string").selectExpr("*", "summary AS content", "CAST(NULL AS timestamp) AS occurred_at", "array('T a') AS tags")
    none = spark.createDataFrame([], "user_id long, agent_type string, project_id string, context_summary string, is_active boolean")
    fresh = ingest.new_facts(facts, none)
    assert sorted(r.pos for r in fresh.collect()) == [0, 3]
    stored = ingest.as_records(fresh, F.lit("2024-01-01").cast("timestamp"))
    assert stored.first().tags == ["t-a"]
    assert ingest.new_facts(facts, stored).count() == 0
    assert ingest.new_facts(facts, stored.withColumn("is_active", F.lit(False))).count() == 2


def test_conflict_keeps_both_active(spark):
    rows = spark.createDataFrame([(1, "2024-01-01", True), (2, "2024-06-01", True)], "id long, at string, is_active boolean").selectExpr("id", "to_timestamp(at) AS valid_from", "timestamp'2024-07-01' AS created_at", "is_active")
    found = lifecycle.superseded(rows, rows.selectExpr("id", "0 AS group_id")).collect()
    assert [(r.id, r.superseded_by_id, str(r.valid_to), r.is_active) for r in found] == [(1, 2, "2024-06-01 00:00:00", True)]


def test_numbered_versions(spark, tmp_path):
    store = HadoopStore(spark, f"file://{tmp_path}/h")
    assert store.get("x") is None
    tag = store.put("x", b"1", None)
    with pytest.raises(PublicationConflict):
        store.put("x", b"2", None)
    assert store.get("x") == (b"1", tag) and store.put("x", b"2", tag) > tag and store.get("x")[0] == b"2"


def test_long_chains(spark):
    """A chain of 10,000, short ones, a fork that meets it; rings are refused."""
    rows = [(i, i + 1) for i in range(10_000)] + [(10_000, None), (20_000, 9_990), (20_001, 20_002), (20_002, None), (20_003, None)]
    frame = spark.createDataFrame(rows, "id long, superseded_by_id long")
    made = {r.id: (r.current, r.depth) for r in lifecycle.chains(frame).collect()}
    assert made == {i: (10_000, 10_000 - i) for i in range(10_000)} | {20_000: (10_000, 11), 20_001: (20_002, 1)}
    with pytest.raises(ValueError, match="ring"):
        lifecycle.chains(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "id long, superseded_by_id long"))
    assert lifecycle.chains(frame.limit(0)).count() == 0
