"""Pairs against brute force, and a consolidation pass on small known cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import consolidation as C
from lorekeep.operators import evaluation, grouping, ingest, lifecycle, scope

NEVER = ("confidential", "pinned")


def cosine(a, b):
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / (na * nb) if na * nb else -1.0


@pytest.mark.parametrize("tau", [0.2, 0.9, 0.999])
def test_pairs_equal_brute_force(spark, tau):
    draw = random.Random(int(tau * 1000))
    centres = [[draw.gauss(0, 1) for _ in range(5)] for _ in range(6)]
    rows = [(i, draw.choice(["p", "q", None]), [c + draw.gauss(0, 0.15) for c in draw.choice(centres)]) for i in range(150)]
    rows += [(150, "p", [0.0] * 5), (151, "p", [math.nan] * 5), (152, "p", None), (153, "p", rows[0][2]), (154, "p", rows[0][2])]
    frame = spark.createDataFrame(rows, "id long, pool string, embedding array<double>").withColumn("created_at", F.timestamp_seconds("id"))
    expected = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] and b[2] and not math.isnan(a[2][0] + b[2][0]) and round(cosine(a[2], b[2]), 9) >= tau}
    for pivots, cell, task in ((1, 100, 50), (4, 100, 1 << 20), (8, 30, 7), (16, 1 << 20, 1 << 20)):
        found = [(r.a, r.b) for r in grouping.near_pairs(frame, ["pool"], tau, pivots, 0 if pivots == 4 else 1 << 20, cell, task).collect()]
        assert len(found) == len(set(found)) and set(found) == expected


def test_work_on_clusters_is_below_quadratic(spark):
    """Four times the records, in four times the clusters: their cells have far less than sixteen times the pairs, and no cell is a pool."""
    import numpy as np

    pairs = []
    for n in (1000, 4000):
        draw = np.random.default_rng(n)
        held = draw.normal(size=(n // 40, 12))[draw.integers(0, n // 40, n)] + 0.05 * draw.normal(size=(n, 12))
        frame = spark.createDataFrame([(i, "p", [float(x) for x in v]) for i, v in enumerate(held)], "id long, pool string, embedding array<double>").withColumn("created_at", F.timestamp_seconds("id"))
        sizes = grouping.cells(frame, ["pool"], 0.95, cell_pairs=10_000).groupBy("cell").agg(F.first("pairs").alias("pairs"), F.count("*").alias("n")).collect()
        pairs.append(sum(r.pairs for r in sizes))
        assert max(r.n for r in sizes) < n
    assert pairs[1] < 10 * pairs[0] and pairs[1] < 4000**2 / 10


def test_vectors_without_clusters_are_not_copied_to_pivots(spark):
    """A cut that gains nothing is not kept, however many records a cell has; pairs of many parts, and of two lengths, are those of a product."""
    import numpy as np

    draw = np.random.default_rng(5)
    held = [draw.normal(size=16 if i % 3 else 12) for i in range(600)]
    frame = spark.createDataFrame([(i, "p", [float(x) for x in v]) for i, v in enumerate(held)], "id long, pool string, embedding array<double>").withColumn("created_at", F.timestamp_seconds(F.lit(1000) - F.col("id")))
    alike = frame.where("size(embedding) = 16")
    assert alike.count() == 400 == grouping.cells(alike, ["pool"], 0.3, pivots=2, cell_pairs=10_000).count()
    unit = [v / np.linalg.norm(v) for v in held]
    expected = {(a, b) for b in range(600) for a in range(b + 1, 600) if len(unit[a]) == len(unit[b]) and round(float(unit[a] @ unit[b]), 9) >= 0.3}
    found = [(r.a, r.b) for r in grouping.near_pairs(frame, ["pool"], 0.3, task_pairs=200**2).select("a", "b").collect()]
    assert len(found) == len(expected) and set(found) == expected


def memories(spark):
    """Two pools of the same two groups and a record of its own; a record that ended, a protected one."""
    near, far = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = []
    for at, user in ((0, 0), (10, 1)):
        rows += [
            (f"m{at}", user, near, "seats: 4", at, None, ["x"], True),
            (f"m{at + 1}", user, near, "seats: 5", at + 1, None, ["y"], True),
            (f"m{at + 2}", user, far, "  ", at + 2, None, None, True),
            (f"m{at + 3}", user, far, "door is blue", at + 3, None, ["z"], True),
            (f"m{at + 4}", user, [0.0, 0.0, 1.0], "alone", at + 4, None, [], True),
            (f"m{at + 5}", user, near, "ended", at + 5, at + 6, [], True),
            (f"m{at + 6}", user, near, "kept", at + 6, None, ["pinned"], True),
            (f"m{at + 7}", user, near, "gone", at + 7, None, [], False),
        ]
    frame = spark.createDataFrame(rows, "id string, user_id long, embedding array<double>, context_summary string, n long, ends long, tags array<string>, is_active boolean")
    return frame.selectExpr(
        "id", "user_id", "'a' AS agent_type", "CAST(NULL AS STRING) AS project_id", "'c' AS customer_id", "embedding", "context_summary", "context_summary AS content", "timestamp_seconds(n) AS created_at", "CAST(NULL AS TIMESTAMP) AS occurred_at",
        "timestamp_seconds(n) AS valid_from", "timestamp_seconds(ends) AS valid_to", "tags", "is_active", "3L AS hit_count", "CAST(NULL AS STRING) AS parent_id", "CAST(NULL AS STRING) AS superseded_by_id",
    )


def test_groups_of_a_pass(spark):
    rows = memories(spark)
    every = {"m0": {"m0", "m1"}, "m2": {"m2", "m3"}, "m10": {"m10", "m11"}, "m12": {"m12", "m13"}}
    for most, expected in ((0, every), (1, {k: every[k] for k in ("m0", "m10")})):
        found = {}
        for r in C.groups(rows, 0.9, NEVER, most).collect():
            found.setdefault(r.group_id, set()).add(r.id)
        assert found == expected


def test_pass(spark):
    rows = memories(spark)
    groups = C.groups(rows, 0.9, NEVER)
    replies = spark.createDataFrame([("m0", "CONFLICT "), ("m2", "restatement"), ("m10", "no idea")], "group_id string, reply string")
    routes = C.routes(rows, groups, replies)
    assert {r.group_id: (r.route, r.calls) for r in routes.collect()} == {"m0": ("conflict", 1), "m2": ("merge", 1), "m10": ("distinct", 1), "m12": ("distinct", 1)}
    after = {r.id: r for r in C.applied(rows, groups, routes).collect()}
    assert len(after) == 17
    (root,) = set(after) - {r.id for r in rows.collect()}
    assert after["m0"].superseded_by_id == "m1" and after["m0"].is_active and after["m0"].valid_to == after["m1"].valid_from
    assert after["m1"].superseded_by_id is None and after["m1"].valid_to is None
    for one in ("m2", "m3"):  # a merge archives; only one by hand ends its sources
        assert not after[one].is_active and after[one].parent_id == root and after[one].valid_to is None
    assert (after[root].content, after[root].hit_count, after[root].is_active, after[root].customer_id) == ("door is blue", 0, True, "c")
    assert after[root].created_at == after["m2"].created_at and after[root].valid_from == after["m2"].created_at
    assert after["m5"].valid_to is not None and after["m10"].is_active
    report = {r.scope_key: r.asDict() for r in C.report(rows, routes).collect()}
    assert report["0|a|global"] == {"scope_key": "0|a|global", "groups": 2, "synthesized": 1, "archived": 2, "superseded": 1, "errors": 0, "cost_calls": 2, "memories_before": 7, "memories_after": 6}
    assert report["1|a|global"]["memories_after"] == 7
    # a second pass over what is left finds nothing more to merge
    again = C.groups(C.applied(rows, groups, routes), 0.9, NEVER)
    assert {r.group_id for r in again.collect()} == {"m10", "m12"}


def test_a_failed_merge_changes_nothing(spark):
    rows = memories(spark)
    groups = C.groups(rows, 0.9, NEVER)
    merged = spark.createDataFrame([("m0", " "), ("m2", "a blue door")], "group_id string, text string")
    routes = C.routes(rows, groups, merged=merged)
    assert {r.group_id: (r.route, r.calls) for r in routes.collect()} == {"m0": ("error", 1), "m2": ("merge", 1), "m10": ("error", 1), "m12": ("error", 1)}
    after = {r.id: r for r in C.applied(rows, groups, routes).collect()}
    assert len(after) == 17 and after["m0"].is_active and after["m0"].valid_to is None
    assert [r.errors for r in C.report(rows, routes).orderBy("scope_key").collect()] == [1, 2]


def test_merge_by_hand_ends_its_sources(spark):
    rows = memories(spark)
    groups = spark.createDataFrame([("g", "m0"), ("g", "m4")], "group_id string, id string")
    after = {r.id: r for r in lifecycle.archived(rows, groups, F.timestamp_seconds(F.lit(99))).collect()}
    assert after["m0"].superseded_by_id == after["m0"].parent_id and after["m0"].valid_to.second == 39 and after["m1"].valid_to is None and after["m5"].valid_to is not None


def test_scope_gate(spark):
    rows = memories(spark)
    assert scope.in_scope(rows, scope.Caller(5, "other", None, "c"), "m1").first().context_summary == "seats: 5"
    with pytest.raises(ValueError, match="not found"):
        scope.in_scope(rows, scope.Caller(0, "a", None, "c"), "m99")
    for caller in (scope.Caller(0, "a", "p", "c"), scope.Caller(0, "a", None, "d")):
        with pytest.raises(ValueError, match="out of scope"):
            scope.in_scope(rows, caller, "m1")


def test_sources_with_summaries(spark):
    said = spark.createDataFrame([("s", "one"), ("s", "two"), ("t", "one"), (None, "one")], "source_message_id string, summary string")
    stored = spark.createDataFrame([("s", "one"), ("t", "other")], "source_message_id string, summary string")
    assert {tuple(r) for r in ingest.unseen_sources(said, stored).collect()} == {(None, "one")}
    assert {(r.source_message_id, r.summary) for r in ingest.unseen_sources(said, stored, "source_message_id", "summary").collect()} == {("s", "two"), ("t", "one"), (None, "one")}


@pytest.mark.parametrize("share", [0.001, 0.25, 1.0])
def test_share_of_questions(spark, share):
    import hashlib

    items = spark.range(2000)
    order = sorted(range(2000), key=lambda i: (hashlib.sha256(str(i).encode()).hexdigest(), i))
    assert sorted(r.id for r in evaluation.share_of(items, "id", share).collect()) == sorted(order[: math.ceil(2000 * share)])
    with pytest.raises(ValueError):
        evaluation.share_of(items, "id", 0.0)
