"""The proximity index against the exact leg: recall, work, parts, scopes, what is not indexed; and the legs beyond the broadcast bound."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.config import Config
from lorekeep.operators import proximity as X
from lorekeep.operators import recall as R
from lorekeep.operators.scope import Caller, own
from lorekeep.sources import tables as T

CALLER = Caller(0, "a", "p", "c")
CONFIG = Config(candidate_limit=200)


def records(spark, n, seed=1, start=0):
    """Vectors around 60 centres; a third of them lies around one."""
    draw = np.random.default_rng(seed)
    centres = np.random.default_rng(7).normal(size=(60, 16))
    own_centre = np.where(draw.random(n) < 0.33, 0, draw.integers(0, 60, n))
    held = centres[own_centre] + 0.25 * draw.normal(size=(n, 16))
    rows = [(start + i, int(i % 2), [float(x) for x in held[i]], int(i % 400)) for i in range(n)]
    frame = spark.createDataFrame(rows, "id long, user_id long, embedding array<float>, day int")
    return frame.selectExpr("*", "'a' AS agent_type", "'p' AS project_id", "'c' AS customer_id", "true AS is_active", "timestamp_seconds(1700000000 + id) AS created_at", "timestamp_seconds(1700000000 + day * 86400) AS occurred_at", "0L AS hit_count", "'x' AS content", "'' AS context_summary", "array('t') AS tags")


def asked(spark, n=12):
    draw = np.random.default_rng(3)
    centres = np.random.default_rng(7).normal(size=(60, 16))
    rows = [(i, [float(x) for x in centres[(i * 5) % 60] + 0.25 * draw.normal(size=16)], None if i % 3 else 1700000000 + 200 * 86400) for i in range(n)]
    return spark.createDataFrame(rows, "qid long, vector array<float>, bound long").selectExpr("qid", "'q' AS query", "vector", "timestamp_seconds(bound) AS as_of")


def found(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.qid, {})[r.id] = r.cosine
    return out


def leg(index, rows, questions, **more):
    return found(X.index_leg(index, R.prepared(rows.where(own(CALLER))), questions, own(CALLER), CONFIG, **more))


def test_recall_and_work(spark, tmp_path):
    rows, questions = records(spark, 8000), asked(spark)
    index = X.build(rows, str(tmp_path / "x"))
    exact = found(R.vector_leg(R.prepared(rows.where(own(CALLER))), questions, CONFIG))
    near = leg(index, rows, questions)
    assert set(near) == set(exact)
    recall = [len(set(exact[q]) & set(near[q])) / len(exact[q]) for q in exact]
    assert min(recall) >= 0.9 and sum(recall) / len(recall) >= 0.95
    assert all(near[q][i] == exact[q][i] for q in exact for i in set(near[q]) & set(exact[q]))  # cosines are exact
    looked = X.probes(index, questions, own(CALLER), CONFIG.candidate_limit).join(index.lists.where(own(CALLER)).groupBy("list").count(), "list").agg(F.sum("count")).first()[0]
    assert looked < 0.5 * 4000 * 12
    everything = leg(index, rows, questions, least=64, enough=100, overfetch=100)
    assert everything == exact


def test_lists_are_opened_until_the_result_is_exact(spark, tmp_path):
    rows, questions = records(spark, 3000), asked(spark, 6)
    index = X.build(rows, str(tmp_path / "x"), lists=16)
    exact = found(R.vector_leg(R.prepared(rows.where(own(CALLER))), questions, CONFIG))
    assert leg(index, rows, questions, least=1, enough=1, overfetch=1) == exact


def test_only_probed_lists_are_joined(spark, tmp_path, capsys):
    rows, questions = records(spark, 2000), asked(spark, 2)
    index = X.build(rows, str(tmp_path / "x"), lists=16)
    wanted = X.probes(index, questions, own(CALLER), 10)
    X.candidates(index, wanted, own(CALLER), 40, 1 << 20).explain("formatted")
    said = capsys.readouterr().out
    assert "dynamicpruning" in said.lower() and "CartesianProduct" not in said


def test_parts_versions_and_broken_writes(spark, tmp_path):
    path, questions = str(tmp_path / "x"), asked(spark)
    one, two = records(spark, 1500), records(spark, 700, seed=2, start=5000)
    both = one.unionByName(two)
    index = X.append(X.build(one, path, lists=16), two)
    X._write_part(two, path, 1, 2, index.centres)  # finished
    spark.read.parquet(f"{path}/lists/version=1/part=0").limit(5).write.parquet(f"{path}/lists/version=1/part=9/list=0")  # not finished
    assert X.load(spark, path).lists.count() == 1500 + 700 + 700
    exact = found(R.vector_leg(R.prepared(both.where(own(CALLER))), questions, CONFIG))
    assert leg(index, both, questions, least=16, overfetch=50) == exact
    # what the records no longer have is not found, however old the index is
    fewer = both.where("id % 4 = 0")
    assert leg(index, fewer, questions, least=16, overfetch=50) == found(R.vector_leg(R.prepared(fewer.where(own(CALLER))), questions, CONFIG))
    again = X.build(one, path, lists=8)
    assert again.version == 2 and again.lists.count() == 1500 and len(again.centres) == 8
    with pytest.raises(ValueError, match="no index"):
        X.load(spark, str(tmp_path / "none"))


def test_what_is_not_indexed(spark, tmp_path):
    rows = records(spark, 30)
    odd = rows.limit(1).withColumn("embedding", F.expr("array_repeat(0f, 16)")).unionByName(rows.limit(1).withColumn("embedding", F.expr("array(1f, 2f)"))).unionByName(rows.limit(1).withColumn("embedding", F.lit(None).cast("array<float>"))).unionByName(rows.limit(1).withColumn("embedding", F.expr("array_repeat(CAST('NaN' AS float), 16)")))
    index = X.build(rows.unionByName(odd), str(tmp_path / "x"), lists=4)
    assert index.lists.count() == 30
    none = X.build(odd.where("embedding IS NULL"), str(tmp_path / "y"))
    assert none.lists.count() == 0 and leg(none, odd, asked(spark)) == {}


def test_legs_beyond_the_broadcast_bound(spark, data, capsys):
    rows, questions = R.prepared(T.records(spark, data).where("is_active")), T.questions(spark, data)
    tight = Config(max_broadcast_bytes=1)
    for made in (R.vector_leg, R.recent_leg):
        wide, narrow = made(rows, questions, Config()), made(rows, questions, tight)
        narrow.explain("formatted")
        said = capsys.readouterr().out
        assert "CartesianProduct" not in said and "_slot" in said
        assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, narrow.collect()))
