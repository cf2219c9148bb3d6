"""The stored lexical index gives the rows of the lexical leg, from fewer blocks; parts, scopes, bounds in time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.config import Config
from lorekeep.operators import lexicon as L
from lorekeep.operators import recall as R
from lorekeep.operators.scope import Caller, own, team
from lorekeep.sources import tables as T

CALLER = Caller(0, "p0", "p", "c")


def records(spark, n=3000, start=0, seed=1):
    draw = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in ("com", "river", "stone", "tion", "alp") for b in ("mon", "bed", "wall", "ing", "x9")]
    rows = [(start + i, int(i % 3 == 0), f"common {' '.join(words[j] for j in draw.zipf(1.6, 5) % 25)}" if i % 50 else None, "rarest" if i % 700 == 3 else "") for i in range(n)]
    frame = spark.createDataFrame(rows, "id long, user_id long, content string, context_summary string")
    return frame.selectExpr("*", "'p0' AS agent_type", "'p' AS project_id", "'c' AS customer_id", "id % 11 <> 0 AS is_active", "timestamp_seconds(1700000000 + id * 60) AS created_at", "CASE WHEN id % 7 <> 0 THEN timestamp_seconds(1700000000 + (id * 37 % 3000) * 60) END AS occurred_at", "0L AS hit_count", "array('t') AS tags", "CAST(NULL AS array<float>) AS embedding")


def asked(spark):
    late = 1700000000 + 1500 * 60
    rows = [(0, "common", None), (1, "common river wall", None), (2, "rarest common common", None), (3, "nothingness", None), (4, "mon com tion", late), (5, "rarest", late), (6, "", None), (7, "the and", None), (8, "omm", late), (9, "stonewall riverbed alpx9 commons", None)]
    return spark.createDataFrame(rows, "qid long, query string, bound long").selectExpr("qid", "query", "timestamp_seconds(bound) AS as_of")


def rows_of(frame):
    return sorted((r.qid, r["rank"], r.id, r.overlap) for r in frame.collect())


@pytest.mark.parametrize(("limit", "any_"), [(5, True), (200, True), (5, False)])
@pytest.mark.parametrize("who", [own, team])
def test_rows_of_the_leg(spark, tmp_path, limit, any_, who):
    config, rows, questions = Config(candidate_limit=limit, lexical_any=any_), records(spark), asked(spark)
    index = L.build(rows, str(tmp_path / "x"), block=64)
    said = rows_of(R.lexical_leg(R.prepared(rows.where(who(CALLER))), questions, config))
    assert said and rows_of(L.index_leg(index, questions, who(CALLER), config)) == said


def test_a_common_term_does_not_open_every_block(spark, tmp_path):
    rows, config = records(spark), Config(candidate_limit=20)
    index = L.build(rows, str(tmp_path / "x"), block=64)
    _, blocks = L.plan(index, asked(spark).where("qid < 3"), own(CALLER), config)
    opened = {r.qid: (r.n, r.every) for r in blocks.groupBy("qid").agg(F.count_if(F.col("before") < 20).alias("n"), F.count("*").alias("every")).collect()}
    assert all(every >= 25 for _, every in opened.values()) and opened[0][0] <= 2


def test_parts(spark, tmp_path):
    path, config, questions = str(tmp_path / "x"), Config(candidate_limit=30), asked(spark)
    one, two = records(spark, 600), records(spark, 500, start=10_000, seed=5)
    index = L.append(L.build(one, path, block=32), two, block=32)
    both = one.unionByName(two)
    assert rows_of(L.index_leg(index, questions, own(CALLER), config)) == rows_of(R.lexical_leg(R.prepared(both.where(own(CALLER))), questions, config))
    assert L.build(one, path).version == 2 and L.load(spark, path).blocks.select("part").distinct().count() == 1


def test_nothing(spark, tmp_path):
    index = L.build(records(spark, 10).limit(0), str(tmp_path / "x"))
    assert L.index_leg(index, asked(spark), own(CALLER), Config()).count() == 0


def test_test_tables(spark, data, tmp_path):
    rows, questions, who = T.records(spark, data), T.questions(spark, data), Caller(0, "p0", "en", "c0")
    index = L.build(rows, str(tmp_path / "x"), block=8)
    config = Config(candidate_limit=10)
    assert rows_of(L.index_leg(index, questions, own(who), config)) == rows_of(R.lexical_leg(R.prepared(rows.where(own(who))), questions, config))


def test_scopes_of_one_block_stay_apart(spark, tmp_path):
    """Lists take their scopes from their blocks: scopes that differ only in where a null stands have blocks of their own."""
    rows = records(spark, 40).where("content IS NOT NULL AND is_active")
    two = rows.withColumn("user_id", F.lit(0).cast("long")).withColumn("agent_type", F.when(F.col("id") % 2 == 0, "p")).withColumn("project_id", F.when(F.col("id") % 2 == 1, "p")).coalesce(1)
    index = L.build(two, str(tmp_path / "x"), block=64)
    stored = spark.read.parquet(f"{tmp_path}/x/postings")
    assert index.blocks.groupBy("part", "block", "cell").count().where("count > 1").isEmpty()
    assert stored.groupBy("token", "block", "cell").count().where("count > 1").isEmpty()
    who = F.col("agent_type").isNull() & (F.col("project_id") == "p")
    assert {r.id % 2 for r in L.index_leg(index, asked(spark), who, Config()).collect()} == {1}
