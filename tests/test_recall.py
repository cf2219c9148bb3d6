"""Invariants of recall: batches, partitions, bounds, reserved places, legs."""

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from test_oracle import rows

from lorekeep import plans
from lorekeep.functions import text
from lorekeep.operators import recall as R
from lorekeep.operators.scope import as_of, own, team
from lorekeep.plans.recall import CALLER, CONFIG
from lorekeep.sources import tables as T

_COLUMNS = ("qid", "place", "section", "id", "matched")


def plan(spark, data, questions=None, config=CONFIG):
    asked = T.questions(spark, data) if questions is None else questions
    return {tuple(r) for r in R.two_sections(T.records(spark, data), asked, CALLER, T.now(), config).select(*_COLUMNS).collect()}


def test_one_by_one_equals_batched(spark, data):
    batched = plan(spark, data)
    asked = T.questions(spark, data)
    for qid in (0, 3):
        assert plan(spark, data, asked.where(F.col("qid") == qid)) == {r for r in batched if r[0] == qid}


def test_partitions_do_not_matter(spark, data):
    before = plan(spark, data)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert plan(spark, data, T.questions(spark, data).repartition(5)) == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_bounds_scope_and_sizes(spark, data):
    records = T.records(spark, data)
    mine = {r.id: r.occurred_at for r in records.where(own(CALLER)).select("id", "occurred_at").collect()}
    theirs = {r.id: r.occurred_at for r in records.where(team(CALLER)).select("id", "occurred_at").collect()}
    assert not set(mine) & set(theirs)
    bounds = {r.qid: r.as_of for r in T.questions(spark, data).collect()}
    seen = set()
    for qid, place, section, record, _ in plan(spark, data):
        times = mine if section == "own" else theirs
        assert record in times and 1 <= place <= CONFIG.k
        assert bounds[qid] is None or times[record] <= bounds[qid]
        assert (qid, record) not in seen
        seen.add((qid, record))


def test_small_k_is_all_reserve(spark):
    rows = [(0, i, 1.0 / i if i < 4 else 0.0, i, f"2024-01-{10 + i}", None if i == 2 else f"2024-02-{20 - i}") for i in range(1, 6)]
    ranked = spark.createDataFrame(rows, "qid long, id long, rrf double, rank int, created string, occurred string").selectExpr("qid", "id", "rrf", "rank", "to_timestamp(created) AS created_at", "to_timestamp(occurred) AS occurred_at")
    found = R.chosen(ranked, F.lit(2), CONFIG).orderBy("position").collect()
    # matched ones by event time, the undated by time of writing
    assert [r.id for r in found] == [1, 3]
    assert R.chosen(ranked, F.lit(-1), CONFIG).count() == 0
    assert [r.id for r in R.chosen(ranked, F.lit(5), CONFIG).orderBy("position").collect()][:2] == [1, 2]
    assert R.chosen(ranked, F.lit(9), CONFIG).count() == 5


def test_leg_off_takes_its_matches(spark):
    records = spark.createDataFrame(
        [(1, "a canine companion", ["household-pet"], [1.0, 0.0]), (2, "the quarterly budget", ["finance"], [0.0, 1.0])], "id long, content string, tags array<string>, embedding array<float>"
    ).selectExpr("id", "content", "content AS context_summary", "tags", "embedding", "timestamp'2024-01-01' AS created_at", "CAST(NULL AS timestamp) AS occurred_at", "0L AS hit_count")
    asked = spark.createDataFrame([(0, "dog welcoming behaviour", [0.9, 0.1])], "qid long, query string, vector array<float>").selectExpr("*", "CAST(NULL AS timestamp) AS as_of")
    ranked = lambda config: {r.id: r.rrf for r in R.candidates(R.prepared(records), asked, T.now(), config).collect()}
    assert ranked(CONFIG)[1] > ranked(CONFIG)[2] > 0
    off = ranked(CONFIG.but(weight_vector=0.0))
    assert off == {1: 0.0, 2: 0.0}


def test_no_python_no_product_and_early_limits_in_the_plan(spark, data, capsys):
    R.recall(T.records(spark, data), T.questions(spark, data), CALLER, T.now(), CONFIG).explain("formatted")
    said = capsys.readouterr().out
    assert "Python" not in said and "CartesianProduct" not in said
    assert "WindowGroupLimit" in said
    # the texts are scanned by the table of prepared records, each leg reads its own columns of that
    assert "ReadSchema: struct<id:bigint,created_at:timestamp,occurred_at:timestamp,tags:array<string>>" in said
    R.prepared(T.records(spark, data).where(own(CALLER))).select("id", "_tokens").explain("formatted")
    said = capsys.readouterr().out
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in said and "Python" not in said


@pytest.mark.parametrize("name", ["recent_leg", "lexical_leg", "recall_full"])
def test_default_settings(name, spark):
    """With more records than the small settings rank, the default ones reach as far as their SQL."""
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    frame = plans.QUERIES[name](spark, folder)
    said = con.execute(plans.ORACLE[name])
    columns = [c[0] for c in said.description]
    made = frame.collect()
    assert rows(frame.columns, made) == rows(columns, said.fetchall())
    most = max(Counter(r.qid for r in made).values())
    assert most == 24 if name == "recall_full" else 24 < most <= 200


def _exchanges(rows):
    return rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_terms_of_a_record_are_sent_once(spark, data):
    hits = R.term_hits(R.kept(T.records(spark, data).where("is_active")), T.questions(spark, data), CONFIG)
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", hits._jdf.queryExecution().executedPlan().toString())
    assert len([k for k in keys if re.search(r"\bid#", k)]) == 1  # the other is that of the questions' terms


@pytest.mark.parametrize("most_bytes", [CONFIG.max_broadcast_bytes, 0])
def test_tasks_grow_with_the_pairs_of_records_and_questions(spark, data, monkeypatch, most_bytes):
    """A task is dealt a bounded number of pairs, nothing is gathered or sorted for it beside; the counts are those of the texts."""
    monkeypatch.setattr("lorekeep.operators.sizes.TASK_PAIRS", 500)
    scoped, asked = T.records(spark, data).where("is_active"), T.questions(spark, data)
    hits = R.term_hits(R.kept(scoped), asked, CONFIG.but(max_broadcast_bytes=most_bytes))
    said = hits._jdf.queryExecution().executedPlan().toString()
    tasks = -(-scoped.count() * asked.count() // 500)
    assert tasks > 4 and re.search(rf"Exchange hashpartitioning\(id#\d+L?, {tasks}\), REPARTITION_BY_NUM", said)
    assert "ObjectHashAggregate" not in said and ("ShuffledHashJoin" in said) == (most_bytes == 0)
    overlap = text.term_overlap(text.query_terms(F.col("query")), text.haystack(F.col("content"), F.col("context_summary")))
    pairs = scoped.crossJoin(asked).where(as_of()).select("qid", "id", "created_at", overlap.alias("overlap")).where("overlap > 0")
    assert {tuple(r) for r in hits.collect()} == {tuple(r) for r in pairs.collect()}


def test_texts_are_not_shuffled_for_holders(spark, data):
    from lorekeep.operators import evaluation

    items = T.questions(spark, data).select("qid", "query")
    assert _exchanges(evaluation.holders(T.table(spark, data, "documents"), items, 1 << 20)) == 0


def test_payload_reads_no_texts_again(spark, data):
    """What the payload holds was kept when the sections were read: the last plan has no scan of the documents."""
    out = R.recall(T.records(spark, data), T.questions(spark, data), CALLER, T.now(), CONFIG)
    assert "documents.parquet" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.id, r.summary, r.occurred_on, r.by) for r in out.collect()}
    rows_ = T.records(spark, data).select("id", R.recalled_summary(), F.date_format("occurred_at", "yyyy-MM-dd"), R.contributors(F.col("tags")))
    assert got and got <= {tuple(r) for r in rows_.collect()}
