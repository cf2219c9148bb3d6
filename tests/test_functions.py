"""Column functions on known values."""

import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import dates, hashing, parsing, text, vectors
from lorekeep.operators import evaluation


@pytest.fixture(scope="module")
def one(spark):
    frame = spark.range(1)
    return lambda column: frame.select(column.alias("x")).first().x


def test_query_terms(one):
    assert one(text.query_terms(F.lit("How did the PLL loop-filter behave"))) == ["pll", "loop", "filter", "behave"]
    assert one(text.query_terms(F.lit("pll " * 12))) == ["pll"] * 8
    assert one(text.query_terms(F.lit(""))) == []


def test_overlap_counts_repeated_terms(one):
    assert one(text.term_overlap(F.array(F.lit("ab"), F.lit("ab"), F.lit("zz")), F.lit("xABx"))) == 2


def test_labels(one):
    assert one(text.normalize_label(F.lit("  Phase _ Noise "))) == "phase-noise"
    assert one(text.query_labels(F.lit("Phase noise"))) == ["phase", "noise", "phase-noise"]
    assert one(text.scope_key(F.lit("u"), F.lit("a"), F.lit(""))) == "u|a|global"


def test_blank_does_not_shadow(one):
    assert one(text.first_nonblank(F.lit(" \n"), F.lit("b"))) == "b"
    assert one(text.first_nonblank(F.lit(None).cast("string"), F.lit(" "))) == ""


def test_uuid5(one):
    ns = "6f0d7c1e-52a4-4d0b-9a57-3b0f5a2c9e11"
    for name in ("", "a", "é|x", "user|7"):
        assert one(hashing.uuid5(ns, F.lit(name))) == str(uuid.uuid5(uuid.UUID(ns), name))


def test_hash_embedding_is_a_unit_vector(one):
    assert one(F.round(vectors.norm(hashing.hash_embedding(F.lit("x"))), 9)) == 1.0
    assert one(hashing.hash_embedding(F.lit("  "))) is None


def test_cosine(one):
    a, b, zero = (F.array(*map(F.lit, v)) for v in ((1.0, 0.0), (1.0, 1.0), (0.0, 0.0)))
    assert one(F.round(vectors.cosine(a, b), 6)) == 0.707107
    assert one(vectors.cosine(a, zero)) == -1.0


@pytest.mark.parametrize(
    ("said", "expected"),
    [("1:30 pm on 7 May, 2023", datetime(2023, 5, 7, 13, 30)), ("7 May 2023", datetime(2023, 5, 7)), ("May 7, 2023", datetime(2023, 5, 7)), ("nonsense", None)],
)
def test_dialogue_time(one, said, expected):
    assert one(dates.dialogue_time(F.lit(said))) == expected


def test_other_dates(one):
    assert one(dates.history_time(F.lit("2023/05/07 (Sun) 13:56"))) == datetime(2023, 5, 7, 13, 56)
    assert one(dates.time_in_text(F.lit("'2024-10-01 08:00' Tuesday"))) == datetime(2024, 10, 1, 8)
    assert one(dates.end_of_day(F.lit("2023-05-30 23:40:00").cast("timestamp"))) == datetime(2023, 5, 30, 23, 59, 59, 999999)
    assert one(dates.iso_instant(F.lit("2026-01-01T01:00:00+03:00"))) == datetime(2025, 12, 31, 22)
    assert one(dates.iso_instant(F.lit("soon"))) is None
    assert one(dates.guarded_date(F.lit("2024-01-01").cast("timestamp"), F.lit("we met"), F.lit(None).cast("timestamp"))) is None


def test_word_windows(one):
    long = " ".join(f"w{i}" for i in range(450))
    out = one(text.word_windows(F.lit(f"a  b\n\n{long}\n \n")))
    assert out[0] == "a  b" and [len(x.split()) for x in out[1:]] == [200, 200, 50]
    assert one(text.word_windows(F.lit(""))) == []


def test_parsers(one):
    assert one(parsing.extraction(F.lit('```json\n{"summary": " s ", "tags": ["a", " "]}\n```')))["tags"] == ["a"]
    assert one(parsing.extraction(F.lit("no object"))) is None
    assert [x.summary for x in one(parsing.atomic_facts(F.lit('Facts: [{"summary": "a"}, {"summary": ""}]')))] == ["a"]
    assert [x.summary for x in one(parsing.atomic_facts(F.lit('{"summary": "one"}')))] == ["one"]
    assert one(parsing.judge_label(F.lit('so {"label": "CORRECT"}'))) is True
    assert one(parsing.judge_label(F.lit("who knows"))) is False
    assert one(parsing.verdict(F.lit("INCORRECT, not CORRECT"))) is False
    assert one(parsing.relation(F.lit(" Conflict "))) == "conflict"
    assert one(parsing.relation(F.lit("else"))) == "distinct_facts"
    assert one(parsing.step_ids(F.lit("[[3, 0], [4, 1]]"))) == [3, 4]
    assert one(parsing.step_ids(F.lit("[3, 4]"))) == [3, 4]


def test_metrics(one):
    ids = lambda *x: F.array(*map(F.lit, x))
    gold, none = ids("a", "b"), F.array().cast("array<string>")
    assert one(evaluation.recall_at(gold, ids("a", "c", "b", "d"), 2)) == 0.5
    assert one(evaluation.recall_at(none, gold, 2)) is None
    assert one(evaluation.reciprocal_rank(ids("b"), ids("a", "b", "c"))) == 0.5
    assert one(F.round(evaluation.ndcg_at(ids("a"), ids("b", "a", "c"), 3), 6)) == 0.63093
    assert one(F.round(evaluation.token_f1(F.lit("cat"), F.lit("the cat sat")), 6)) == 0.666667
    assert one(evaluation.token_f1(F.lit(""), F.lit(""))) == 1.0
    assert one(evaluation.exact_match(F.lit("The Cat."), F.lit("the cat"))) == 1.0
    assert one(evaluation.best_over(evaluation.exact_match, F.lit("x"), ids("y", "X!"))) == 1.0
    assert one(evaluation.best_over(evaluation.exact_match, F.lit("x"), none)) == 0.0


def test_run_statistics(spark):
    rows = spark.createDataFrame([("r", 0.5), ("r", 0.7), ("r", 0.6), ("one", 1.0)], "k string, v double")
    found = {r.k: r for r in evaluation.run_statistics(rows, "v", "k").collect()}
    assert found["r"].mean == pytest.approx(0.6) and found["r"].deviation == pytest.approx((0.02 / 3) ** 0.5)
    assert found["one"].deviation == 0


def test_strict_dates_and_the_excerpt_of_the_guard(spark):
    said = spark.createDataFrame([(1, "2024-02-03"), (2, " 2024-02-03T04:05:06+01:00 "), (3, "  "), (4, None)], "n int, said string")
    made = {r.n: r.at for r in said.select("n", F.date_format(dates.iso_instant_strict(F.col("said")), "yyyy-MM-dd HH:mm:ss").alias("at")).collect()}
    assert made == {1: "2024-02-03 00:00:00", 2: "2024-02-03 03:05:06", 3: None, 4: None}
    with pytest.raises(Exception, match="no ISO date: soon"):
        spark.createDataFrame([("soon",)], "said string").select(dates.iso_instant_strict(F.col("said"))).collect()
    texts = spark.createDataFrame([("x" * 3990 + " in May",), ("x" * 3995 + " in May",), ("year 1999",), ("mayor",), (None,)], "t string")
    assert [r[0] for r in texts.select(F.coalesce(dates.has_explicit_date(F.col("t")), F.lit(False))).collect()] == [True, False, True, False, False]


def test_mean_pool(spark):
    """The unit mean of what the mask keeps."""
    rows = spark.createDataFrame([([[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[0.0, 2.0]], [1]), ([[1.0, 1.0]], [0])], "v array<array<double>>, m array<int>")
    made = [[round(x, 9) for x in r[0]] for r in rows.select(vectors.mean_pool(F.col("v"), F.col("m"))).collect()]
    assert made == [[0.6, 0.8], [0.0, 1.0], [0.0, 0.0]]
