"""Fact storing: modes, outages, what is stored already, outcomes of odd messages."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lorekeep.config import Config
from lorekeep.operators.facts import ExtractionUnavailable, Fact, resolved, store_facts

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers have no test modules


class Rule:
    """Lines as facts, of a message that begins with ``down`` no answer."""

    def atomic(self, content):
        if content.startswith("down"):
            raise ExtractionUnavailable("out")
        return [Fact(x, ["Line Tag"], "2024-02-03" if "dated" in x else None) for x in content.split("\n")]

    def summary(self, content, gate):
        if content.startswith("down"):
            raise ExtractionUnavailable("out")
        return Fact("" if gate and "chat" in content else content[:12])

    def two_section(self, content):
        return self.summary(content, True), "agent said"

    def plain(self, content):
        return Fact(content[:4])


NOW = "2024-03-01 00:00:00"
SAID = [(1, "one\n \ndated two\none"), (2, "one\nthree"), (3, " \n"), (4, None), (5, "down again"), (6, "chat only"), (7, "stored"), (8, "ended")]


def run(spark, mode, config=Config()):
    messages = spark.createDataFrame(SAID, "message_id long, content string").selectExpr("*", "0L AS user_id", "'a' AS agent_type", "CAST(NULL AS string) AS project_id", "'c' AS customer_id", "'ann' AS contributor")
    stored = spark.createDataFrame([("stored", True), ("ended", False)], "context_summary string, is_active boolean").selectExpr("*", "0L AS user_id", "'a' AS agent_type", "CAST(NULL AS string) AS project_id")
    rows, outcomes = store_facts(messages, stored, Rule, F.lit(NOW).cast("timestamp"), config, mode)
    return {r.context_summary: r for r in rows.collect()}, {r.message_id: r for r in outcomes.collect()}


def test_atomic(spark):
    rows, outcomes = run(spark, "atomic")
    assert set(rows) == {"one", "dated two", "three", "down", "chat only", "ended"}
    assert rows["one"].content == SAID[0][1] and rows["one"].customer_id == "c" and rows["one"].agent_summary is None
    assert rows["one"].tags == ["by:ann", "line-tag"] and rows["dated two"].occurred_at.day == 3 and rows["one"].valid_from == rows["one"].created_at
    assert {i: (r.written, r.written_chars, r.degraded, r.reason) for i, r in outcomes.items()} == {
        1: (2, 12, False, None), 2: (1, 5, False, None), 3: (0, 0, False, "empty"), 4: (0, 0, False, "empty"), 5: (1, 4, True, "extraction unavailable (out); plain summary"),
        6: (1, 9, False, None), 7: (0, 0, False, None), 8: (1, 5, False, None),
    }


def test_gated_and_summary(spark):
    rows, outcomes = run(spark, "gated")
    assert "chat only" not in rows and rows["ended"].agent_summary == "agent said"
    assert outcomes[6].reason == "nothing worth storing" and not outcomes[6].degraded
    assert (outcomes[5].written, outcomes[5].degraded, outcomes[5].reason) == (0, True, "extraction unavailable (out); not stored")
    rows, outcomes = run(spark, "summary")
    assert rows["chat only"].agent_summary is None and outcomes[6].written == 1
    plain, _ = run(spark, "gated", Config(two_section=False))
    assert plain["ended"].agent_summary is None


def test_auto(spark):
    assert resolved("auto", Config()) == "gated" and resolved("auto", Config(atomic_facts=True)) == "atomic"
    assert {r.mode for r in run(spark, "auto")[1].values()} == {"gated"}
    with pytest.raises(ValueError, match="mode"):
        run(spark, "verbatim")


def test_batches_are_bounded(spark):
    """A Python worker gets few rows and bytes at once, however many a session would send; a smaller bound of the session stays."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = {k: spark.conf.get(k) for k in (rows, size)}
    try:
        spark.conf.set(rows, "10000")
        spark.conf.set(size, str(1 << 30))
        run(spark, "atomic")
        assert int(spark.conf.get(rows)) <= 2000 and int(spark.conf.get(size)) <= 16 << 20
        spark.conf.set(rows, "7")
        run(spark, "summary")
        assert spark.conf.get(rows) == "7"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
