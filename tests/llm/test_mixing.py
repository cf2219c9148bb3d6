import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import EDGE, with_lost_row
from pyspark.sql import functions as F

from lorekeep.llm.mixing import apportioned, mix, mixed_texts, op13_mixing, steps, targets

SOURCES = ["b", "ä", "a", None, "Z", "long name"]


def table(texts, rows):
    """A third and more of the rows in one source; rows are (id, text)."""
    frame = texts(rows)
    names = F.array(*(F.lit(x) for x in SOURCES))
    return frame.withColumn("source", F.when(F.pmod("doc_id", F.lit(2)) == 0, "a").otherwise(names[F.pmod("doc_id", F.lit(len(SOURCES))).cast("int")]))


def said_targets(size, weight):
    """By the words of the contract."""
    total, out, free = sum(size), [0.0] * len(size), set(range(len(size)))
    while free:
        left = total - sum(out[i] for i in range(len(size)) if i not in free)
        share = {i: left * weight[i] / sum(weight[j] for j in free) for i in free}
        above = [i for i in free if share[i] > 3 * size[i]]
        for i in above or list(free):
            out[i] = 3.0 * size[i] if above else share[i]
        if not above:
            break
        free -= set(above)
    return out


def seats_one_by_one(votes, seats, most):
    out = [0] * len(votes)
    for _ in range(seats):
        able = [i for i in range(len(votes)) if votes[i] > 0 and out[i] < most[i]]
        if not able:
            break
        out[max(able, key=lambda i: (votes[i] / (2 * out[i] + 1), -i))] += 1
    return out


def test_apportionment_equals_one_by_one():
    draw = np.random.default_rng(5)
    for _ in range(400):
        n = int(draw.integers(1, 12))
        votes = draw.integers(0, 50, n) if draw.random() < 0.5 else draw.random(n) * 1000
        most = draw.integers(0, 40, n)
        seats = int(draw.integers(0, 200))
        assert list(apportioned(votes, seats, most)) == seats_one_by_one(list(votes), seats, list(most))
    assert list(apportioned(np.array([]), 5, np.array([]))) == []


def test_targets():
    draw = np.random.default_rng(6)
    for _ in range(300):
        size = draw.integers(0, 1000, int(draw.integers(1, 9)))
        weight = [(5, 2, 1)[i % 3] for i in range(len(size))]
        assert np.allclose(targets(size, np.array(weight, float)), said_targets(list(map(int, size)), weight))


def test_choice_of_blocks_has_its_number():
    for blocks in (1, 2, 7, 64, 1000):
        factor, shift = steps(blocks, [1, 2, 3])
        assert sorted((factor * j + shift) % blocks for j in range(blocks)) == list(range(blocks))


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(1)
    return [*EDGE, (5, "same id, other text"), *((int(i), " ".join(["wörd"] * int(draw.integers(1, 400)))) for i in range(100, 700)), (800, "\t".join(["long"] * 40_000))]


@pytest.mark.parametrize("shards", [1, 8, 1024])
def test_mix(texts, spark, rows, shards):
    frame = with_lost_row(spark, table(texts, rows).select("doc_id", "text", "score", "segment", "kept")).drop("source")
    frame = table(lambda _: frame, rows)
    made = mix(frame, shards=shards).collect()
    size_of = Counter((d, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t in rows)
    assert Counter((r.doc_id, r["size"]) for r in made) == size_of
    of_source, taken, aim = defaultdict(int), defaultdict(int), {}
    for r in made:
        of_source[r.source] += r["size"]
        taken[r.source] += r.taken
        aim[r.source] = r.target
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == sum((p["last"] - p["first"]) * p["copies"] for p in r.pieces)
        assert all(0 <= p["first"] < p["last"] <= r["size"] for p in r.pieces)
    names = sorted(of_source, key=lambda s: (s is None, s or ""))
    said = said_targets([of_source[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    assert all(r.source_size == of_source[r.source] for r in made) and np.allclose([aim[s] for s in names], said)
    assert all(abs(taken[s] - aim[s]) <= 40 for s in names)
    again = mix(frame.repartition(7), shards=shards).select("doc_id", "size", "taken").collect()
    assert Counter(map(tuple, again)) == Counter((r.doc_id, r["size"], r.taken) for r in made)


def test_texts_of_the_mix(texts, rows):
    some = [x for x in rows if x[0] != 5]
    frame = table(texts, some)
    plan = mix(frame, shards=8)
    got = defaultdict(int)
    for r in mixed_texts(frame, plan).collect():
        got[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) * r.copies
        assert r.text in dict(some)[r.doc_id]
    assert {r.doc_id: r.taken for r in plan.collect() if r.taken} == got


def test_little_and_nothing(texts):
    assert mix(table(texts, [])).count() == 0
    assert [(r["size"], r.target, r.taken) for r in mix(table(texts, [(1, None), (2, " ")])).collect()] == [(0, 0.0, 0)] * 2
    one = mix(table(texts, [(1, "three little words")])).collect()
    assert [(r["size"], r.target) for r in one] == [(3, 3.0)] and one[0].taken <= 9
    with pytest.raises(ValueError, match="sources"):
        mix(table(texts, EDGE), most_sources=1)


def test_query_comes_near_its_targets(spark, data):
    sums = op13_mixing(spark, data).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert len(sums) == 20 and all(abs(r.taken - r.target) <= 20 for r in sums)
