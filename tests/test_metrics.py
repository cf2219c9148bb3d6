"""Metrics on long answers, and the token recall, against counting."""

import random
import re
import time
from collections import Counter
from math import exp

from pyspark.sql import functions as F

from lorekeep.operators import evaluation


def test_long_answers(spark):
    """Each text is cut once and tokens are counted in one pass, so that time does not grow with the square of a line."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(5000)}x" for _ in range(16000)]
    rows = [(0, " ".join(words[:8000]), " ".join(words[8000:])), (1, "b b a1 b", "b a1 a1 b c"), (2, None, "x"), (3, None, ""), (4, "the", "an"), (5, "b b", "b")]
    df = spark.createDataFrame(rows, "i int, p string, g string").repartition(1)
    start = time.monotonic()
    got = {r.i: r for r in df.select("i", evaluation.token_f1(F.col("p"), F.col("g")).alias("f1"), evaluation.bleu1(F.col("p"), F.col("g")).alias("bleu")).collect()}
    assert time.monotonic() - start < 20
    for i, p, g in rows:
        p, g = ([w for w in (x or "").split() if w not in ("a", "an", "the")] for x in (p, g))
        same = sum((Counter(p) & Counter(g)).values())
        f1, bleu = (2 * same / (len(p) + len(g)), (1 if len(p) >= len(g) else exp(1 - len(g) / len(p))) * same / len(p)) if p and g else (float(p == g),) * 2
        assert abs(got[i].f1 - f1) < 1e-12 and abs(got[i].bleu - bleu) < 1e-12


def test_memories_are_dealt(spark, monkeypatch):
    """The more pairs there are, the more tasks share them; ids given twice are one memory; rows are those of counting."""
    monkeypatch.setattr(evaluation, "_TASK_PAIRS", 8)
    rng = random.Random(6)
    said = lambda n: " ".join(rng.choice("abcdefghij") for _ in range(n))
    asked, held = [(i, said(4)) for i in range(5)], [(i % 37, said(rng.randrange(6))) for i in range(40)] + [(99, None)]
    q, m = spark.createDataFrame(asked, "qid long, text string"), spark.createDataFrame(held, "id long, text string")
    found = evaluation.stub_recall(q, m, 3)
    assert re.search(rf"hashpartitioning\(id#\d+L, {5 * 41 // 8}\)", found._jdf.queryExecution().toString())
    bags = {}
    for i, x in held:
        bags.setdefault(i, Counter()).update((x or "").split())
    want = []
    for i, x in asked:
        mine = Counter(x.split())
        score = {j: sum((mine & b).values()) / sum((mine | b).values()) for j, b in bags.items() if mine & b}
        want += [(i, n + 1, j, round(score[j], 9)) for n, j in enumerate(sorted(score, key=lambda j: (-score[j], j))[:3])]
    assert sorted((r.qid, r["rank"], r.id, round(r.score, 9)) for r in found.collect()) == want
