import math
import re
from collections import Counter

import numpy as np
import pytest
from cases import EDGE, with_lost_row
from pyspark.sql import functions as F

from lorekeep.llm.ranked import build_index, heads, item_terms, search, thresholds

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(SMALL))


def brute(docs, items, k):
    """By the words of the contract."""
    held = [(d, Counter(terms_of(t))) for d, t in docs]
    held = [(d, c, c.total()) for d, c in held if c]
    N, L = len(held), sum(n for _, _, n in held)
    df = Counter(x for _, c, _ in held for x in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for i, terms in asked.items():
        scores = []
        for d, c, n in held:
            m = 50 + (50 * n * N) // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * c[x]) // (1000 * c[x] + 20 * m)) for x in terms if c[x])
            if s > 0:
                scores.append((-s, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def corpus(seed, n=400):
    """Words by a steep law, a third of the rows alike, one very long text."""
    draw = np.random.default_rng(seed)
    rows = [(i, " ".join(f"W{x}" if x % 2 else f"w{x}é" for x in draw.zipf(1.4, int(draw.integers(0, 60))) % 500)) for i in range(100, 100 + n)]
    rows += [(1000 + i, "w1 common line w2é") for i in range(n // 3)]
    return [*EDGE, *rows, (5, "w3 an id that comes again w4é"), (9999, "w1 w3 " * 60_000)]


ITEMS = [(1, "W1, w2é and w77"), (2, "w5 w5 w6é w100é w9 nothing here"), (3, None), (4, "?!"), (5, "common line"), (6, " ".join(f"w{x} w{x}é" for x in range(120))), (1, "w3 again"), (None, "w1"), (7, "zzz yyy")]


@pytest.mark.parametrize("k", [1, 3, 50, 1000])
@pytest.mark.parametrize("only", [True, False])
def test_equals_brute_force(texts, spark, k, only):
    rows = corpus(k)
    items = item_terms(spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS score", "2 AS term"))
    index = build_index(with_lost_row(spark, texts(rows)), only=items.select("term") if only else None)
    made = search(index, items, k=k, most_bytes=0 if k == 3 else 32 << 20)
    assert sorted(map(tuple, made.collect())) == brute(rows, [x for x in ITEMS if x[0] is not None], k)
    assert made.columns == ["item_id", "rank", "doc_id", "score"] and dict(made.dtypes)["rank"] == "int"


def test_nothing_to_find(texts, spark):
    items = item_terms(spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert search(build_index(texts([])), items).count() == 0
    assert search(build_index(texts([(1, None), (2, "?")])), items).count() == 0
    none = item_terms(spark.createDataFrame([], "item_id long, text string"))
    assert search(build_index(texts(EDGE), only=none.select("term")), none).count() == 0


def test_every_question_of_one_index(texts, spark):
    """An index of all terms serves later questions."""
    rows = corpus(9, 100)
    index = build_index(texts(rows))
    for asked in ([(1, "w1 w3")], [(2, "w2é line")]):
        made = search(index, item_terms(spark.createDataFrame(asked, "item_id long, text string")), k=10)
        assert sorted(map(tuple, made.collect())) == brute(rows, asked, 10)


def test_heads_and_thresholds(texts, spark):
    index = build_index(texts(corpus(2)))
    every = index.blocks.select("term", F.explode(F.arrays_zip("docs", "impacts")).alias("x")).select("term", "x.impacts").collect()
    by_term = {}
    for r in every:
        by_term.setdefault(r.term, []).append(r.impacts)
    got = {}
    for r in heads(index.blocks, 5).collect():
        got.setdefault(r.term, []).append(r.impact)
    assert {t: sorted(v, reverse=True)[:5] for t, v in by_term.items()} == {t: sorted(v, reverse=True) for t, v in got.items()}
    # the greatest level that no document below it in every list can reach the bound with
    draw = np.random.default_rng(4)
    for bound in (0, 1, 17, 300, 5000):
        most = [int(x) for x in draw.integers(1, 400, 30)]
        lists = spark.createDataFrame([(1, i, 1, m) for i, m in enumerate(most)], "item_id long, term long, w long, most long")
        level = thresholds(lists, spark.createDataFrame([(1, bound)], "item_id long, bound long")).first().level
        below = lambda x: sum(min(x, m) for m in most)  # noqa: B023, E731
        assert level == 1 or below(level - 1) < bound
        assert below(level) >= bound or level > max(most)
