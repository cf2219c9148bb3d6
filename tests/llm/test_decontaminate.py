import hashlib
import re
from collections import defaultdict

import pytest
from cases import EDGE

from lorekeep.llm.decontaminate import contamination, op10_decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=10):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - width + 1, min(1, len(w)))):
            windows[tuple(w[k : k + width])].add(i)
    out = {}
    for d, t in docs:
        w, hit, met = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (key := tuple(w[k : k + size])) in windows:
                    hit |= set(range(k, k + size))
                    met |= windows[key]
        out[d] = (len(w), len(hit), tuple(sorted(met)))
    return out


PASSAGE = "the quick brown fox jumps over the lazy dog and then it sleeps"


@pytest.mark.parametrize("parameters", [{}, {"block_words": 5}, {"slop": 1}], ids=["plain", "blocks", "slop"])
def test_equals_brute_force(spark, texts, parameters):
    w = PASSAGE.split()
    docs = [*EDGE, (20, "Before: " + PASSAGE.upper() + "!! after"), (21, " ".join(w[:9])), (22, " ".join(w[:10])), (23, PASSAGE + " " + PASSAGE), (24, "alpha-BETA"), (25, " ".join(w[4:])), (26, " ".join(w[:9])), (27, w[9])]
    items = [(1, PASSAGE), (2, "alpha beta"), (3, None), (4, ""), (5, "again"), (6, PASSAGE), (7, "never seen words")]
    made = contamination(texts(docs), texts(items, "item_id long, text string"), **parameters)
    assert {r.doc_id: (r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in made.collect()} == brute(docs, items)


def test_proximity(texts):
    docs = [(1, "the quick brown red fox jumps over the lazy dog"), (2, "fox quick the brown"), (3, "quick")]
    found = {r.doc_id: (r.n_hit, list(r.near_items)) for r in contamination(texts(docs), texts([(9, "the quick brown fox")], "item_id long, text string"), slop=1).collect()}
    assert found == {1: (0, [9]), 2: (0, []), 3: (0, [])}


def test_nothing_to_look_for(texts):
    none = texts([], "item_id long, text string")
    assert {(r.n_words, r.n_hit) for r in contamination(texts([(1, "a b"), (2, None)]), none).collect()} == {(2, 0), (0, 0)}
    assert contamination(texts([]), none).count() == 0


def test_query(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    expected = brute(docs, items)
    for r in op10_decontaminate(spark, data).collect():
        n, hit, met = expected[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(met), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, met))).encode()).hexdigest()
