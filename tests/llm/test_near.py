import random
import re
from collections import Counter, defaultdict

import pytest
from cases import EDGE

from lorekeep.llm.components import components
from lorekeep.llm.near import near_duplicates


def brute(rows, width, percent=80):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    holders, common = defaultdict(list), Counter()
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    for group in holders.values():
        common.update((min(a, b), max(a, b)) for i, a in enumerate(group) for b in group[:i])
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def found(frame, **parameters):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame, **parameters).collect()}


@pytest.mark.parametrize("parameters", [{"width": 4}, {"width": 5, "round_pairs": 200}], ids=["plain", "small-rounds"])
def test_families_with_edits_cuts_and_shared_edits(texts, parameters):
    draw = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(110):
        w = list(base)
        for k in range(draw.randrange(8)):
            w[draw.randrange(120)] = f"x{i}_{k}"
        if i % 2:
            w = w[draw.randrange(14) : 120 - draw.randrange(14)]
        if i % 5 == 0:
            w[40:44] = ["q", "r", "s", f"t{i % 3}"]
        rows.append((i, " ".join(w)))
    rows += [(200 + d % 1000, t) for d, t in EDGE if d < 7] + [(300, "A  b"), (301, "a b"), (302, "a")]
    assert found(texts(rows), **parameters) == brute(rows, parameters["width"])


def test_edges(texts):
    assert found(texts(EDGE), width=4) == brute(EDGE, 4)
    assert near_duplicates(texts([])).count() == 0


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 150)] + [(149, 7), (200, 201), (201, 200), (300, 300)]
    made = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {made[i] for i in [*range(51), *range(100, 150)]} == {0}
    assert made[200] == made[201] == 200 and 300 not in made
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
