"""Stems against published examples, the stemmed legs against loops."""

import re
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.config import Config
from lorekeep.functions.stem import with_stems
from lorekeep.functions.text import STOPWORDS
from lorekeep.operators import recall as R

#: Words and stems from the published description of the algorithm and its sample vocabulary.
STEMS = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist
consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid
consoling consol consolingly consol consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu
conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc
constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee
kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight
knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock
knopp knopp knot knot knots knot caresses caress flies fli dies die cries cri ties tie gas gas this this gaps gap kiwis kiwi luxuriated luxuri hopping hop hoping hope hopped hop
agreed agre feed feed falling fall hissing hiss fizzed fizz failing fail filing file by by say say cry cri happy happi enjoy enjoy relational relat conditional condit
rational ration valenci valenc digitizer digit operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit
triplicate triplic formative format formalize formal electriciti electr electrical electr goodness good revival reviv allowance allow inference infer airliner airlin
adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt activate activ bowdlerize bowdler probate probat
rate rate cease ceas controll control roll roll generate generat generously generous community communiti skies sky dying die early earli news news atlas atlas inning inning
succeed succeed proceeds proceed youth youth boyish boyish yes yes running run generic generic arsenal arsenal
""".split()


def test_published_stems(spark):
    words = STEMS[::2]
    made = {r.token: r.stem for r in with_stems(spark.createDataFrame([(w,) for w in [*words, "a", "it", "x9y", "1st", ""]], "token string")).collect()}
    said = dict(zip(words, STEMS[1::2], strict=True))
    assert {w: (made[w], s) for w, s in said.items() if made[w] != s} == {}
    assert all(made[w] == w for w in ("a", "it", "x9y", "1st", ""))


def density(entries, terms):
    """By all windows: those with every term, and none with every term properly inside."""
    full = [(p, q) for p, q in itertools.product([e[0] for e in entries], repeat=2) if p <= q and {t for x, t in entries if p <= x <= q} == set(range(terms))]
    shortest = [(p, q) for p, q in set(full) if not any((a, b) != (p, q) and p <= a and b <= q for a, b in full)]
    return sum(0.1 / (1 + (q - p) - (sum(p <= x <= q for x, _ in entries) - 1)) for p, q in shortest)


def test_cover_density(spark):
    draw = np.random.default_rng(2)
    rows = []
    for i in range(200):
        terms = int(draw.integers(1, 4))
        places = sorted(draw.choice(30, int(draw.integers(1, 12)), replace=False))
        rows.append((i, terms, [(int(p), int(draw.integers(0, terms))) for p in places]))
    frame = spark.createDataFrame(rows, "i int, terms int, entries array<struct<pos: int, term: int>>")
    made = {r.i: r.score for r in frame.select("i", R.cover_density(F.col("entries"), F.col("terms")).alias("score")).collect()}
    assert all(abs(made[i] - density(e, t)) < 1e-9 for i, t, e in rows)


@pytest.mark.parametrize("any_", [True, False])
def test_stem_leg(spark, any_):
    said = ["the runner was running and runs", "a river of consoling rivers; consolation", None, "nothing", "rivers run by rivers", "consoled"]
    records = spark.createDataFrame([(i, t, 100 - i) for i, t in enumerate(said)], "id long, content string, n long")
    records = records.selectExpr("id", "content", "'' AS context_summary", "array('x') AS tags", "CAST(NULL AS array<float>) AS embedding", "timestamp_seconds(n) AS created_at", "timestamp_seconds(n) AS occurred_at", "0L AS hit_count")
    asked = [(0, "running rivers", None), (1, "console", None), (2, "the", None), (3, "river runs", 97), (4, "rivers consolations river", None)]
    questions = spark.createDataFrame(asked, "qid long, query string, bound long").selectExpr("qid", "query", "timestamp_seconds(bound) AS as_of")
    stems = {r.token: r.stem for r in with_stems(spark.createDataFrame([(w,) for w in sorted({w for t in [*said, *(q for _, q, _ in asked)] for w in re.findall("[a-z0-9]+", t or "")})], "token string")).collect()}
    expected = []
    for qid, query, bound in asked:
        wanted = sorted({stems[w] for w in re.findall("[a-z0-9]+", query) if len(w) >= 3 and w not in STOPWORDS})
        scores = []
        for i, t in enumerate(said):
            entries = [(p, wanted.index(stems[w])) for p, w in enumerate(re.findall("[a-z0-9]+", t or "")) if stems[w] in wanted]
            if entries and (bound is None or 100 - i <= bound) and (any_ or {x for _, x in entries} == set(range(len(wanted)))):
                scores.append((-round(0.1 * len(entries) if any_ else density(entries, len(wanted)), 9), i))
        expected += [(qid, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores))]
    made = R.stem_leg(R.prepared(records), questions, Config(lexical_any=any_)).collect()
    assert sorted((r.qid, r["rank"], r.id, r.score) for r in made) == sorted(expected) and expected


def test_only_wanted_stems_are_counted(spark):
    records = spark.createDataFrame([(1, "running cats run"), (2, "dogs bark")], "id long, _hay string")
    wanted = spark.createDataFrame([(1, "run"), (2, "bark")], "qid long, stem string")
    made = R._stems(records, wanted, 1 << 20, "id", F.col("_hay")).collect()
    assert sorted((r.id, r.stem, r.positions) for r in made) == [(1, "run", [0, 2]), (2, "bark", [1])]
