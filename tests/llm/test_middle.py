import hashlib
import random
import re

import pytest
from cases import EDGE, with_lost_row

from lorekeep.llm.middle import SENTINELS, draws, fill_in_middle, restore, restored, scanned, transformed

ROWS = [*EDGE, (20, "one <P> inside"), (21, "x" * 99), (22, "a<<P"), (23, "\n\n  two\twords \n"), (24, "日本 語　x"), (25, "<M>"), (5, "another text of five"), *((i, f"number {i}: <P a> b<S c>\r\n" * (i % 7)) for i in range(100, 220))]
PARTS = {"char": r"(?s).", "word": r"[\t-\r ]+|[^\t-\r ]+", "line": r"[^\n]*\n|[^\n]+"}


def brute(doc_id, text, unit="char"):
    """By the words of the contract: units from a pattern, digits from the hex digest."""
    units = re.findall(PARTS[unit], text)
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("unit", PARTS)
def test_equals_brute_force(texts, spark, unit):
    made = restore(fill_in_middle(with_lost_row(spark, texts(ROWS)), unit=unit)).collect()
    said = sorted((d, *brute(d, t or "", unit), t or "") for d, t in ROWS)
    assert sorted((r.doc_id, r.n, r.form, r.prefix_units, r.middle_units, r.output, r.text) for r in made) == said
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert fill_in_middle(texts([]), unit=unit).count() == 0


def test_random_texts_come_back():
    draw = random.Random(3)
    for i in range(3000):
        text = "".join(draw.choice("<PSM> \n\taé日") for _ in range(draw.randrange(40)))
        for unit in PARTS:
            n, form, first, more, in_a, in_b, output = transformed(i, text, rate=100, unit=unit)
            assert restored(output, form) == text and n == len(re.findall(PARTS[unit], text))
            if form != "plain":
                a, b = (sum(map(len, re.findall(PARTS[unit], text)[:x])) for x in (first, first + more))
                split = [0 < x < len(text) and not re.search(r"[\t-\r ]", text[x - 1 : x + 1]) for x in (a, b)]
                assert [in_a, in_b] == split or unit == "line"


def test_one_pass_finds_events_and_sentinels():
    events, sentinels = scanned("ab  c<S>\n", "word")
    assert list(events.starts) == [0, 2, 4, 8] and list(events.blank) == [False, True, False, True] and sentinels == [(5, "<S>")]
    assert [events.place(i) for i in range(5)] == [0, 2, 4, 8, 9]
    assert len(draws(1)) == 4 and draws(1) != draws(2) and set(SENTINELS) == {"<P>", "<S>", "<M>"}


def test_rates(texts):
    rows = [(i, "some text of words") for i in range(2000)]
    forms = [r.form for r in fill_in_middle(texts(rows), rate=50, suffix_first=50, seed=7).select("form").collect()]
    assert 900 < forms.count("plain") < 1100 and 400 < forms.count("spm") < 600
    with pytest.raises(ValueError, match="unit"):
        fill_in_middle(texts(rows), unit="page")
