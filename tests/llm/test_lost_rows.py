"""Rows without an id, rows that share one, and a very long row crash no operator; each case has its defined result."""

from collections import Counter

import numpy as np
import pytest
from cases import EDGE, with_lost_row

from lorekeep.llm import decontaminate, fingerprints, html, huffman, language, near, packing, repeats, secrets, toxicity

LONG = "the quick brown fox jumps over the lazy dog and runs away from here " * 4
#: Ids 5 and 7 come again: with the same text, and with another one.
AGAIN = [*EDGE, (5, "same text here again and again"), (7, LONG), (5, LONG), (7, LONG)]


def every(spark, docs, folder):
    items = spark.createDataFrame([(1, "again"), (None, "far")], "item_id long, text string")
    huffman.write_ids(docs, str(folder / "f"))
    learned = spark.createDataFrame([("the quick brown fox", "en"), ("der schnelle braune fuchs", "de")], "text string, lang string")
    return {
        "toxicity": toxicity.score(docs, toxicity.Classifier(np.zeros(1 << 8, np.float32), 0.0, 8)),
        "fingerprints": fingerprints.fingerprints(docs, densified=True),
        "huffman": huffman.read_ids(spark, str(folder / "f")),
        "html": html.extract(docs.selectExpr("doc_id AS page_id", "'u' AS url", "text AS html"), {**html.DEFAULT_WEIGHTS}).withColumnRenamed("page_id", "doc_id"),
        "packing": packing.pack(docs).where("start = 0"),
        "language": language.predict(docs, language.fit(learned)),
        "repeats": repeats.remove_repeats(docs),
        "secrets": secrets.scan(docs),
        "near": near.near_duplicates(docs),
        "decontaminate": decontaminate.contamination(docs, items),
    }


def test_rows_without_an_id(spark, texts, tmp_path):
    docs = with_lost_row(spark, texts(EDGE))
    for name, frame in every(spark, docs, tmp_path).items():
        assert Counter(r.doc_id for r in frame.select("doc_id").collect()) == Counter(d for d, _ in EDGE), name


def test_rows_that_share_an_id(spark, texts, tmp_path):
    made = every(spark, texts(AGAIN), tmp_path)
    for name, frame in made.items():
        assert Counter(r.doc_id for r in frame.select("doc_id").collect()) == Counter(d for d, _ in AGAIN), name
    # one behind the other, without a gap
    rows = sorted((r.start, r.n_tokens, r.doc_id) for r in made["huffman"].collect())
    assert [s for s, _, _ in rows] == [0, *np.cumsum([n for _, n, _ in rows])[:-1]] and [d for _, _, d in rows] == sorted(d for d, _ in AGAIN)
    # what rows of any id have in common goes
    gone = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in made["repeats"].collect())
    assert gone[(5, len(LONG), len(LONG))] == 1 and gone[(7, len(LONG), len(LONG))] == 2 and gone[(5, 30, 0)] == 2
    # texts of one id are one document's: 5, 6 and 7 are linked through them
    assert {r.component_id for r in made["near"].collect() if r.doc_id in (5, 6, 7)} == {5}


@pytest.mark.parametrize("size", [1 << 22, 200], ids=["one-bucket", "many-buckets"])
def test_fingerprints_of_shared_and_far_ids(texts, size):
    from test_fingerprints import likeness, signature

    rows = [*AGAIN, (-(2**63), "the lowest id of all"), (2**63 - 1, "the highest id of all")]
    rows = sorted((d, t or "") for d, t in rows)
    expected = Counter()
    for (d, t), (_, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        expected[(d, len(t), round(likeness(signature(t), signature(after)), 9))] += 1
    assert Counter((r.doc_id, r.n_chars, round(r.near_next, 9)) for r in fingerprints.fingerprints(texts(rows), partition_bytes=size).collect()) == expected
