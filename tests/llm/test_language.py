import math
import re

import numpy as np
import pyarrow as pa
import pytest
from cases import EDGE

from lorekeep.llm.language import accepted, fit, held_out, identify, op6_language, predict
from lorekeep.llm.textbytes import slices


@pytest.fixture(scope="module")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def model(documents):
    return fit(documents.where(~held_out("doc_id", 3, 1)))


def test_held_out_accuracy(spark, data, documents):
    truth = {r.doc_id: r.lang for r in documents.collect()}
    made = op6_language(spark, data).collect()
    held = [r for r in made if r.held_out]
    assert len(made) == len(truth) and all(0 <= r.score <= 1 for r in made)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.98


def test_mixtures(spark, documents, model):
    by = {r.lang: r.text for r in documents.where("n_chars > 3000").collect()}
    mixed = spark.createDataFrame([(1, by["en"][:1500] + "\n" + by["de"][:1500]), (2, by["fr"][:1500])], "doc_id long, text string")
    made = {r.doc_id: r for r in predict(mixed, model).collect()}
    assert set(made[1].languages) == {"en", "de"} and 0.25 < made[1].score < 0.75
    assert made[2].lang_pred == "fr" and made[2].score > 0.8


def test_all_languages_of_a_text(spark, documents, model):
    by = {r.lang: r.text for r in documents.where("n_chars > 3000").collect()}
    assert len(by) == len(model.languages) == 4
    rows = [(n, "\n".join(by[lang][:1500] for lang in sorted(by)[:n])) for n in (1, 2, 3, 4)]
    made = {r.doc_id: r for r in predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert {n: r.languages for n, r in made.items()} == {n: sorted(by)[:n] for n in made}
    assert all(abs(r.score - 1 / n) < 0.12 for n, r in made.items())


def test_edges(texts, model):
    rows = [*EDGE, (30, "123 !!"), (31, "É")]
    made = {r.doc_id: r for r in predict(texts(rows), model).collect()}
    assert {d for d, r in made.items() if r.lang_pred == "und"} == {1, 2, 3, 30}
    assert all(made[d].score == 0 for d in (1, 2, 3, 30)) and len(made) == len(rows)
    assert predict(texts([]), model).count() == 0
    kept = accepted(texts(rows), model, -1e9)
    assert {r.doc_id for r in kept.collect()} == set(made) - {1, 2, 3, 30} and kept.columns == texts(rows).columns


def test_nothing_learned(texts):
    none = fit(texts([], "text string, lang string"))
    assert {(r.lang_pred, r.score) for r in predict(texts(EDGE[:5]), none).collect()} == {("und", 0.0)}


def test_slices_do_not_matter(documents, model):
    column = pa.array([r.text for r in documents.limit(40).collect()])
    whole = [identify(d, o, model)[0] for _, _, d, o in slices(column, 1 << 30)]
    single = [identify(d, o, model)[0] for _, _, d, o in slices(column, 1)]
    assert np.concatenate(whole).tolist() == np.concatenate(single).tolist()


def _by_hand(text, model, rounds=8, penalty=2.0):
    """(language, share, selected) by loops over words and trigrams."""
    n, words = len(model.languages), []
    low = re.sub("[\u00c0-\u00d6\u00d8-\u00de]", lambda x: x[0].lower(), "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)).encode()
    for word in re.findall(rb"[a-z\x80-\xff]+", low):
        total = [0.0] * n
        for i in range(len(word)):
            a, b, c = word[i - 1] if i else 32, word[i], word[i + 1] if i + 1 < len(word) else 32
            bucket = ((((a << 16 | b << 8 | c) * 2654435761) & 0xFFFFFFFF) >> 15) % len(model.log_p)
            total = [x + float(p) for x, p in zip(total, model.log_p[bucket], strict=True)]
        words.append(total)
    if not words:
        return None

    def fitted(allowed):
        shares = {k: 1 / len(allowed) for k in allowed}
        weigh = lambda: [{k: shares[k] * math.exp(w[k] - max(w)) for k in allowed} for w in words]
        for _ in range(rounds):
            parts = [{k: x[k] / max(sum(x.values()), 1e-30) for k in allowed} for x in weigh()]
            shares = {k: sum(x[k] for x in parts) / len(words) for k in allowed}
        return shares, sum(math.log(max(sum(x.values()), 1e-30)) for x in weigh())

    shares, _ = fitted(range(n))
    order = sorted(range(n), key=lambda k: -shares[k])
    single = [sum(w[k] - max(w) for w in words) for k in range(n)]
    best = max(range(n), key=lambda k: single[k])
    value, chosen, settled = single[best], [best], shares
    price = penalty * math.log(max(len(words), 2))
    for k in range(2, n + 1):
        again, log_likelihood = fitted(order[:k])
        if log_likelihood - (k - 1) * price > value:
            value, chosen, settled = log_likelihood - (k - 1) * price, order[:k], again
    if len(chosen) > 1:
        best = max(chosen, key=lambda k: settled[k])
    return model.languages[best], settled[best], {model.languages[k] for k in chosen}


def test_equals_loops(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = fit(docs)
    rows = {r.doc_id: r.text for r in docs.collect()}
    some = list(rows.values())
    mixed = {10**6 + i: " ".join((some[j] or "")[:400] for j in range(i, i + 5)) for i in range(0, 40, 5)}
    made = {r.doc_id: r for r in predict(docs.unionByName(spark.createDataFrame(list(mixed.items()), "doc_id long, text string"), allowMissingColumns=True), model).collect()}
    several = 0
    for d, text in {**rows, **mixed}.items():
        said = _by_hand(text or "", model)
        if said is None:
            assert made[d].lang_pred == "und"
            continue
        assert (made[d].lang_pred, set(made[d].languages)) == (said[0], said[2]), d
        assert abs(made[d].score - said[1]) < 1e-4
        several += len(said[2]) > 1
    assert several > 3
