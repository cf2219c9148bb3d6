import math

import numpy as np
import pytest
from cases import EDGE

from lorekeep.llm.toxicity import Classifier, features, fit, fit_label_model, op1_toxicity, pick_terms, score, terms_of


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    positive = np.array(labels) == 1
    n1, n0 = positive.sum(), (~positive).sum()
    return (order[positive].sum() - n1 * (n1 - 1) / 2) / (n1 * n0)


def test_label_model_finds_accuracies_and_correlations():
    draw = np.random.default_rng(0)
    truth = draw.random(4000) < 0.2
    good = [(draw.random(4000) < np.where(truth, 0.6, 0.02)).astype(np.int8) for _ in range(4)]
    noise = (draw.random(4000) < 0.1).astype(np.int8)
    none = 1 - np.max(good, axis=0)  # the voter for texts without any term
    votes = np.stack([*good, none, noise, noise, noise], axis=1)  # the last three are one voter
    start = np.where(draw.random(4000) < 0.1, ~truth, truth)
    model = fit_label_model(votes, start.astype(float))
    assert model.weights[5:].max() < 0.7 < model.weights[:4].min()
    assert abs(model.rates[1][0] - 0.6) < 0.15 and model.rates[0][0] < 0.06
    assert auc(model.posterior(votes), truth.astype(int)) > 0.95


def test_terms():
    assert {"w:idiot", "p:idio"} <= terms_of("Idiot!") and terms_of(None) == set()
    assert [t for t, _ in pick_terms([("w:bad", 30, 0), ("w:the", 100, 900), ("w:rare", 3, 0)], 100, 900, 10)] == ["w:bad"]


def test_held_out_on_planted_labels(spark, texts):
    draw = np.random.default_rng(1)
    word = lambda: "".join(draw.choice(list("abdeglmnorst"), 5))
    docs, labels = [], []
    for i in range(900):
        toxic = int(draw.random() < 0.25)
        w = [word() for _ in range(60)] + [draw.choice(["vilethug", "scumlord", "dunderhead"]) for _ in range(3)] * toxic
        draw.shuffle(w)
        docs.append((i, " ".join(w)))
        labels.append((i, toxic))
    seen = spark.createDataFrame(labels[:700], "doc_id long, toxic int")
    model = fit(texts(docs), seen)
    made = {r.doc_id: r for r in score(texts([*docs, *((d + 2000, t) for d, t in EDGE)]), model).collect()}
    held = [made[i] for i, _ in labels[700:]]
    assert auc([r.score for r in held], [y for _, y in labels[700:]]) > 0.97
    assert np.mean([r.predicted == y for r, (_, y) in zip(held, labels[700:], strict=True)]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in made.values()) and len(made) == 910
    assert made[2001].score == made[2002].score < 0.5


def test_nothing_to_learn_from(spark, texts):
    assert fit(texts(EDGE), spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert fit(texts(EDGE), spark.createDataFrame([(1, None), (4, 0)], "doc_id long, toxic int")) is None
    assert {r.score for r in score(texts(EDGE), None).collect()} == {0.0}
    assert score(texts([]), Classifier(np.zeros(1 << 4, np.float32), 0.0, 4)).count() == 0


def test_features_are_distinct_and_by_row():
    data = b"abc abc" + b"" + b"zz"
    value, first = features(np.frombuffer(data, np.uint8), np.array([0, 7, 7, 9]), 18)
    assert np.diff(first).tolist() == [1, 0, 1] and len(value) == 2


@pytest.mark.parametrize("n", [2])
def test_query_repeats(spark, data, n):
    runs = [sorted(map(tuple, op1_toxicity(spark, data).collect())) for _ in range(n)]
    assert runs[0] == runs[1] and len(runs[0]) == 200


def test_label_model_equals_loops():
    draw = np.random.default_rng(5)
    votes = (draw.random((60, 5)) < 0.3).astype(np.int8)
    votes[:, 4] = votes[:, 3]
    start = (draw.random(60) < 0.3).astype(float)
    made = fit_label_model(votes, start, rounds=4)
    n, m, share = 60, 5, sum(start) / 60
    toxic = [min(max(x, 0.05), 0.95) for x in start]
    for _ in range(4):
        rates = [[(sum(w * votes[i][j] for i, w in enumerate(by)) + 0.5) / (sum(by) + 1.0) for j in range(m)] for by in ([1 - x for x in toxic], toxic)]
        left = [[votes[i][j] - (1 - toxic[i]) * rates[0][j] - toxic[i] * rates[1][j] for j in range(m)] for i in range(n)]
        size = [math.sqrt(sum(r[j] ** 2 for r in left)) + 1e-9 for j in range(m)]
        corr = lambda j, k: sum(r[j] * r[k] for r in left) / (size[j] * size[k])
        weights = [1 / math.sqrt(1 + sum(c for k in range(m) if k != j and (c := corr(j, k)) > 0.15)) for j in range(m)]
        toxic = [1 / (1 + math.exp(-(math.log(share / (1 - share)) + sum(votes[i][j] * weights[j] * math.log(rates[1][j] / rates[0][j]) for j in range(m))))) for i in range(n)]
    assert np.allclose(made.rates, rates) and np.allclose(made.weights, weights) and np.allclose(made.posterior(votes), toxic)
    assert weights[3] < 0.8 and weights[4] < 0.8
