"""Toxicity by weak supervision (operator 1).

1. Voters. Terms are words and word beginnings of 4 to 8 characters. From a
   bounded sample of labelled rows those that mark toxic texts are found; each
   becomes a lexicon voter that votes toxic where it occurs. Pattern voters vote
   on the form of a text (shouting, marks, length, no suspicious term at all).
2. Label model. Texts have a hidden class; each voter votes with its own rates
   in either class. Expectation-maximisation estimates these rates from the votes
   alone, starting from the labelled sample. Correlations of voters beyond what
   the class explains are estimated from the residuals in each round, and a voter's
   evidence is divided by the root of how many it agrees with for that reason.
3. Classifier. A linear model over hashed words and word beginnings is trained
   on the posterior labels of the sample. It scores every whole text.

The sample is ``sample_rows`` labelled rows (those with the smallest hashes of
their ids). Of the terms that mark toxic rows for sure the ``most_voters`` best vote:
the correlations of all pairs of voters are estimated, and the classifier, which sees
every word, learns from their verdict. Nothing else is bounded. Each row has its
score, repeated ids too; rows without an id are left out. Labels of held-out rows, ids, languages and
sources are never looked at. Null and empty texts get the score of a text without
terms. Without labelled rows every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .inputs import id_and_text
from .language import held_out
from .scratch import bounded_batches, written
from .textbytes import byte_class, hash_spans, slices, words

_U = np.uint64

SAMPLE_ROWS = 12_000
MOST_VOTERS = 160
#: Likelihood-ratio gain of a voter's term; with millions of terms tried, chance alone doesn't reach it.
SURE = 40.0
FEATURE_BITS = 18
PREFIXES = (4, 5, 6, 7, 8)

_WORD = re.compile(r"[^\W\d_]+")
_WORD_BYTES = byte_class((0x61, 0x7A), (0x80, 0xFF))


def terms_of(text: str | None) -> set[str]:
    """Words ("w:") and word beginnings ("p:") of a text, in small letters."""
    found = set(_WORD.findall((text or "").lower()))
    return {f"w:{w}" for w in found if len(w) > 2} | {f"p:{w[:n]}" for w in found for n in PREFIXES if len(w) > n}


def form_votes(text: str | None) -> list[int]:
    """Pattern voters on a text's form: shouting, many exclamation marks, very short, digits or signs."""
    text = text or ""
    letters = sum(map(str.isalpha, text))
    capitals = sum(map(str.isupper, text))
    return [int(letters > 20 and 2 * capitals > letters), int(text.count("!") * 40 > len(text)), int(len(text) < 60), int(letters * 2 < len(text))]


FORMS = 4


def _term_counts(wanted: set[str] | None):
    """Texts of either label that have each term: for toxic rows all terms, or only the wanted terms for all rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if wanted is None:
                    if label:
                        toxic.update(terms_of(text))
                else:
                    (toxic if label else clean).update(terms_of(text) & wanted)
        names = list(toxic | clean)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[x] for x in names], pa.int64()), pa.array([clean[x] for x in names], pa.int64())], names=["term", "toxic", "clean"])

    return rows


def pick_terms(counted: list[tuple[str, int, int]], n_toxic: int, n_clean: int, most: int, least_rows: int = 4) -> list[tuple[str, float]]:
    """(term, log odds) of the terms that mark toxic rows best, from (term, toxic rows, clean rows)."""
    scored = []
    for term, toxic, clean in counted:
        odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
        share, all_share = toxic / max(toxic + clean, 1), n_toxic / (n_toxic + n_clean)
        gain = 2 * (toxic * np.log(max(share, 1e-9) / all_share) + clean * np.log(max(1 - share, 1e-9) / (1 - all_share)))
        if odds > 1.0 and gain > SURE and toxic >= least_rows:
            scored.append((float(odds * np.log1p(toxic)), term, float(odds), toxic, clean))
    scored.sort(key=lambda x: (-x[0], x[1]))
    out: list[tuple[str, float]] = []
    kept: set[tuple[str, int, int]] = set()
    for _, term, odds, toxic, clean in scored:
        key = (term[2:6], toxic, clean)  # words with a common beginning and the same counts are one voter
        if key not in kept:
            kept.add(key)
            out.append((term, odds))
    return out[:most]


def choose_terms(sample: DataFrame, n_toxic: int, n_clean: int, most: int, least_rows: int = 4) -> list[tuple[str, float]]:
    """The lexicon of a labelled sample."""
    schema = "term string, toxic long, clean long"
    rows = sample.select("text", "toxic")
    # a term of fewer toxic rows can't be sure, even if no clean row had it
    reach = SURE / (2 * np.log((n_toxic + n_clean) / n_toxic))
    seen = rows.where("toxic = 1").mapInArrow(_term_counts(None), schema).groupBy("term").agg(F.sum("toxic").alias("n")).where(F.col("n") >= max(least_rows, float(reach)))
    wanted = {r.term for r in seen.collect()}  # of the sample's toxic rows
    if not wanted:
        return []
    counted = rows.mapInArrow(_term_counts(wanted), schema).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()
    return pick_terms([(r.term, r.toxic, r.clean) for r in counted], n_toxic, n_clean, most, least_rows)


def vote_matrix(texts: list[str | None], terms: list[str]) -> np.ndarray:
    index = {t: i for i, t in enumerate(terms)}
    out = np.zeros((len(texts), len(terms) + FORMS + 1), dtype=np.int8)
    for i, text in enumerate(texts):
        hits = [index[t] for t in terms_of(text) if t in index]
        out[i, hits] = 1
        out[i, len(terms) : -1] = form_votes(text)
        out[i, -1] = not hits
    return out


@dataclass
class LabelModel:
    """Rates at which each voter votes in the toxic and the clean class, weights for its correlations, and the class share."""

    rates: np.ndarray  # (2, voters): clean, toxic
    weights: np.ndarray
    share: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of the toxic class; a voter that does not vote abstains and says nothing."""
        total = votes @ (np.log(self.rates[1] / self.rates[0]) * self.weights) + np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit_label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 15, correlated: float = 0.15) -> LabelModel:
    """EM over all rows' votes from starting posteriors (labels where known); the class share is the start's."""
    posterior = np.clip(start.astype(float), 0.05, 0.95)
    share = float(np.clip(start.mean(), 1e-3, 1 - 1e-3))
    v = votes.astype(np.float64)
    model = None
    for _ in range(rounds):
        weight = np.stack([1 - posterior, posterior])
        rates = (weight @ v + 0.5) / (weight.sum(axis=1, keepdims=True) + 1.0)
        # residual correlation: agreement of voters that the class doesn't explain
        expected = weight.T @ rates
        left = v - expected
        scale = np.sqrt((left**2).sum(axis=0)) + 1e-9
        corr = (left.T @ left) / np.outer(scale, scale)  # positive: they agree more than the class explains
        np.fill_diagonal(corr, 0)
        weights = 1 / np.sqrt(1 + np.where(corr > correlated, corr, 0).sum(axis=1))
        model = LabelModel(np.clip(rates, 1e-4, 1 - 1e-4), weights, share)
        posterior = model.posterior(votes)
    return model


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, first): distinct hashed words and word beginnings of each row."""
    found = words(data, offsets, _WORD_BYTES)
    parts, owner = [], []
    for n in (0, *PREFIXES[::2]):
        longer = np.flatnonzero(found.ends - found.starts > n)
        ends = found.ends[longer] if not n else found.starts[longer] + n
        parts.append(hash_spans(found.data, found.starts[longer], ends) ^ _U(n * 0x9E3779B9))
        owner.append(found.row[longer])
    value = (np.concatenate(parts) >> _U(64 - bits)).astype(np.int64)
    key = np.unique((np.concatenate(owner).astype(np.int64) << bits) | value)
    return key & ((1 << bits) - 1), np.searchsorted(key, np.arange(len(offsets)) << bits)


def telling(feature: np.ndarray, rows: np.ndarray, target: np.ndarray, size: int, least: float) -> np.ndarray:
    """Which features say something of the target: their likelihood-ratio gain is at least ``least``."""
    n = np.bincount(feature, minlength=size).astype(float)
    toxic = np.bincount(feature, weights=target[rows], minlength=size)
    mean = target.mean()
    share = np.clip(toxic / np.maximum(n, 1), 1e-9, 1 - 1e-9)
    return 2 * (toxic * np.log(share / mean) + (n - toxic) * np.log((1 - share) / (1 - mean))) >= least


def train(rows: np.ndarray, feature: np.ndarray, target: np.ndarray, bits: int, rounds: int = 300, l2: float = 1.0, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model of soft targets over the telling features; full-batch AdaGrad."""
    size, n_rows = 1 << bits, len(target)
    keep = telling(feature, rows, target, size, SURE / 2)[feature]
    rows, (used, feature) = rows[keep], np.unique(feature[keep], return_inverse=True)
    weights, bias = np.zeros(len(used)), float(np.log(target.mean() / (1 - target.mean())))
    state, bias_state = np.full(len(used), 1e-2), 1e-2
    for _ in range(rounds):
        z = np.bincount(rows, weights=weights[feature], minlength=n_rows) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        gradient = np.bincount(feature, weights=error[rows], minlength=len(used)) + l2 * weights
        state += gradient**2
        weights -= rate * gradient / np.sqrt(state)
        g = error.sum()
        bias_state += g * g
        bias -= rate * g / np.sqrt(bias_state)
    out = np.zeros(size)
    out[used] = weights
    return out, bias


def _feature_rows(bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                value, first = features(data, offsets, bits)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(value.astype(np.int32)))], names=["doc_id", "features"])

    return rows


def _vote_rows(terms: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = vote_matrix(batch.column(1).to_pylist(), terms)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([v.tobytes() for v in votes], pa.binary())], names=["doc_id", "toxic", "votes"])

    return rows


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float
    bits: int


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, most_voters: int = MOST_VOTERS, bits: int = FEATURE_BITS) -> Classifier | None:
    """The classifier from the texts of ``docs`` and those ``labels`` (doc_id, toxic) that may be learned from; None without rows of both labels."""
    bounded_batches(docs.sparkSession)
    chosen = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # sample_rows pairs of numbers bound the broadcast
    sample = written(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "labelled")
    counts = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = counts.get(1, 0), counts.get(0, 0)
    if not n_toxic or not n_clean:
        return None
    terms = [t for t, _ in choose_terms(sample, n_toxic, n_clean, most_voters)]
    voted = sample.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(_vote_rows(terms), "doc_id long, toxic int, votes binary").orderBy("doc_id").collect()
    votes = np.stack([np.frombuffer(bytes(r.votes), np.int8) for r in voted])
    labels = np.array([r.toxic for r in voted], dtype=float)
    posterior = fit_label_model(votes, labels).posterior(votes)
    place = {r.doc_id: i for i, r in enumerate(voted)}
    row, feature = [], []
    for r in sample.select("doc_id", "text").mapInArrow(_feature_rows(bits), "doc_id long, features array<int>").toArrow().to_batches():
        lists = r.column(1)
        at = np.array([place[d] for d in r.column(0).to_pylist()])
        row.append(np.repeat(at, np.diff(lists.offsets.to_numpy())))
        feature.append(lists.flatten().to_numpy())
    row, feature = np.concatenate(row), np.concatenate(feature)
    order = np.lexsort((feature, row))  # the same sums in the same order, whatever the tasks
    weights, bias = train(row[order], feature[order].astype(np.int64), posterior, bits)
    return Classifier(weights.astype(np.float32), bias, bits)


def _score_rows(model: Classifier):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                value, first = features(data, offsets, model.bits)
                total = np.concatenate([[0], np.cumsum(model.weights[value], dtype=np.float64)])
                z = np.clip(total[first[1:]] - total[first[:-1]] + model.bias, -40, 40)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-z)))], names=["doc_id", "score"])

    return rows


def score(docs: DataFrame, model: Classifier | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score (likelihood that it is toxic), predicted (score >= 0.5)."""
    bounded_batches(docs.sparkSession)
    texts = id_and_text(docs, id_col, text_col)
    out = texts.select("doc_id", F.lit(0.0).alias("score")) if model is None else texts.mapInArrow(_score_rows(model), "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id", 5, 0))
    model = fit(docs, labels)
    return score(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")
