"""Language identification by multilingual mixtures (operator 6).

Each language has a distribution over the byte trigrams of its words (hashed,
add-one smoothed, counted over all training texts). A text is a mixture: each
word comes from one language, and expectation-maximisation estimates the
proportions from the words' trigram likelihoods. Which languages a text has is
chosen by penalised likelihood: for one, two, ... of the languages with the
largest shares the mixture is fitted again, and another language is taken in
only if the likelihood gains more than ``penalty`` times the logarithm of the
number of words, up to all learned languages. The prediction is the selected language with the largest share.

Whether a text is in any of the languages at all is another question, with another
table (``accepted``): the best mixture against a background of independent letters
or no pattern at all. There a trigram that a language has not shown costs the same
in every language, however many letters its training texts have.

What is collected is one count for each language and trigram bucket, bounded by
their numbers. Null texts and texts without a letter are ``und`` with score 0.
With no training row every text is ``und``. Each row has its result, repeated ids
too; rows without an id are left out, other columns ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .inputs import id_and_text
from .scratch import bounded_batches
from .textbytes import LOWER, byte_class, slices

BUCKETS = 1 << 16
ROUNDS = 8
PENALTY = 2.0
UNDETERMINED = "und"
#: Share of a language's trigrams that are left to any bucket, when texts are accepted; half of the background has no pattern.
UNSEEN = 0.01

_LETTER = byte_class((0x61, 0x7A), (0x80, 0xFF))


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder


@dataclass
class Grams:
    """Trigrams of all letters and their buckets, where each word begins among them, and where each row's words begin."""

    codes: np.ndarray
    buckets: np.ndarray
    word_first: np.ndarray
    row_first: np.ndarray


def grams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> Grams:
    low = LOWER[data]
    # capitals of Latin-1, in two bytes
    wide = np.zeros(len(low), dtype=bool)
    wide[1:] = low[:-1] == 0xC3
    low = np.where(wide & (low >= 0x80) & (low <= 0x9E) & (low != 0x97), low + 32, low)
    letter = _LETTER[low]
    stream = np.where(letter, low, 0x20).astype(np.uint32)
    left = np.full(len(stream), 0x20, dtype=np.uint32)
    left[1:] = stream[:-1]
    right = np.full(len(stream), 0x20, dtype=np.uint32)
    right[:-1] = stream[1:]
    some = offsets[:-1][offsets[1:] > offsets[:-1]]
    left[some] = 0x20
    right[some[some > 0] - 1] = 0x20
    at = np.flatnonzero(letter)
    code = (left[at] << 16) | (stream[at] << 8) | right[at]
    found = ((code * np.uint32(2654435761)) >> np.uint32(15)) % np.uint32(buckets)
    new = np.flatnonzero(left[at] == 0x20)
    rows = np.searchsorted(at[new], offsets)
    return Grams(code, found.astype(np.int64), new, rows)


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # (buckets, languages)
    log_even: np.ndarray  # the same, smoothed by a share
    log_byte: np.ndarray  # (256,): of all languages' trigrams


def _count_rows(buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for lo, hi, data, offsets in slices(batch.column(0)):
                found = grams(data, offsets, buckets)
                letters = np.append(found.word_first, len(found.buckets))[found.row_first]
                row = np.repeat(np.arange(hi - lo), np.diff(letters))
                for lang in set(langs[lo:hi]):
                    mine = found.buckets[(langs[lo:hi] == lang)[row]]
                    total.setdefault(lang, np.zeros(buckets + 256, np.int64))
                    total[lang] += np.bincount(mine, minlength=buckets + 256)
                    codes = found.codes[(langs[lo:hi] == lang)[row]]
                    for shift in (0, 8, 16):
                        total[lang][buckets:] += np.bincount((codes >> shift) & 0xFF, minlength=256)
        for lang, counts in total.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(counts[some])], names=["lang", "bucket", "n"])

    return rows


def fit(training: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS) -> Model:
    """Trigram distributions from all rows with a text and a language."""
    bounded_batches(training.sparkSession)
    rows = training.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counted = rows.mapInArrow(_count_rows(buckets), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    counts = np.zeros((buckets + 256, len(languages)))
    counts[counted["bucket"].to_numpy(), np.searchsorted(languages, counted["lang"])] += counted["n"].to_numpy()
    table, of_bytes = counts[:buckets] + 1, counts[buckets:].sum(axis=1)
    even = (1 - UNSEEN) * counts[:buckets] / np.maximum(counts[:buckets].sum(axis=0), 1) + UNSEEN / buckets
    byte = (1 - UNSEEN) * of_bytes / max(of_bytes.sum(), 1) + UNSEEN / 256
    return Model(languages, np.log(table / table.sum(axis=0)).astype(np.float32) if languages else table, np.log(even).astype(np.float32), np.log(byte))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over the stretches that begin at ``first`` (the last value of it: the end), empty ones 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def mixture(likelihood: np.ndarray, first: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(shares, log likelihood) of each row's words' mixture over the languages marked in ``allowed``.

    ``likelihood`` holds each word's likelihoods, divided by its largest; the log likelihood is relative to those.
    """
    counts = np.maximum(np.diff(first), 1)[:, None]
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    shares = allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)
    for _ in range(rounds):
        joint = likelihood * shares[row]
        joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-30)
        shares = _sums(joint, first) / counts
    total = np.log(np.maximum((likelihood * shares[row]).sum(axis=1), 1e-30))
    return shares, _sums(total, first)


def identify(data: np.ndarray, offsets: np.ndarray, model: Model, rounds: int = ROUNDS, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(best language, its share, selected languages (rows, languages), log likelihood per letter) of each row."""
    found = grams(data, offsets, len(model.log_p))
    rows, n = len(offsets) - 1, len(model.languages)
    if not len(found.word_first):
        return np.zeros(rows, int), np.zeros(rows), np.zeros((rows, n), bool), np.zeros(rows)
    words = np.add.reduceat(model.log_p[found.buckets], found.word_first, axis=0).astype(np.float64)
    top = words.max(axis=1)
    likelihood = np.exp(np.maximum(words - top[:, None], -60))
    first = found.row_first
    shares, _ = mixture(likelihood, first, np.ones((rows, n)), rounds)
    order = np.argsort(-shares, axis=1, kind="stable")
    single = _sums(words - top[:, None], first)
    best = single.argmax(axis=1)
    value = single.max(axis=1)
    chosen = np.zeros((rows, n), dtype=bool)
    chosen[np.arange(rows), best] = True
    settled = shares.copy()
    price = penalty * np.log(np.maximum(np.diff(first), 2))
    for k in range(2, n + 1):
        # no log likelihood is above 0: the other rows can't gain by k or more languages
        open_rows = np.flatnonzero(-(k - 1) * price > value)
        if not len(open_rows):
            break
        sizes = np.diff(first)
        its_words = np.zeros(len(likelihood), dtype=bool)
        its_words[first[0] : first[-1]] = np.repeat(np.isin(np.arange(rows), open_rows), sizes)
        allowed = np.zeros((len(open_rows), n))
        np.put_along_axis(allowed, order[open_rows, :k], 1, axis=1)
        again, log_likelihood = mixture(likelihood[its_words], np.concatenate([[0], np.cumsum(sizes[open_rows])]), allowed, rounds)
        penalised = log_likelihood - (k - 1) * price[open_rows]
        better = penalised > value[open_rows]
        value[open_rows[better]] = penalised[better]
        chosen[open_rows[better]] = allowed[better] > 0
        settled[open_rows[better]] = again[better]
    best = np.where(chosen.sum(axis=1) > 1, np.where(chosen, settled, -1).argmax(axis=1), best)
    letters = np.append(found.word_first, len(found.buckets))[first]
    per_letter = (_sums(top, first) + single.max(axis=1)) / np.maximum(np.diff(letters), 1)
    return best, np.clip(settled[np.arange(rows), best], 0, 1), chosen, per_letter


def _identify_rows(model: Model, rounds: int, penalty: float):
    names = np.array([*model.languages, UNDETERMINED], dtype=object)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                texts = batch.column(1).slice(lo, hi - lo)
                has_letter = np.array([any(map(str.isalpha, t)) if t else False for t in texts.to_pylist()], dtype=bool)
                if model.languages:
                    best, share, chosen, fitness = identify(data, offsets, model, rounds, penalty)
                else:
                    best, share, chosen, fitness = np.zeros(hi - lo, int), np.zeros(hi - lo), np.zeros((hi - lo, 0), bool), np.zeros(hi - lo)
                    has_letter[:] = False
                best = np.where(has_letter, best, len(names) - 1)
                listed = [names[:-1][c].tolist() if ok else [] for c, ok in zip(chosen, has_letter, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(names[best], pa.string()), pa.array(np.where(has_letter, share, 0.0)), pa.array(listed, pa.list_(pa.string())), pa.array(np.where(has_letter, fitness, 0.0))],
                    names=["doc_id", "lang_pred", "score", "languages", "log_likelihood"],
                )

    return rows


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, penalty: float = PENALTY) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (its share), languages (all selected), log_likelihood (per letter)."""
    bounded_batches(docs.sparkSession)
    texts = id_and_text(docs, id_col, text_col)
    return texts.mapInArrow(_identify_rows(model, rounds, penalty), "doc_id long, lang_pred string, score double, languages array<string>, log_likelihood double")


def margins(data: np.ndarray, offsets: np.ndarray, model: Model, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(log likelihood ratio of the best mixture of languages against the background, letters) of each row."""
    found = grams(data, offsets, len(model.log_even))
    rows, n = len(offsets) - 1, len(model.languages)
    if not len(found.word_first):
        return np.zeros(rows), np.zeros(rows, int)
    words = np.add.reduceat(model.log_even[found.buckets], found.word_first, axis=0).astype(np.float64)
    top = words.max(axis=1)
    _, mixed = mixture(np.exp(np.maximum(words - top[:, None], -60)), found.row_first, np.ones((rows, n)), rounds)
    letters = np.append(found.word_first, len(found.buckets))[found.row_first]
    independent = sum(model.log_byte[(found.codes >> shift) & 0xFF] for shift in (0, 8, 16))
    background = np.logaddexp(independent, -np.log(len(model.log_even))) - np.log(2)
    return _sums(top, found.row_first) + mixed - _sums(background, letters), np.diff(letters)


def accepted(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a letter and a margin (see ``margins``) of ``least`` or more; one pass, no join."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.array([any(map(str.isalpha, t)) if t else False for t in batch.column(at).to_pylist()], dtype=bool)
            for lo, hi, data, offsets in slices(batch.column(at)):
                keep[lo:hi] &= margins(data, offsets, model)[0] >= least if model.languages else False
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out("doc_id", 3, 1)))
    return predict(docs, model).withColumn("held_out", held_out("doc_id", 3, 1)).select("doc_id", "held_out", "lang_pred", "score", "languages", "log_likelihood")
