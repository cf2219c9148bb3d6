"""Benchmark decontamination by a positional inverted index (operator 10).

The index is made once of a corpus and serves any number of test sets. Texts are
taken in segments of about a megabyte; a segment's postings, the ascending word
positions of each of its terms, are cut into ``BUCKETS`` ranges of term hashes and
stored by range. So a range holds the lists of its terms from all segments, and a
query reads the ranges of its terms, counts how often each occurs in the whole
corpus, and takes only its terms' lists out of them. A row of the index is the part
of one segment in one range, of bounded size however common a term is.

The lists that a query needs are brought together by segment. A document lies in one
segment, so a segment can be judged by itself: a window of the test set is looked
up from its globally rarest term; that term's positions, less its offset in the
window, are candidate starts, and the offset-adjusted lists of the other terms,
again from the rarest on, are intersected with them. ``slop`` > 0 also gives
proximity matches, where each other term may stand up to so many words beside its
place in the same document.

The test set's windows go to all tasks. Their size is checked: test sets of
more than ``block_words`` words are taken in blocks of items, one query of the
index for each block, so what is broadcast never grows beyond that bound. The corpus
itself is read once, whatever the test set.

Null and empty texts have no words and no hits; items without words are never
found; an item of fewer words than a window is one window. Each row of documents has its
result, repeated ids too. Rows without an id are left out, other columns ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .inputs import id_and_text
from .scratch import bounded_batches, written
from .textbytes import byte_class, slices, words

#: Letters, digits and every byte outside ASCII.
WORD_BYTES = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))

WINDOW = 10
#: Ranges of term hashes (a power of two), and into how many parts of its segments each is dealt.
BUCKETS, SPREAD = 64, 64
#: Words of test items that are searched for in one pass: 16 MB of windows at most.
BLOCK_WORDS = 200_000


@dataclass
class Windows:
    """Distinct windows: a row of term hashes each, their lengths, and the items they come from."""

    terms: np.ndarray
    sizes: np.ndarray
    of_window: np.ndarray
    items: np.ndarray


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column(1)):
            found = words(data, offsets, WORD_BYTES)
            terms = pa.ListArray.from_arrays(pa.array(found.first.astype(np.int32)), pa.array(found.hashes().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), terms], names=["item_id", "terms"])


def item_blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(item, term hashes) of the test set in lists of at most ``block_words`` words; a longer item is a list by itself."""
    held, size = [], 0
    for row in items.mapInArrow(_term_rows, "item_id long, terms array<long>").where("size(terms) > 0").toLocalIterator():
        if held and size + len(row.terms) > block_words:
            yield held
            held, size = [], 0
        held.append((row.item_id, np.array(row.terms, dtype=np.int64)))
        size += len(row.terms)
    if held:
        yield held


def windows_of(items: list[tuple[int, np.ndarray]], width: int) -> Windows:
    rows, sizes, owner = [], [], []
    for item, terms in items:
        size = min(width, len(terms))
        made = np.lib.stride_tricks.sliding_window_view(terms, size)
        rows.append(np.pad(made, ((0, 0), (0, width - size))))
        sizes.append(np.full(len(made), size))
        owner.append(np.full(len(made), item, dtype=np.int64))
    table = np.column_stack([np.concatenate(sizes), np.concatenate(rows)])
    distinct, which = np.unique(table, axis=0, return_inverse=True)
    pairs = np.unique(np.column_stack([which.reshape(-1), np.concatenate(owner)]), axis=0)
    return Windows(distinct[:, 1:], distinct[:, 0], pairs[:, 0], pairs[:, 1])


def _planes(values: np.ndarray) -> bytes:
    """32-bit numbers as their lowest bytes, then the next ones, and so on: what compresses stands together."""
    return values.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").reshape(-1)


def _bucket(terms: np.ndarray) -> np.ndarray:
    """The range of each term's hash, in the order of the hashes."""
    return (terms >> (64 - BUCKETS.bit_length() + 1)) + BUCKETS // 2


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (range -1) with the documents of each segment, and one with its lists for each range that it has terms of."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, hi, data, offsets in slices(batch.column(1)):
            found = words(data, offsets, WORD_BYTES)
            terms = found.hashes().view(np.int64)
            order = np.argsort(terms, kind="stable")
            terms = terms[order]
            begin = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
            listed, edges = terms[begin], np.append(begin, len(terms))
            bucket = _bucket(listed)
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(listed) else np.zeros(0, np.int64)
            cut = np.append(cut, len(listed))
            rows = [(-1, ids[lo:hi], found.first.astype(np.int64), b"")]
            rows += [(int(bucket[i]), listed[i:j], _planes(np.diff(edges[i : j + 1])), _planes(order[edges[i] : edges[j]])) for i, j in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([number] * len(rows), pa.int64()), *(pa.array([bytes(x[k]) for x in rows], pa.binary()) for k in (1, 2, 3))], names=["bucket", "segment", "terms", "counts", "positions"])
            number += 1


_SEGMENT = "bucket int, segment long, terms binary, counts binary, positions binary"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of all terms of ``docs``: a stored table, by ranges of terms.

    ``bucket`` -1 has the documents' ids (``terms``) and where each one's words begin (``counts``).
    """
    bounded_batches(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col).mapInArrow(_index_rows, _SEGMENT)
    # a range is split by segments, so that common terms do not make one task large
    return written(rows.repartition("bucket", F.pmod(F.col("segment"), F.lit(SPREAD))).sortWithinPartitions("bucket", "segment"), "index", compression="zstd")


def _wanted(index: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """The rows of the ranges that the terms lie in."""
    return index.where(F.col("bucket").isin([int(x) for x in np.unique(_bucket(vocabulary))]))


def _frequencies(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Occurrences of each term of the vocabulary in the whole corpus; what comes back is bounded by the vocabulary."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), dtype=np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0), batch.column(1), strict=True):
                listed = np.frombuffer(terms.as_py(), np.int64)
                at = np.minimum(np.searchsorted(vocabulary, listed), len(vocabulary) - 1)
                ours = vocabulary[at] == listed
                total[at[ours]] += _from_planes(counts.as_py())[ours]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    rows = _wanted(index, vocabulary).select("terms", "counts").mapInArrow(sums, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(len(vocabulary), dtype=np.int64)
    for row in rows:
        total[row.term] = row.n
    return total


def _list_rows(vocabulary: np.ndarray):
    """The lists of the vocabulary's terms, and the documents of all segments."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for bucket, segment, *parts in zip(*(batch.column(name).to_pylist() for name in ("bucket", "segment", "terms", "counts", "positions")), strict=True):
                if bucket >= 0:
                    listed, counts, positions = np.frombuffer(parts[0], np.int64), _from_planes(parts[1]), _from_planes(parts[2])
                    ours = vocabulary[np.minimum(np.searchsorted(vocabulary, listed), len(vocabulary) - 1)] == listed
                    if not ours.any():
                        continue
                    parts = [listed[ours].tobytes(), _planes(counts[ours]), _planes(positions[np.repeat(ours, counts)])]
                out.append((bucket, segment, *parts))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "segment", "terms", "counts", "positions"])

    return rows


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The segment's number and the (bucket, terms, counts, positions) of each segment, from rows sorted by segment and bucket."""
    held, of = [], None
    for batch in batches:
        for bucket, segment, *parts in zip(*(batch.column(name).to_pylist() for name in ("bucket", "segment", "terms", "counts", "positions")), strict=True):
            if segment != of and held:
                yield of, held
                held = []
            of = segment
            held.append((bucket, *parts))
    if held:
        yield of, held


def _match_rows(plan: Windows, vocabulary: np.ndarray, frequency: np.ndarray, slop: int):
    width = plan.terms.shape[1]
    known = np.searchsorted(vocabulary, plan.terms)
    rarity = np.where(np.arange(width) < plan.sizes[:, None], frequency[np.minimum(known, len(vocabulary) - 1)], np.iinfo(np.int64).max)
    offset = np.argsort(rarity, axis=1, kind="stable")
    by_rarity = np.take_along_axis(plan.terms, offset, axis=1)

    def search(terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, first: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, start, document) of all matches in a segment; a document's words are those from ``first`` to the next one's."""
        place = np.minimum(np.searchsorted(terms, by_rarity), max(len(terms) - 1, 0))
        begin = np.concatenate([[0], np.cumsum(counts)])
        keys = (np.repeat(np.arange(len(terms)), counts) << 32) + positions
        there = (terms[place] == by_rarity) if len(terms) else np.zeros(by_rarity.shape, dtype=bool)
        there |= np.arange(width) >= plan.sizes[:, None]
        window = np.flatnonzero(there.all(axis=1))
        some = counts[place[window, 0]]
        window = np.repeat(window, some)
        inner = np.arange(len(window)) - np.repeat(np.cumsum(some) - some, some)
        at = positions[begin[place[window, 0]] + inner].astype(np.int64)
        doc, start = np.searchsorted(first, at, side="right") - 1, at - offset[window, 0]
        # the window must lie in the document
        ok = (start >= first[doc]) & (start + plan.sizes[window] <= first[doc + 1])
        window, start, doc = window[ok], start[ok], doc[ok]
        for k in range(1, width):
            used = k < plan.sizes[window]
            low = (place[window, k] << 32) + np.maximum(start + offset[window, k] - reach, first[doc])
            high = (place[window, k] << 32) + np.minimum(start + offset[window, k] + reach, first[doc + 1] - 1)
            at = np.searchsorted(keys, low)
            ok = ~used | ((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] <= high))
            window, start, doc = window[ok], start[ok], doc[ok]
        return window, start, doc

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners = np.searchsorted(plan.of_window, np.arange(len(plan.sizes) + 1))
        for segment, ((_, docs, first, _), *parts) in _segments(batches):
            docs, first = np.frombuffer(docs, np.int64), np.frombuffer(first, np.int64)
            lists = [np.frombuffer(b"".join(x[1] for x in parts), np.int64), *(np.concatenate([np.zeros(0, np.int32), *(_from_planes(x[i]) for x in parts)]) for i in (2, 3))]
            out = {"exact": search(*lists, first, 0)}
            out["near"] = search(*lists, first, slop) if slop else tuple(x[:0] for x in out["exact"])
            window, start, doc = out["exact"]
            edge = np.zeros(first[-1] + 1, dtype=np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + plan.sizes[window], -1)
            hit = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
            items = {}
            for name, (window, _, doc) in out.items():
                some = owners[window + 1] - owners[window]
                which = np.repeat(owners[window], some) + np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
                pairs = np.unique(np.column_stack([np.repeat(doc, some), plan.items[which]]), axis=0) if len(which) else np.zeros((0, 2), np.int64)
                items[name] = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs[:, 0], np.arange(len(docs) + 1)).astype(np.int32)), pa.array(pairs[:, 1].astype(np.int64)))
            # runs of hit words, as [first, behind the last) within the document
            mask = np.cumsum(edge[:-1]) > 0
            inside = np.concatenate([[False], mask, [False]])
            cut = np.zeros(len(mask) + 1, dtype=bool)
            cut[first] = True
            opens = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
            closes = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
            owner = np.searchsorted(first, opens, side="right") - 1
            flat = pa.StructArray.from_arrays([pa.array(opens - first[owner]), pa.array(closes - first[owner])], names=["first", "last"])
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(docs) + 1)).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), segment)), pa.array(np.arange(len(docs))), pa.array(docs), pa.array(np.diff(first)), pa.array(np.diff(hit[first])), items["exact"], items["near"], spans], names=["segment", "place", "doc_id", "n_words", "n_hit", "items", "near_items", "spans"])

    return rows


_MATCH = "segment long, place long, doc_id long, n_words long, n_hit long, items array<long>, near_items array<long>, spans array<struct<first: long, last: long>>"


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, slop: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (found by phrase), near_items (by proximity), spans (of hit words)."""
    return matches(build_index(docs, id_col, text_col), benchmark, width, slop, block_words)


def matches(index: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``contamination`` of an index that has been built; the corpus is not read again."""
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"))
    parts = []
    for block in item_blocks(items, block_words):
        plan = windows_of(block, width)
        vocabulary = np.unique(np.concatenate([terms for _, terms in block]))
        lists = _wanted(index, vocabulary).unionByName(index.where("bucket = -1")).mapInArrow(_list_rows(vocabulary), _SEGMENT)
        together = lists.repartition("segment").sortWithinPartitions("segment", "bucket")
        parts.append(together.mapInArrow(_match_rows(plan, vocabulary, _frequencies(index, vocabulary), slop), _MATCH))
    if not parts:  # nothing to look for: the words are counted
        nothing = np.array([np.iinfo(np.int64).min])
        none = Windows(np.zeros((0, width), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        return index.where("bucket = -1").mapInArrow(_match_rows(none, nothing, np.zeros(1, np.int64), slop), _MATCH).drop("segment", "place")
    if len(parts) == 1:
        return parts[0].drop("segment", "place")
    every = reduce(DataFrame.unionByName, parts).groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), *(F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near_items", "spans")))
    # spans of different blocks may overlap
    end = F.lit(0).cast("long")
    state = F.aggregate("spans", F.struct(end.alias("n"), end.alias("to")), lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["last"] - F.greatest(x["first"], s["to"]))).alias("n"), F.greatest(s["to"], x["last"]).alias("to")))
    return every.select("doc_id", "n_words", state["n"].alias("n_hit"), "items", "near_items", "spans")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.concat_ws(",", F.array_sort(F.col("items").cast("array<string>")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
