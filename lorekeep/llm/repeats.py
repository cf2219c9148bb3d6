"""Removal of long repeated byte strings, by run-length indexes (operator 7).

A byte goes if a ``length``-byte string that covers it also starts anywhere
else in the corpus. The work is split by content, so that no index holds the
whole corpus:

1. Every window of ``length`` bytes belongs to the anchor it contains: the
   ``anchor`` bytes with the smallest hash. Consecutive windows of one anchor
   make a segment. Equal windows have equal anchors, so they meet under the
   same anchor, and no two segments share a window.
2. Segments that are equal byte for byte are collapsed to one with a count;
   all their bytes are repeated. Segments alone under their anchor are gone.
3. What is left, different segments of a common anchor, is indexed in blocks of
   bounded size: the suffixes of a block give its Burrows-Wheeler transform, of
   which only the runs are kept, with the text positions of their first and last
   suffixes. The longest match of a text position with any other changes by
   exactly one from each position to the next, except at these samples; so
   matching statistics are streamed over the text from the samples alone.
   Positions with ``length`` or more are marked.
4. An anchor with more than ``hot`` different segments does not go to a block:
   its windows are counted one by one by content hash, with partial sums before
   the shuffle. This is exact as well, and no task needs to hold them together.

Null texts are empty; texts shorter than ``length`` keep every byte; copies of
a text of ``length`` bytes or more lose every byte. Offsets are bytes of UTF-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .inputs import id_and_text
from .scratch import bounded_batches, written
from .textbytes import between, hash_spans, mix, prefix_sums, slices, text_buffers

_U = np.uint64

LENGTH = 200
ANCHOR = 100
HOT_SEGMENTS = 20_000
BLOCK_BYTES = 1 << 20
#: Bytes of two suffixes that are compared themselves before hashes are.
_DIRECT = 64


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over values[i : i + width], by doubling."""
    out, span = values, 1
    while span * 2 <= width:
        out = pick(out[:-span], out[span:])
        span *= 2
    return pick(out[: len(out) - (width - span)], out[width - span :]) if width > span else out


#: A fixed random odd number for each byte value.
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def _routes(data: np.ndarray, width: int) -> np.ndarray:
    """A number for each stretch of ``width`` bytes, equal for equal ones; it only decides which stretches meet, so others may share it."""
    out, span, parts = _BYTE_VALUES[data], 1, []
    while True:
        if width & span:
            parts.append((span, out))
        if span * 2 > width:
            break
        out = out[:-span] * _U(0x9E3779B97F4A7C15 + 2 * span) + out[span:]
        span *= 2
    count, total, done = len(data) - width + 1, None, 0
    for span, part in parts:
        piece = part[done : done + count]
        total = piece if total is None else total * _U(0xD1B54A32D192ED03) + piece
        done += span
    return mix(total)


def segments_of(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, segment hash, start, windows, whether it may repeat itself) of each segment, starts within ``data``."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.view(_U), none.view(_U), none, none, none.astype(bool)
    width = length - anchor + 1
    sums = prefix_sums(data)
    grams = _routes(data, anchor)
    least = _sliding(grams, width, np.minimum)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + length <= ends)
    if not len(at):
        return none.view(_U), none.view(_U), none, none, none.astype(bool)
    value = least[at]
    first = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)]))
    count = np.diff(np.append(first, len(at)))
    start, value = at[first], value[first]
    last = start + count - 1 + length
    content = mix(between(sums, start, last) + count.astype(_U) * _U(0x9E3779B97F4A7C15))
    # a segment can only repeat itself if its anchor stands in it twice
    where = np.flatnonzero(np.isin(grams, value, assume_unique=False)) if len(value) < 8 else _anchors(grams, least, width)
    lo, hi = np.searchsorted(where, start), np.searchsorted(where, start + count - 1 + width)
    owner = np.repeat(np.arange(len(start)), hi - lo)
    spot = np.arange(len(owner)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
    twice = np.bincount(owner[grams[where[spot]] == value[owner]], minlength=len(start)) > 1
    return value, content, start, count, twice


def _anchors(grams: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """Positions whose gram is the least of some window."""
    padded = np.concatenate([np.zeros(width - 1, _U), least, np.zeros(width - 1, _U)])
    return np.flatnonzero(_sliding(padded, width, np.maximum) == grams)


class RunLengthIndex:
    """The run-compressed Burrows-Wheeler transform of some byte strings, with text positions sampled at run ends.

    ``run_symbols`` and ``run_lengths`` are the transform (0: before a string's
    first byte, never joined to a run; else byte + 1). ``heads`` and ``tails``
    are the text positions of each run's first and last suffix; ``head_match``
    and ``tail_match`` how many bytes these share with the suffix above and below.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        count = len(offsets) - 1
        # one terminator behind each string
        text = np.zeros(len(data) + count, dtype=np.int64)
        self.starts = offsets[:-1] + np.arange(count)
        stops = offsets[1:] + np.arange(count)
        self.place = np.arange(len(data)) + np.repeat(np.arange(count), np.diff(offsets))
        text[self.place] = data.astype(np.int64) + 1
        self.text, self.stops = text, stops
        stop = np.zeros(len(text), dtype=np.int64)
        stop[self.place] = np.repeat(stops, np.diff(offsets))
        stop[stops] = stops
        order = self._suffixes(text, stop)
        before = np.where(order > 0, text[order - 1], 0)
        fresh = np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] == 0)])
        runs = np.flatnonzero(fresh)
        ends = np.append(runs[1:], len(order)) - 1
        self.run_symbols, self.run_lengths = before[runs], np.diff(np.append(runs, len(order)))
        self.heads, self.tails = order[runs], order[ends]
        raw = np.zeros(len(text) + 8, np.uint8)
        raw[self.place] = data
        sums = prefix_sums(raw[:-8])
        words = np.ndarray(len(text), "<u8", raw, strides=(1,))  # the eight bytes from each position
        up = np.where(runs > 0, order[runs - 1], -1)
        down = np.where(ends + 1 < len(order), order[np.minimum(ends + 1, len(order) - 1)], -1)
        self.head_match = self._shared(words, sums, stop, self.heads, up)
        self.tail_match = self._shared(words, sums, stop, self.tails, down)

    @staticmethod
    def _suffixes(text: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """All suffixes in order, equal ones by position: prefix doubling, only on what is not yet told apart."""
        n = len(text)
        key, have = text.copy(), 1
        room = np.arange(n)
        for more in (2, 4, 6):  # symbols of 9 bits, none from behind the terminator
            step = min(have, more - have)
            shifted = np.where(room + have <= stop, np.append(key[have:], np.zeros(min(have, n), np.int64))[:n], 0)
            key = (key << (9 * step)) | (shifted >> (9 * (have - step)))
            have = more
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        rank = np.empty(n, dtype=np.int64)
        begin = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank[order] = begin
        depth = have
        tied = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
        longest = int((stop - room).max()) + 1 if n else 0
        while len(tied) and depth <= longest:
            rows = order[tied]
            second = rank[np.minimum(rows + depth, stop[rows])]
            pair = (rank[rows] << 32) | second
            by = np.argsort(pair, kind="stable")
            rows, pair = rows[by], pair[by]
            order[tied] = rows
            new = np.concatenate([[True], pair[1:] != pair[:-1]])
            begin = np.maximum.accumulate(np.where(new, tied, 0))
            rank[rows] = begin
            tied = tied[~(new & np.append(new[1:], True))]
            depth *= 2
        if len(tied):
            rows = order[tied]
            order[tied] = rows[np.lexsort((rows, rank[rows]))]
        return order

    @staticmethod
    def _shared(words: np.ndarray, sums: np.ndarray, stop: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at a and b have in common (b < 0: none).

        The first ``_DIRECT`` are compared eight at a time, which settles nearly all; where they agree the rest is found by hashes of stretches.
        """
        other = np.maximum(b, 0)
        most = np.where(b < 0, 0, np.minimum(stop[a] - a, stop[other] - other))
        shared = np.zeros(len(a), np.int64)
        at = np.flatnonzero(most > 0)
        for done in range(0, _DIRECT, 8):
            differ = words[a[at] + done] ^ words[other[at] + done]
            some = differ != 0
            lowest = differ[some]
            lowest &= ~lowest + _U(1)  # a power of two, in the first byte that differs
            shared[at[some]] = done + (np.log2(lowest.astype(np.float64)).astype(np.int64) >> 3)
            at = at[~some]
            shared[at] = done + 8
            at = at[most[at] > done + 8]
        shared = np.minimum(shared, most)
        one, two, low, high = a[at], other[at], shared[at], most[at]
        while len(open_ := np.flatnonzero(low < high)):
            x, y, mid = one[open_], two[open_], (low[open_] + high[open_] + 1) >> 1
            same = between(sums, x, x + mid) == between(sums, y, y + mid)
            low[open_[same]], high[open_[~same]] = mid[same], mid[~same] - 1
        shared[at] = low
        return shared

    def matching_statistics(self) -> np.ndarray:
        """For each byte of the strings: the length of the longest match with a string that starts anywhere else."""
        reach = np.zeros(len(self.text), dtype=np.int64)
        np.maximum.at(reach, self.heads, self.heads + self.head_match)
        np.maximum.at(reach, self.tails, self.tails + self.tail_match)
        reach = np.maximum.accumulate(reach)
        return np.maximum(reach - np.arange(len(reach)), 0)[self.place]


def covered(statistics: np.ndarray, length: int) -> np.ndarray:
    """Bytes inside a match of ``length`` or more."""
    reach = np.where(statistics >= length, np.arange(len(statistics)) + statistics, 0)
    return np.maximum.accumulate(reach) > np.arange(len(statistics)) if len(reach) else reach.astype(bool)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _segment_rows(length: int, anchor: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, last, data, offsets in slices(batch.column(1)):
                value, content, start, count, twice = segments_of(data, offsets, length, anchor)
                row = np.searchsorted(offsets, start, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), pa.array(content.view(np.int64)), pa.array(ids[first:last][row]), pa.array((start - offsets[row]).astype(np.int64)), pa.array(count.astype(np.int64)), pa.array(twice)],
                    names=["anchor", "content", "doc_id", "start", "windows", "twice"],
                )

    return rows


_SEGMENT = "anchor long, content long, doc_id long, start long, windows long, twice boolean"


def _cut(length: int):
    """Segments with their bytes, from documents with their list of spans."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_buffers(batch.column("text"))
            lists = batch.column("spans")
            flat = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            start = flat.field("start").to_numpy()
            size = flat.field("windows").to_numpy() + length - 1
            begin = at[row] + start
            for lo in range(0, len(row), 4096):  # some thousand segments at a time
                part = slice(lo, lo + 4096)
                ends = np.cumsum(size[part])
                pick = np.arange(ends[-1]) + np.repeat(begin[part] - (ends - size[part]), size[part])
                text = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(raw[pick])]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [flat.field("anchor")[lo : lo + 4096], batch.column("doc_id").take(pa.array(row[part])), pa.array(start[part]), flat.field("copies")[lo : lo + 4096], text],
                    names=["anchor", "doc_id", "start", "copies", "bytes"],
                )

    return rows


def _index(length: int, block_bytes: int):
    """Marked spans of the segments that stand alone, from segments sorted by anchor."""

    def marks(table: pa.Table) -> pa.RecordBatch:
        raw, at = text_buffers(table.column("bytes"))
        data, offsets = raw[at[0] : at[-1]], at - at[0]
        hit = covered(RunLengthIndex(data, offsets).matching_statistics(), length)
        single = table.column("copies").to_numpy() == 1
        hit &= np.repeat(single, np.diff(offsets))
        cut = np.zeros(len(hit) + 1, dtype=bool)
        cut[offsets] = True
        begin, end = _runs(hit)
        inner = np.flatnonzero(cut[:-1] & hit)  # a run may go over from one segment into the next
        begin = np.union1d(begin, inner)
        end = np.union1d(end, inner[np.isin(inner, offsets[1:]) & hit[np.maximum(inner - 1, 0)] & (inner > 0)])
        row = np.searchsorted(offsets, begin, side="right") - 1
        shift = table.column("start").to_numpy()[row] - offsets[row]
        return pa.RecordBatch.from_arrays([pa.array(table.column("doc_id").to_numpy()[row]), pa.array(begin + shift), pa.array(end + shift)], names=["doc_id", "first", "last"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.column("bytes").nbytes
            if size < block_bytes:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            anchors = table.column("anchor").to_numpy()
            last = int(np.searchsorted(anchors, anchors[-1]))  # the last anchor may go on in the next batch
            done = 0
            ends = np.cumsum(np.diff(text_buffers(table.column("bytes"))[1]))
            while done < last:
                upto = int(np.searchsorted(ends, (ends[done - 1] if done else 0) + block_bytes, side="right"))
                upto = min(max(upto, done + 1), last)
                if upto < last:  # whole anchors only
                    upto = int(np.searchsorted(anchors, anchors[upto - 1], side="right"))
                yield marks(table.slice(done, upto - done).combine_chunks())
                done = upto
            rest = table.slice(last)
            held, size = rest.to_batches(), rest.column("bytes").nbytes
        if held and (table := pa.Table.from_batches(held).combine_chunks()).num_rows:
            yield marks(table)

    return rows


def _windows(length: int):
    """Content hashes of the windows of hot segments."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch.column("bytes"), 1 << 18):
                count = np.diff(offsets) - length + 1
                row = np.repeat(np.arange(len(count)), count)
                inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                at = offsets[row] + inner
                value = hash_spans(data, at, at + length)
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), part.column("doc_id").take(pa.array(row)), pa.array(part.column("start").to_numpy()[row] + inner), part.column("copies").take(pa.array(row))],
                    names=["window", "doc_id", "start", "copies"],
                )

    return rows


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT_SEGMENTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, first, last): byte spans of the texts, end exclusive, that lie in repeated strings; they may touch or overlap. Ids must be distinct."""
    return _spans(id_and_text(docs, id_col, text_col), length, anchor, hot, block_bytes)


def _spans(texts: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT_SEGMENTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``repeated_spans`` of (doc_id, text)."""
    bounded_batches(texts.sparkSession)
    long_enough = texts.where(F.octet_length("text") >= length)
    # one shuffle of all segments; only those whose anchor comes again stay
    under = Window.partitionBy("anchor")
    found = long_enough.mapInArrow(_segment_rows(length, anchor), _SEGMENT).withColumns({"rows": F.count("*").over(under), "any_twice": F.max("twice").over(under)})
    found = written(found.where("rows > 1 OR any_twice").drop("rows", "any_twice"), "segments")
    distinct = found.groupBy("anchor", "content").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "start")).alias("at"), F.max("windows").alias("windows"), F.max("twice").alias("twice"))
    distinct = written(distinct.select("anchor", "content", "copies", "at.*", "windows", "twice"), "distinct")
    judged = distinct.join(distinct.groupBy("anchor").agg(F.count("*").alias("kinds")), "anchor")

    copied = distinct.where("copies > 1").select("anchor", "content")
    whole = found.join(copied, ["anchor", "content"], "left_semi").select("doc_id", F.col("start").alias("first"), (F.col("start") + F.col("windows") + length - 1).alias("last"))

    needed = judged.where((F.col("kinds") > 1) | (F.col("twice") & (F.col("copies") == 1)))
    spans = needed.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "start", "windows", "copies", (F.col("kinds") > hot).alias("hot"))).alias("spans"))
    with_text = long_enough.join(spans, "doc_id")
    pieces = with_text.withColumn("spans", F.filter("spans", lambda x: ~x["hot"])).mapInArrow(_cut(length), "anchor long, doc_id long, start long, copies long, bytes binary")
    marked = pieces.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_index(length, block_bytes), "doc_id long, first long, last long")
    out = whole.unionByName(marked)
    if needed.where(F.col("kinds") > hot).limit(1).count():
        many = with_text.withColumn("spans", F.filter("spans", lambda x: x["hot"])).mapInArrow(_cut(length), "anchor long, doc_id long, start long, copies long, bytes binary")
        each = written(many.mapInArrow(_windows(length), "window long, doc_id long, start long, copies long"), "windows")
        again = each.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
        hits = each.where("copies = 1").join(again, "window", "left_semi")
        out = out.unionByName(hits.select("doc_id", F.col("start").alias("first"), (F.col("start") + length).alias("last")))
    return out


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, at = text_buffers(batch.column("text"))
        lists = batch.column("spans")
        flat, edges = lists.flatten(), lists.offsets.to_numpy()
        edges = edges - edges[0]
        first, last = flat.field("first").to_numpy(), flat.field("last").to_numpy()
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for i in range(batch.num_rows):
            data = raw[at[i] : at[i + 1]]
            part = slice(edges[i], edges[i + 1])
            gone = np.zeros(len(data) + 1, dtype=np.int32)
            np.add.at(gone, first[part], 1)
            np.add.at(gone, last[part], -1)
            mask = np.cumsum(gone[:-1]) > 0
            kept = data[~mask].tobytes()
            out["n_bytes"].append(len(data))
            out["n_removed"].append(int(mask.sum()))
            out["n_spans"].append(len(_runs(mask)[0]))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, pa.binary() if k == "kept" else pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items())], names=["doc_id", *out])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters: int) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay).

    Rows with the same id are documents of their own: what one has of another's
    text is repeated. Rows without an id are left out, other columns ignored. Bytes
    that stay may begin or end inside a character, so they are given as binary.
    """
    texts = id_and_text(docs, id_col, text_col).fillna("", "text").withColumn("key", F.xxhash64("doc_id", "text"))
    marked = _spans(texts.select(F.col("key").alias("doc_id"), "text"), **parameters)
    by_doc = marked.distinct().groupBy(F.col("doc_id").alias("key")).agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    none: Column = F.array().cast("array<struct<first: bigint, last: bigint>>")
    joined = texts.join(by_doc, "key", "left").select("doc_id", "text", F.coalesce("spans", none).alias("spans"))
    return joined.mapInArrow(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).drop("kept")
