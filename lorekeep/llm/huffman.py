"""Token ids in canonical, length-limited Huffman codes (operator 3).

A file has a header, the code length of each id, from which the canonical codes
follow, and blocks. A block holds whole documents in ascending order of their
ids and decodes by itself: after its bit stream's checkpoints, the bit offset of
every ``interval``-th symbol, come the codes, first bit first. All stretches
between checkpoints are decoded side by side, each step one table look-up of
``limit`` bits.

Code lengths come from the counts of all ids in the corpus, by package-merge.
Counts are summed in each task before anything is sent; what reaches the driver
is bounded by the vocabulary. Documents are put in order by a range shuffle of
the ids, not of the texts. The blocks lie in a Parquet table in the given folder.

Null and empty texts are the end id alone. Rows with the same id each have a place
of their own, one behind the other in the order of their ids' bytes. Rows without
an id are left out. Other columns are ignored. An empty table makes a file without
blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .inputs import id_and_text
from .scratch import bounded_batches, new_path, written
from .textbytes import text_buffers
from .tokens import encoder

END_ID = 2
LIMIT = 20
INTERVAL = 128
BLOCK_TOKENS = 1 << 18
MAGIC = b"LKH1"

_U = np.uint64


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The optimal code length, at most ``limit``, of each symbol that occurs (0: does not occur), by package-merge."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need codes of more than {limit} bits")
    by_weight = used[np.argsort(counts[used], kind="stable")]
    weights = counts[by_weight].astype(np.int64)
    symbols_upto, level = [], weights
    for step in range(limit):
        if step:
            packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
            both = np.concatenate([weights, packages])
            order = np.argsort(both, kind="stable")
            level, is_symbol = both[order], order < len(weights)
        else:
            is_symbol = np.ones(len(weights), dtype=bool)
        symbols_upto.append(np.concatenate([[0], np.cumsum(is_symbol)]))
    take = 2 * len(used) - 2
    for upto in reversed(symbols_upto):
        lengths[by_weight[: upto[take]]] += 1
        take = 2 * (take - upto[take])
    return lengths


class Code:
    """Canonical codes and the decoding table for some code lengths."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.lengths = lengths.astype(np.int64)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        self.limit = int(self.lengths.max()) if len(used) else 1
        slots = 1 << (self.limit - self.lengths[order])  # of the table for each code
        begin = np.cumsum(slots) - slots
        self.codes = np.zeros(len(lengths), dtype=np.uint64)
        self.codes[order] = (begin >> (self.limit - self.lengths[order])).astype(np.uint64)
        self.symbol_at = np.zeros(1 << self.limit, dtype=np.uint32)
        self.length_at = np.ones(1 << self.limit, dtype=np.int64)
        self.symbol_at[: slots.sum()] = np.repeat(order, slots)
        self.length_at[: slots.sum()] = np.repeat(self.lengths[order], slots)

    def encode(self, ids: np.ndarray, interval: int = INTERVAL) -> bytes:
        """A block: magic, symbols, interval, words, checkpoints (64-bit bit offsets), 32-bit big-endian words."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        at = ends - size
        words = np.zeros((int(ends[-1]) >> 5) + 3 if len(ids) else 2, dtype=np.uint64)
        if len(ids):
            word = at >> 5
            value = self.codes[ids] << (64 - size - (at & 31)).astype(np.uint64)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            both = np.add.reduceat(value, first)
            words[word[first]] += both >> _U(32)
            words[word[first] + 1] += both & _U(0xFFFFFFFF)
        marks = at[::interval].astype("<u8")
        return struct.pack("<4sQII", MAGIC, len(ids), interval, len(words)) + marks.tobytes() + words.astype(">u4").tobytes()

    def decode(self, block: bytes) -> np.ndarray:
        magic, count, interval, n_words = struct.unpack_from("<4sQII", block)
        if magic != MAGIC:
            raise ValueError("not a block of ids")
        head = struct.calcsize("<4sQII")
        lanes = -(-count // interval)
        at = np.frombuffer(block, "<u8", lanes, head).astype(np.int64)
        words = np.frombuffer(block, ">u4", n_words, head + 8 * lanes).astype(np.uint64)
        pairs = (words[:-1] << _U(32)) | words[1:]
        out = np.zeros((lanes, interval), dtype=np.uint32)
        shift = _U(64 - self.limit)
        for step in range(interval):
            if step == (count - 1) % interval + 1:  # the last stretch ends here
                at = at[:-1]
            if not len(at):
                break
            peek = (pairs[at >> 5] << (at & 31).astype(np.uint64)) >> shift
            out[: len(at), step] = self.symbol_at[peek]
            at = at + self.length_at[peek]
        return out.reshape(-1)[:count]


def _token_rows(path: str, end_id: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).ids
        for batch in batches:
            ids = [np.append(np.frombuffer(encode(t.as_py()), "<u4"), np.uint32(end_id)) for t in batch.column(1)]
            small = [x.astype("<u2").tobytes() if x.max() < 1 << 16 else x.tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(small, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return rows


def _ids(raw: np.ndarray, n_tokens: int) -> np.ndarray:
    return raw.view("<u2" if len(raw) == 2 * n_tokens else "<u4").astype(np.int64)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1, dtype=np.int64)
    for batch in batches:
        raw, at = text_buffers(batch.column(1))
        n_tokens = batch.column(0).to_numpy()
        small = np.diff(at) == 2 * n_tokens
        if small.all():  # one count of the whole batch
            parts = [raw[at[0] : at[-1]].copy().view("<u2")]
        else:
            parts = [_ids(raw[at[i] : at[i + 1]].copy(), n) for i, n in enumerate(n_tokens)]
        for ids in parts:
            found = np.bincount(ids)
            if len(found) > len(total):
                total = np.pad(total, (0, len(found) - len(total)))
            total[: len(found)] += found
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])


def _block_rows(lengths: bytes, interval: int, block_tokens: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(np.frombuffer(lengths, np.uint8))
        docs: list[int] = []
        sizes: list[int] = []
        held: list[np.ndarray] = []
        made = 0  # rows of one id lie in one task, so the first id and this number name a block

        def block() -> pa.RecordBatch:
            nonlocal made
            data = code.encode(np.concatenate(held), interval)
            out = pa.RecordBatch.from_arrays(
                [pa.array([docs[0]]), pa.array([made]), pa.array([sum(sizes)]), pa.array([docs], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([data], pa.binary())],
                names=["first_doc", "nth", "n_ids", "docs", "sizes", "data"],
            )
            docs.clear(), sizes.clear(), held.clear()
            made += 1
            return out

        total = 0
        for batch in batches:
            raw, at = text_buffers(batch.column("ids"))
            for i, (doc, n) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True)):
                if total + n > block_tokens and held:
                    yield block()
                    total = 0
                docs.append(doc)
                sizes.append(n)
                held.append(_ids(raw[at[i] : at[i + 1]].copy(), n))
                total += n
        if held:
            yield block()

    return rows


_BLOCK = "first_doc long, nth long, n_ids long, docs array<long>, sizes array<long>, data binary"


def write_ids(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, limit: int = LIMIT, interval: int = INTERVAL, block_tokens: int = BLOCK_TOKENS) -> None:
    """Write the ids of the texts, ``end_id`` after each document, to a file (a folder with ``header`` and ``blocks``)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = id_and_text(docs, id_col, text_col)
    path = path or public_tokenizers.path("word_bpe_49k.json")
    tokens = written(texts.mapInArrow(_token_rows(path, end_id), "doc_id long, n_tokens long, ids binary"), "tokens", compression="zstd")
    counted = tokens.select("n_tokens", "ids").mapInArrow(_count_rows, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([end_id, *(r.id for r in counted)]) + 1, dtype=np.int64)
    for r in counted:
        counts[r.id] = r.n
    lengths = code_lengths(counts, limit).tobytes()
    spark.createDataFrame([(limit, interval, bytearray(lengths))], "limit int, interval int, lengths binary").coalesce(1).write.parquet(f"{folder}/header")
    in_order = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    in_order.mapInArrow(_block_rows(lengths, interval, block_tokens), _BLOCK).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def _decoded_rows(lengths: bytes, keep_ids: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(np.frombuffer(lengths, np.uint8))
        for batch in batches:
            for i in range(batch.num_rows):
                ids = code.decode(batch.column("data")[i].as_py()).astype("<u4")
                docs, sizes = batch.column("docs")[i].values, batch.column("sizes")[i].values.to_numpy()
                ends = np.cumsum(sizes)
                parts = [ids[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)]
                first, nth = batch.column("first_doc")[i].as_py(), batch.column("nth")[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array(np.full(len(docs), first)), pa.array(np.full(len(docs), nth)), pa.array(ends - sizes), pa.array(sizes), pa.array([zlib.crc32(p) for p in parts], pa.int64()), *([pa.array(parts, pa.binary())] if keep_ids else [])],
                    names=["doc_id", "first_doc", "nth", "inside", "n_tokens", "ids_crc32", *["ids"] * keep_ids],
                )

    return rows


def block_starts(blocks: DataFrame) -> DataFrame:
    """(first_doc, nth, before): the number of ids before each block; sums within ranges, of which one number each goes to the driver."""
    slim = written(blocks.select("first_doc", "nth", "n_ids").repartitionByRange("first_doc").withColumn("range", F.spark_partition_id()), "block-sizes")
    sums = sorted((r.range, r.n) for r in slim.groupBy("range").agg(F.sum("n_ids").alias("n")).collect())
    before, so_far = [], 0
    for key, n in sums:
        before.append((key, so_far))
        so_far += n
    offsets = slim.sparkSession.createDataFrame(before, "range int, ahead long")
    inside = Window.partitionBy("range").orderBy("first_doc", "nth").rowsBetween(Window.unboundedPreceding, -1)
    return slim.join(offsets, "range").select("first_doc", "nth", (F.col("ahead") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("before"))


def read_ids(spark: SparkSession, folder: str, keep_ids: bool = True) -> DataFrame:
    """One row per document of the file: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids (little-endian unsigned 32-bit)."""
    bounded_batches(spark)
    lengths = bytes(spark.read.parquet(f"{folder}/header").first().lengths)
    blocks = spark.read.schema(_BLOCK).parquet(f"{folder}/blocks")
    schema = "doc_id long, first_doc long, nth long, inside long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids
    found = blocks.mapInArrow(_decoded_rows(lengths, keep_ids), schema)
    return found.join(block_starts(blocks), ["first_doc", "nth"]).withColumn("start", F.col("before") + F.col("inside")).select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * keep_ids)


def op3_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "ids")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_ids(spark, folder, keep_ids=False)
