"""Sum-of-squares online packing of token sequences (operator 5).

Sequences hold at most ``size`` tokens. A document's tokens are cut into whole
sequences and a rest. The rest goes to the fill level for which the sum of
squares of the counts of partially filled sequences, by level, becomes least;
the counts are kept in a level array. This keeps no level crowded, so that
later rests find a sequence that they fill exactly.

Each task packs its own rows and needs no shuffle; what it holds is the open
sequences, at most ``most_open`` of them (a bound of memory, reached by tasks of
millions of documents; no id is lost or padded by it, some rests are cut once more).
At the end of a task, or when so many are open, the emptiest of them are cut to fill
the fullest, and a task's last sequence is cut at powers of two, at which no padding
is needed.

Null texts are empty: a document of the end id alone. Rows with the same id are
packed each by itself, with pieces of the same id. Rows without an id are left out,
other columns ignored. Sequence ids are distinct and repeatable (task number and
count), not dense.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .inputs import id_and_text
from .scratch import bounded_batches
from .tokens import encoder

SIZE = 1024
END_ID = 0
MOST_OPEN = 4096

#: (doc_id, start, ids as bytes, tokens of the document)
Piece = tuple[int, int, bytes, int]


class LevelPacker:
    """Packs pieces of under ``size`` tokens; full sequences come out as (sequence number, pieces)."""

    def __init__(self, size: int = SIZE, most_open: int = MOST_OPEN) -> None:
        self.size, self.most_open = size, most_open
        self.counts = np.zeros(size + 1, dtype=np.int64)  # by fill level; 0 and size stay 0
        self.open: list[list[list[Piece]]] = [[] for _ in range(size + 1)]
        self.opened = 0

    def level_for(self, length: int) -> int:
        """The fill level (0: a new sequence) at which a piece raises the sum of squares least, the highest of equals."""
        low, high = self.counts[: self.size - length + 1], self.counts[length:]
        cost = 2 * high + 1 + np.where(np.arange(len(low)) == 0, 0, 1 - 2 * low)
        cost[-1] -= 2 * high[-1] + 1  # a full sequence is gone
        cost[1:][low[1:] == 0] = np.iinfo(np.int64).max
        return len(cost) - 1 - int(np.argmin(cost[::-1]))

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        length = len(piece[2]) // 4
        level = self.level_for(length)
        if level:
            pieces = self.open[level].pop()
            self.counts[level] -= 1
        else:
            pieces = []
            self.opened += 1
        pieces.append(piece)
        if level + length == self.size:
            self.opened -= 1
            yield pieces
            return
        self.open[level + length].append(pieces)
        self.counts[level + length] += 1
        if self.opened > self.most_open:
            yield from self.close(last=False)

    def close(self, last: bool = True) -> Iterator[list[Piece]]:
        """Fill the fullest open sequences with pieces of the emptiest; one is left at most, cut at powers of two if it is the last."""
        waiting = [pieces for level in range(self.size, 0, -1) for pieces in self.open[level]]
        self.open = [[] for _ in range(self.size + 1)]
        self.counts[:] = 0
        self.opened = 0
        while waiting:
            target = waiting.pop(0)
            room = self.size - sum(len(p[2]) for p in target) // 4
            while room and waiting:
                doc, start, ids, total = waiting[-1].pop()
                taken, rest = ids[: 4 * room], ids[4 * room :]
                target.append((doc, start, taken, total))
                room -= len(taken) // 4
                if rest:
                    waiting[-1].append((doc, start + len(taken) // 4, rest, total))
                elif not waiting[-1]:
                    waiting.pop()
            if not room:
                yield target
            elif last:
                yield from self._at_powers(target)
            else:
                self.open[self.size - room].append(target)
                self.counts[self.size - room] = 1
                self.opened = 1

    def _at_powers(self, pieces: list[Piece]) -> Iterator[list[Piece]]:
        left = sum(len(p[2]) for p in pieces) // 4
        pieces = pieces[::-1]
        while left:
            goal = 1 << (left.bit_length() - 1)
            left -= goal
            out: list[Piece] = []
            while goal:
                doc, start, ids, total = pieces.pop()
                out.append((doc, start, ids[: 4 * goal], total))
                if len(ids) > 4 * goal:
                    pieces.append((doc, start + goal, ids[4 * goal :], total))
                goal -= len(out[-1][2]) // 4
            yield out


def _pack_rows(path: str, end_id: int, size: int, most_open: int, keep_ids: bool):
    end = np.array([end_id], dtype="<u4").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(path).ids, LevelPacker(size, most_open)
        number = TaskContext.get().partitionId() << 40
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
            columns = [pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, zip(*out, strict=True), strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        def put(sequences: Iterator[list[Piece]]) -> None:
            nonlocal number
            for pieces in sequences:
                at = 0
                for doc, start, ids, total in pieces:
                    out.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, number, at, *([ids] if keep_ids else [])))
                    at += len(ids) // 4
                number += 1

        for part in batches:
            for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                ids = encode(text.as_py()) + end
                total = len(ids) // 4
                whole = total // size * size
                for start in range(0, whole, size):
                    put([[(doc, start, ids[4 * start : 4 * (start + size)], total)]])
                if whole < total:
                    put(packer.add((doc, whole, ids[4 * whole :], total)))
                if len(out) >= 2000:
                    yield batch()
        put(packer.close())
        if out:
            yield batch()

    return rows


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, size: int = SIZE, most_open: int = MOST_OPEN, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids (little-endian unsigned 32-bit)."""
    bounded_batches(docs.sparkSession)
    texts = id_and_text(docs, id_col, text_col)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids
    return texts.mapInArrow(_pack_rows(path or public_tokenizers.path("byte_bpe_50k.json"), end_id, size, most_open, keep_ids), schema)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_ids=False)
