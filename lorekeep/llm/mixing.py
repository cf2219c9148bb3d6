"""Mixing sources to target weights by Sainte-Laguë apportionment (operator 13).

A source's documents, in a seeded order, are one long row of words that is cut into
blocks of ``block_words`` words, or one less so that they come out even. Blocks go to sources one by one, each to the source with
the highest quotient target / (2 * blocks so far + 1), targets counted in blocks, so every source has an integer quota and
the quotas follow the targets as closely as whole blocks can. A source's quota is dealt
to its shards (ranges of its row of blocks) in the same way, their votes being their blocks.
In a shard every block is taken quota // blocks times, and a seeded choice of quota % blocks
of them once more: block j is chosen if (factor * j + shift) % blocks is below that
rest, with factor and shift drawn from the seed, the source and the shard.

Targets are the sources' shares of all words by weight. No target is above ``most_repeats``
times its source's words: what is above is shared again among the others by weight, until none
is above. Quotas keep to that bound block by block, so no document is taken more often. A source's
words differ from its target by about half a block.

Ids, sizes and sources are shuffled, texts are not. One row for each source goes to the driver: a mix
names its sources, and more than ``most_sources`` are refused. Everything else is done by source
and shard, of which a source has ``shards``, however large it is.

Nulls: a null text has no words and is not taken; a null source is a source of its own, the last. Rows without an
id are left out, other columns ignored. Rows with the same id are separate documents, which lie next to
each other in the row. An empty table has no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import bounded_batches, written
from .textbytes import byte_class, slices, words

#: Words are runs of anything but ASCII white space.
WORD_BYTES = ~byte_class((0x09, 0x0D), (0x20, 0x20))

#: Words of a block, ranges that a source is dealt in, times that a word is taken at most, and sources that the driver holds.
BLOCK_WORDS, SHARDS, MOST_REPEATS, MOST_SOURCES, SEED = 32, 1024, 3, 100_000, 1
#: Weights of the sources in order of their names, again and again.
WEIGHTS = (5, 2, 1)


def word_counts(column: pa.Array) -> np.ndarray:
    """Words of each text of a column."""
    return np.concatenate([np.zeros(0, np.int64), *(np.diff(words(data, offsets, WORD_BYTES).first) for _, _, data, offsets in slices(column))])


def targets(sizes: np.ndarray, weights: np.ndarray, most_repeats: int = MOST_REPEATS) -> np.ndarray:
    """Each source's target: its share by weight of all words, at most ``most_repeats`` times its size, the excess shared again."""
    most = most_repeats * sizes.astype(float)
    out, full = np.zeros(len(sizes)), np.zeros(len(sizes), dtype=bool)
    while not full.all():
        left = sizes.sum() - out[full].sum()
        share = left * weights / weights[~full].sum()
        above = ~full & (share > most)
        if not above.any():
            out[~full] = share[~full]
            break
        out[above], full = most[above], full | above
    return out


def apportioned(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Sainte-Laguë: seats one by one to the highest votes / (2 * own seats + 1), the first of equal ones; nobody gets more than ``most``.

    Seats that are sure are given at once: with a divisor at which no more than all are given, each has what it would have then.
    """
    votes, most = np.asarray(votes, dtype=float), np.asarray(most, dtype=np.int64)
    seats = int(min(seats, most[votes > 0].sum()))
    out = np.zeros(len(votes), dtype=np.int64)
    # a divisor gives at most votes / divisor + 1/2 each
    sure = seats - (len(votes) + 1) / 2
    if sure > 0:
        out = np.minimum(np.floor(votes * (sure / votes.sum()) + 0.5).astype(np.int64), most)
    heap = [(-v / (2 * n + 1), i) for i, (v, n, m) in enumerate(zip(votes, out, most, strict=True)) if v > 0 and n < m]
    heapq.heapify(heap)
    for _ in range(seats - int(out.sum())):
        _, i = heap[0]
        out[i] += 1
        if out[i] < most[i]:
            heapq.heapreplace(heap, (-votes[i] / (2 * out[i] + 1), i))
        else:
            heapq.heappop(heap)
    return out


def steps(blocks: int, seed: list[int]) -> tuple[int, int]:
    """A factor without a common divisor with the number of blocks, and a shift."""
    draw = np.random.default_rng(seed)
    factor = int(draw.integers(0, blocks)) if blocks > 1 else 1
    while np.gcd(factor, blocks) != 1:
        factor += 1
    return factor, int(draw.integers(0, blocks))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size) of the documents."""
    bounded_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(word_counts(batch.column(2)))], names=["doc_id", "source", "size"])

    known = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return known.mapInArrow(rows, "doc_id long, source string, size long")


def quotas(sizes: DataFrame, weights: tuple[int, ...], block_words: int, most_repeats: int, most_sources: int) -> DataFrame:
    """One row a source: source, place, source_size, target, words of its shorter blocks, how many have one more (they come first), quota."""
    held = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).limit(most_sources + 1).collect()
    if len(held) > most_sources:
        raise ValueError(f"more than {most_sources} sources: name them more coarsely")
    held.sort(key=lambda r: (r.source is None, r.source or ""))
    size = np.array([r.source_size for r in held], dtype=np.int64)
    weight = np.array([weights[i % len(weights)] for i in range(len(held))], dtype=float)
    aim = targets(size, weight, most_repeats) if size.sum() else np.zeros(len(size))
    blocks = -(-size // block_words)
    some = np.maximum(blocks, 1)
    votes = aim * blocks / np.maximum(size, 1)  # targets in blocks of the source
    quota = apportioned(votes, round(votes.sum()), most_repeats * blocks)
    rows = [(r.source, i, int(size[i]), float(aim[i]), int(size[i] // some[i]), int(size[i] % some[i]), int(quota[i])) for i, r in enumerate(held)]
    return sizes.sparkSession.createDataFrame(rows, "source string, place long, source_size long, target double, width long, longer long, quota long")


def _block_of(word: Column, width: Column, longer: Column) -> Column:
    """The block of a source in which a word stands."""
    ahead = longer * (width + 1)
    return F.when(word < ahead, F.floor(word / (width + 1))).otherwise(longer + F.floor((word - ahead) / F.greatest(width, F.lit(1))))


_SHARD = "place long, shard long, base long, width long, longer long, first_block long, blocks long, each long, rest long, factor long, shift long, carried long"


def _shard_rows(most_repeats: int, seed: int):
    def rows(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
        """A source's shards, in order: a shard has the blocks that begin in it; ``carried`` is how often the block is taken that began before it."""
        held = held.sort_values("shard")
        place, size = int(key[0]), held["words"].to_numpy(np.int64)
        end = np.cumsum(size)
        base = end - size
        width, longer = int(held["width"].iloc[0]), int(held["longer"].iloc[0])
        ahead = longer * (width + 1)
        begun = lambda upto: np.where(upto <= ahead, -(-upto // (width + 1)), longer + -(-(upto - ahead) // max(width, 1)))  # noqa: E731  blocks that begin before a word
        first = begun(base)
        blocks = begun(end) - first
        quota = apportioned(blocks, int(held["quota"].iloc[0]), most_repeats * blocks)
        out, carried = [], 0
        for i in range(len(held)):
            n, q, shard = int(blocks[i]), int(quota[i]), int(held["shard"].iloc[i])
            factor, shift = steps(n, [seed, place, shard]) if n else (0, 0)
            out.append((place, shard, int(base[i]), width, longer, int(first[i]), n, q // n if n else 0, q % n if n else 0, factor, shift, carried))
            if n:
                carried = q // n + int((factor * (n - 1) + shift) % n < q % n)
        return pd.DataFrame(out, columns=[x.split()[0] for x in _SHARD.split(", ")])

    return rows


def _pieces() -> Column:
    """The blocks that a document has words of: its first word there, the word behind the last, and how often they are taken."""
    start, end = F.col("base") + F.col("behind") - F.col("size"), F.col("base") + F.col("behind")

    width, longer = F.col("width"), F.col("longer")
    edge = lambda j: j * width + F.least(j, longer)

    def piece(j: Column) -> Column:
        at = j - F.col("first_block")
        more = ((F.col("factor") * at + F.col("shift")) % F.col("blocks") < F.col("rest")).cast("long")
        often = F.when(at < 0, F.col("carried")).otherwise(F.col("each") + more)
        return F.struct((F.greatest(edge(j), start) - start).alias("first"), (F.least(edge(j + 1), end) - start).alias("last"), often.alias("copies"))

    every = F.transform(F.sequence(_block_of(start, width, longer), _block_of(end - 1, width, longer)), piece)
    return F.filter(F.when(F.col("size") > 0, every).otherwise(F.array()), lambda x: x["copies"] > 0)


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
    block_words: int = BLOCK_WORDS, shards: int = SHARDS, most_repeats: int = MOST_REPEATS, most_sources: int = MOST_SOURCES, seed: int = SEED,
) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken (words, repeats counted), pieces (ranges of words and how often each is taken)."""
    sizes = written(sized(docs, id_col, text_col, source_col), "sizes")
    named = written(quotas(sizes, weights, block_words, most_repeats, most_sources).withColumnRenamed("source", "name"), "quotas")
    known = sizes.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("name")))  # most_sources rows
    turn = F.xxhash64(F.lit(seed), "doc_id")
    dealt = known.select("doc_id", "size", "source", "place", "source_size", "target", "width", "longer", "quota", turn.alias("turn"), F.pmod(turn, F.lit(shards)).alias("shard"))
    totals = dealt.groupBy("place", "shard").agg(F.sum("size").alias("words"), *(F.any_value(c).alias(c) for c in ("width", "longer", "quota")))
    # at most ``shards`` rows of a source
    table = written(totals.groupBy("place").applyInPandas(_shard_rows(most_repeats, seed), _SHARD), "shards")
    order = Window.partitionBy("place", "shard").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.drop("width", "longer", "quota").withColumn("behind", F.sum("size").over(order)).join(table, ["place", "shard"])
    out = placed.withColumn("pieces", _pieces())
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda s, x: s + (x["last"] - x["first"]) * x["copies"])
    return out.select("doc_id", "size", "source", "source_size", "target", taken.alias("taken"), "pieces")


def mixed_texts(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, first, copies, text): the words of each piece of a plan of ``mix``, as they stand in the text; for tables whose ids are unique."""
    bounded_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = batch.column(2).to_pylist()
            for lo, _, data, offsets in slices(batch.column(1)):
                found, out = words(data, offsets, WORD_BYTES), []
                for i in range(len(offsets) - 1):
                    at = found.first[i]
                    out += [(batch.column(0)[lo + i].as_py(), x["first"], x["copies"], data[found.starts[at + x["first"]] : found.ends[at + x["last"] - 1]].tobytes().decode()) for x in pieces[lo + i]]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "first", "copies", "text"])

    some = plan.where("taken > 0").select("doc_id", "pieces")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(some, "doc_id").select("doc_id", "text", "pieces").mapInArrow(rows, "doc_id long, first long, copies long, text string")


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source")
