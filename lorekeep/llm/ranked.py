"""Ranked lexical search by three-phase uniform thresholds over term-partitioned postings (operator 11).

The index holds, for each term and each segment of about a megabyte of texts, a block: the
documents that have the term and the term's impact in each, greatest first. Blocks are stored by
term; a frequent term has many blocks, which any number of tasks may hold. An impact depends on the
document alone, so one index serves all questions; what a term is worth (``w``) is a factor of its list.

A question's answer is the ``k`` documents with the greatest sums of w * impact over its terms:

1. heads: the ``k`` greatest postings of each of its terms are fetched. The k-th greatest sum of what
   they give is a lower bound of the k-th score.
2. one threshold for all its lists: the greatest T for which a document with less than T in every list (and no more
   than a list's greatest value) stays below that bound. All postings of at least T are fetched; no
   other document can be among the first k. A document lies in one segment, so the lists' blocks meet by segment and
   are summed there for all questions at once, whatever number of them has a term; a document goes on only
   if it could reach the bound with all that it might have in lists where it was not seen. One of ``AHEAD`` segments is summed before
   the others: the k-th greatest sum there is a better bound for all. The sums of what goes on give the last one, which drops most of it.
3. look-up: the exact scores of the documents that are left, from their postings in all lists.

Terms are compared by 64-bit hashes. Only blocks go through shuffles, texts never; a block and a segment are
of bounded size, and hot terms are split wherever rows are dealt by term: by Spark's rebalancing when the
index is written, by a bound on row numbers inside each task before heads are ranked. In step 2 the thresholds
go to all tasks; their number is checked, and questions are taken in parts of about ``PART_ITEMS`` items and ``PART_TERMS`` terms,
with one reading of the lists for each part.

Documents: rows with the same id are separate documents (each may be in a result); null and empty texts have no
terms and don't count; rows without an id are left out. Items: those without an id or a term have no result, rows with the
same id are one item with the terms of all. Other columns are ignored. Ties go by ascending doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sizes import small
from .decontaminate import WORD_BYTES
from .inputs import id_and_text
from .near import FILTER_BITS, id_filter
from .scratch import bounded_batches, written
from .textbytes import slices, words

#: Documents of a result, and bytes of look-ups that are broadcast at once.
K, MOST_BYTES = 50, 32 << 20
#: One of so many segments is summed ahead.
AHEAD = 16
#: Items, and terms of items, whose thresholds are sent to the tasks at once.
PART_ITEMS, PART_TERMS = 1000, 500_000
#: A document is named by its segment and its place there.
_PLACES = 1 << 20


@dataclass
class Index:
    """``blocks``: term, segment, docs (places), impacts (greatest first), top; ``ids``: segment, ids; documents with a term, and all their terms."""

    blocks: DataFrame
    ids: DataFrame
    documents: int
    terms: int


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    some, total = 0, 0
    for batch in batches:
        for _, _, data, offsets in slices(batch.column(0)):
            n = np.diff(words(data, offsets, WORD_BYTES).first)
            some, total = some + int((n > 0).sum()), total + int(n.sum())
    yield pa.RecordBatch.from_arrays([pa.array([some]), pa.array([total])], names=["documents", "terms"])


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What an occurrence count gives in a document of ``n`` terms, in whole numbers."""
    m = 50 + (50 * n * documents) // max(terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _lists(values: np.ndarray, edges: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values, kind))


_BLOCK = "term long, segment long, docs array<int>, impacts array<int>, top int, ids array<long>"


def _block_rows(documents: int, terms: int, packed: bytes | None):
    """Blocks of a segment, and one row without a term that has the ids of its documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 24
        wanted = None if packed is None else np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, data, offsets in slices(batch.column(1)):
                found = words(data, offsets, WORD_BYTES)
                length = np.diff(found.first)
                listed, row = found.hashes().view(np.int64), found.row
                if wanted is not None:
                    ours = wanted[listed % FILTER_BITS]
                    listed, row = listed[ours], row[ours]
                vocabulary, which = np.unique(listed, return_inverse=True)
                held, tf = np.unique(which.reshape(-1) * (hi - lo) + row, return_counts=True)
                term, doc = np.divmod(held, hi - lo)
                impact = impacts(tf, length[doc], documents, terms)
                order = np.lexsort((doc, -impact, term))
                edges = np.searchsorted(term, np.arange(len(vocabulary) + 1))
                docs, impact, n = doc[order].astype(np.int32), impact[order].astype(np.int32), len(vocabulary)
                columns = [pa.array(vocabulary), pa.array(np.full(n, segment)), _lists(docs, edges, pa.int32()), _lists(impact, edges, pa.int32()), pa.array(impact[edges[:-1]]), pa.nulls(n, pa.list_(pa.int64()))]
                names = ["term", "segment", "docs", "impacts", "top", "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                none = [pa.nulls(1, kind) for kind in (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32())]
                yield pa.RecordBatch.from_arrays([none[0], pa.array([segment]), *none[1:], pa.array([ids[lo:hi]], pa.list_(pa.int64()))], names=names)
                segment += 1

    return rows


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", only: DataFrame | None = None) -> Index:
    """The stored index of all terms of ``docs``, or of the terms of ``only`` (a column ``term``) and no others."""
    bounded_batches(docs.sparkSession)
    texts = id_and_text(docs, id_col, text_col)
    counted = texts.select("text").mapInArrow(_count_rows, "documents long, terms long").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("documents", "terms"))).first()
    # a filter of fixed size spares most other terms their way through Python's door, the join drops the rest
    packed = None if only is None else np.packbits(id_filter(only.select(F.col("term").alias("doc_id")))).tobytes()
    made = texts.mapInArrow(_block_rows(counted.documents, counted.terms, packed), _BLOCK)
    if only is not None:
        wanted = small(only.select("term", F.lit(True).alias("wanted")).distinct(), MOST_BYTES)
        made = made.join(wanted, "term", "left").where("term IS NULL OR wanted").drop("wanted")
    stored = written(made.hint("rebalance", "term").sortWithinPartitions("term", F.desc("top")), "index", compression="zstd")
    return Index(stored.where("term IS NOT NULL").drop("ids"), stored.where("term IS NULL").select("segment", "ids"), counted.documents, counted.terms)


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column(1)):
            found = words(data, offsets, WORD_BYTES)
            pairs = np.unique(np.column_stack([found.row, found.hashes().view(np.int64)]), axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(pairs[:, 0])), pa.array(pairs[:, 1])], names=["item_id", "term"])


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term): the different terms of each item."""
    bounded_batches(items.sparkSession)
    return id_and_text(items, id_col, text_col).mapInArrow(_term_rows, "item_id long, term long").distinct()


def _kth(sums: DataFrame, k: int, name: str) -> DataFrame:
    """(item_id, ``name``): the k-th greatest ``got`` of each item that has so many."""
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("got"), "row"))
    return sums.withColumn("_n", place).where(F.col("_n") <= k).groupBy("item_id").agg(F.count("*").alias("_rows"), F.min("got").alias(name)).where(F.col("_rows") == k).drop("_rows")


def _row() -> Column:
    return (F.col("segment") * _PLACES + F.col("_at.doc")).alias("row")


def _postings(blocks: DataFrame, kept: Column, *names: str) -> DataFrame:
    """A row for each posting of the blocks that fulfils ``kept``, a test of (impact, its place in the block) as a function of columns."""
    each = F.explode(F.filter(F.arrays_zip(F.col("docs").alias("doc"), F.col("impacts").alias("impact")), kept))
    return blocks.select(*names, "segment", each.alias("_at")).select(*names, _row(), F.col("_at.impact").alias("impact"))


def heads(blocks: DataFrame, k: int) -> DataFrame:
    """(term, row, impact): the k greatest postings of each term. They lie in the k blocks with the greatest tops."""
    by_top = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("top"), "segment"))
    first = blocks.withColumn("_n", by_top).where(F.col("_n") <= k)
    short = first.select("term", "segment", F.slice("docs", 1, k).alias("docs"), F.slice("impacts", 1, k).alias("impacts"))
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"), "row"))
    return _postings(short, lambda x: F.lit(True), "term").withColumn("_n", place).where(F.col("_n") <= k).drop("_n")


def thresholds(lists: DataFrame, bounds: DataFrame) -> DataFrame:
    """``lists`` with ``level``, the item's threshold, and ``slack``, the most that the list gives to a document below it.

    What lists give below x is the sum of min(x, most); of the lists in order of what they give at most, those up to
    the j-th in full and x for each other one are never less, so the greatest x is the greatest of what these bounds allow.
    """
    order = Window.partitionBy("item_id").orderBy("most", "term")
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.count("*").over(Window.partitionBy("item_id")) - F.row_number().over(order) + 1
    x = F.floor((F.coalesce("bound", F.lit(0)) - 1 - before) / left)
    level = F.greatest(F.max("x").over(Window.partitionBy("item_id")) + 1, F.lit(1))
    known = lists.join(bounds, "item_id", "left").withColumn("x", x).withColumn("level", level)
    return known.select("item_id", "term", "w", "most", "level", F.least(F.col("level") - 1, "most").alias("slack"), F.coalesce("bound", F.lit(0)).alias("bound"))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, np.ndarray, np.ndarray]]]]:
    """The segment's number and the (term, places, impacts) of its blocks, from rows sorted by segment."""
    held, of = [], None
    for batch in batches:
        segments, terms = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        at = batch.column(2).offsets.to_numpy()
        docs, impact = (batch.column(i).values.to_numpy() for i in (2, 3))
        for i in range(batch.num_rows):
            if segments[i] != of and held:
                yield of, held
                held = []
            of = int(segments[i])
            held.append((int(terms[i]), docs[at[i] : at[i + 1]], impact[at[i] : at[i + 1]].astype(np.int64)))
    if held:
        yield of, held


def _sum_rows(limits: pa.Table):
    """Sums of the postings that are not below their lists' thresholds, of the documents that could reach their item's bound."""
    items, which = np.unique(limits.column("item_id").to_numpy(), return_inverse=True)
    every, bound = np.zeros((2, len(items)), dtype=np.int64)
    np.add.at(every, which, limits.column("slack").to_numpy())
    bound[which] = limits.column("bound").to_numpy()
    some = np.flatnonzero(limits.column("most").to_numpy() >= limits.column("level").to_numpy())
    order = some[np.argsort(limits.column("term").to_numpy()[some], kind="stable")]
    term, which = limits.column("term").to_numpy()[order], which.reshape(-1)[order]
    w, slack, level = (limits.column(c).to_numpy()[order] for c in ("w", "slack", "level"))
    least = -(-level // w)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment, blocks in _segments(batches):
            got, known = np.zeros((2, len(items), 1 + max(int(docs.max()) for _, docs, _ in blocks)), dtype=np.int64)
            for of, docs, impact in blocks:
                lo, hi = np.searchsorted(term, of), np.searchsorted(term, of, side="right")
                if lo == hi:
                    continue
                upto = np.searchsorted(-impact, -least[lo:hi], side="right")
                most = int(upto.max())
                at = np.flatnonzero(upto)
                if len(at):
                    mask = np.arange(most) < upto[at, None]
                    place = (which[lo:hi][at, None], docs[None, :most])
                    got[place] += mask * (w[lo:hi][at, None] * impact[None, :most])
                    known[place] += mask * slack[lo:hi][at, None]
            reach = got + every[:, None] - known
            item, doc = np.nonzero((got > 0) & (reach >= bound[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(items[item]), pa.array(segment * _PLACES + doc), pa.array(got[item, doc]), pa.array(reach[item, doc])], names=["item_id", "row", "got", "most"])

    return rows


def _fetched(blocks: DataFrame, limits: DataFrame) -> DataFrame:
    """(item_id, row, got, most): what postings above the thresholds give, and what a document may have at most."""
    size = limits.agg(F.count_distinct("item_id").alias("items"), F.count("*").alias("terms")).first()
    parts = max(1, -(-size["items"] // PART_ITEMS), -(-size["terms"] // PART_TERMS))
    out = []
    for part in range(parts):
        ours = limits.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        # a block goes on if any item wants something of it
        wanted = ours.where("most >= level").groupBy("term").agg(F.min(F.ceil(F.col("level") / F.col("w"))).alias("least"))
        met = blocks.join(F.broadcast(wanted), "term").where("top >= least").select("segment", "term", "docs", "impacts")
        together = met.repartition("segment").sortWithinPartitions("segment", "term")
        out.append(together.mapInArrow(_sum_rows(ours.toArrow()), "item_id long, row long, got long, most long"))
    return reduce(DataFrame.unionByName, out)


def exact(blocks: DataFrame, lists: DataFrame, pairs: DataFrame, most_bytes: int) -> DataFrame:
    """(item_id, row, score) of the pairs (item_id, row): what all lists of the item have of the document."""
    segment, doc = F.floor(F.col("row") / _PLACES).alias("segment"), (F.col("row") % _PLACES).cast("int").alias("doc")
    asked = written(pairs.select("item_id", "row").join(lists, "item_id").select("item_id", "row", "term", "w", segment, doc), "asked")
    place = F.array_position("docs", F.col("doc"))
    found = blocks.join(small(asked, most_bytes), ["term", "segment"]).where(place > 0).select("item_id", "row", (F.col("w") * F.col("impacts")[(place - 1).cast("int")]).alias("part"))
    return found.groupBy("item_id", "row").agg(F.sum("part").alias("score")).where("score > 0")


def search(index: Index, items: DataFrame, k: int = K, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, those with a score above 0; ``items`` are (item_id, term)."""
    blocks = index.blocks
    known = blocks.groupBy("term").agg(F.sum(F.size("docs")).alias("df"), F.max("top").cast("long").alias("top"))
    w = F.floor(1000 * F.log((2.0 * index.documents + 2) / (2 * F.col("df") + 1)))
    lists = written(items.join(known, "term").select("item_id", "term", w.alias("w"), (w * F.col("top")).alias("most")).where("most > 0"), "lists")

    first = lists.join(heads(blocks, k), "term").groupBy("item_id", "row").agg(F.sum(F.col("w") * F.col("impact")).alias("got"))
    limits = written(thresholds(lists, _kth(first, k, "bound")), "thresholds")

    # what is k-th among some documents is no more than what is k-th among all
    some = _fetched(blocks.where(F.pmod("segment", F.lit(AHEAD)) == 0), limits)
    better = limits.join(_kth(some, k, "better"), "item_id", "left").withColumn("bound", F.greatest("bound", F.coalesce("better", F.lit(0)))).drop("better")
    sums = written(_fetched(blocks, written(better, "thresholds")), "sums")
    left = sums.join(_kth(sums, k, "bound"), "item_id", "left").where(F.col("most") >= F.coalesce("bound", F.lit(0))).select("item_id", "row")

    scored = exact(blocks, lists, left, most_bytes)
    named = scored.withColumn("segment", F.floor(F.col("row") / _PLACES)).join(index.ids, "segment").select("item_id", "row", "score", F.col("ids")[(F.col("row") % _PLACES).cast("int")].alias("doc_id"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id", "row"))
    return named.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = written(item_terms(spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "items")
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"), only=items.select("term"))
    return search(index, items)
