"""Near-duplicate groups by min-max hashing (operator 9).

Texts are sets of word shingles. Each permutation of the shingles gives two
values, its minimum and its maximum; both agree between two sets with
probability equal to their similarity, so half the hash evaluations make as
many values. Two permutations (four values) make a band; sets that agree in a
band are candidates. With 32 bands a pair at similarity 0.8 is missed with
probability (1 - 0.8 ** 4) ** 32, under 5e-8. Every link is confirmed on the
full sets of 64-bit shingle hashes.

Equal sets are first collapsed to one representative (a 128-bit digest of the
set, and its size), so a group of copies costs one row however large it is.
Pairs inside a bucket are not enumerated. All members are compared with the
smallest one; what shares a bucket, directly or through others, is a family, and
families whose members are all linked are done. In the others the consensus is
taken, the shingles that more than half of the members have, and every member is
compared with the one nearest to it. What is then still apart is compared only
where a link is possible: two members have at most as many shingles in common as
the consensus shingles of the one that has fewer of them, and the shingles outside
the consensus that both have. So a pair either shares a shingle outside the
consensus, and meets in that shingle's bucket, or both sizes and counts must allow a
link without one. How many shingles outside the consensus a link needs at least is known
for each member, so it may leave out that many, less one, of its most frequent ones.
Buckets of the others are gone through in rounds, with twice as many of their members each time,
until no bucket has members of different components that have not been compared. So every candidate pair of different components has been
compared or cannot be linked.

Null texts and texts without words have no shingles and are linked with
nothing; texts of fewer words than a shingle are one shingle, their whole
sequence. Rows with the same id are one document, in whose class all their texts
are; each of them has its row. Rows without an id are left out, other columns ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .inputs import id_and_text
from .scratch import bounded_batches, written
from .textbytes import Words, byte_class, mix, slices, words

_U = np.uint64

#: Words are runs of anything but ASCII white space.
WORD_BYTES = ~byte_class((0x09, 0x0D), (0x20, 0x20))

BANDS, PERMUTATIONS_PER_BAND = 32, 2
#: Pairs of the first round.
ROUND_PAIRS = 200_000
#: Size of the filter of ids whose sets are needed.
FILTER_BITS = 1 << 23

_draw = np.random.default_rng(977)
_FACTORS = _draw.integers(0, 1 << 63, BANDS * PERMUTATIONS_PER_BAND, dtype=np.uint64) * _U(2) + _U(1)
_SHIFTS = _draw.integers(0, 1 << 63, BANDS * PERMUTATIONS_PER_BAND, dtype=np.uint64)


def shingles(found: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): hashes of all shingles, and where each row's begin."""
    h = found.hashes()
    count = np.diff(found.first)
    made = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(made)])
    row = np.repeat(np.arange(len(count)), made)
    at = found.first[row] + np.arange(len(row)) - first[row]
    size = np.minimum(count[row], width)
    out = size.astype(_U) * _U(0x9E3779B97F4A7C15)
    padded = np.append(h, np.zeros(width, _U))
    for j in range(width):
        out = np.where(j < size, mix(out ^ (padded[at + j] + _U(j))), out)
    return out, first


def _distinct(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row."""
    parts = [np.unique(hashes[first[i] : first[i + 1]]) for i in range(len(first) - 1)]
    return (np.concatenate(parts) if parts else hashes), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def min_max_signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(rows, permutations, 2) minima and maxima; rows must not be empty."""
    out = np.empty((len(first) - 1, len(_FACTORS), 2), dtype=np.uint64)
    for p in range(len(_FACTORS)):
        turned = hashes * _FACTORS[p] + _SHIFTS[p]
        turned ^= turned >> _U(29)
        out[:, p, 0] = np.minimum.reduceat(turned, first[:-1])
        out[:, p, 1] = np.maximum.reduceat(turned, first[:-1])
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(rows, bands) one key for the values of each band."""
    values = signatures.reshape(len(signatures), BANDS, PERMUTATIONS_PER_BAND * 2)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), values.shape[:2]) * _U(0x9E3779B97F4A7C15)
    for j in range(values.shape[2]):
        out = mix(out ^ values[:, :, j])
    return out


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))


def _signature_rows(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                values, first = _distinct(*shingles(words(data, offsets, WORD_BYTES), width))
                size = np.diff(first)
                some = np.flatnonzero(size)
                keys = np.zeros((len(size), BANDS), dtype=np.uint64)
                one, two = np.zeros((2, len(size)), dtype=np.uint64)
                if len(some):
                    edges = np.append(first[some], first[-1])
                    keys[some] = band_keys(min_max_signatures(values, edges))
                    one[some] = np.add.reduceat(mix(values + _U(7)), edges[:-1])
                    two[some] = np.add.reduceat(mix(values ^ _U(0xA5A5A5A5A5A5A5A5)), edges[:-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), _lists(keys.ravel(), np.arange(len(size) + 1) * BANDS)],
                    names=["doc_id", "n_shingles", "digest_1", "digest_2", "bands"],
                )

    return rows


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size that holds every id of ``ids`` (and, by chance, others): what it sends and broadcasts is bounded by its size."""
    slot = F.pmod(F.col("doc_id"), F.lit(FILTER_BITS))
    words = ids.select(F.floor(slot / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, CAST(pmod(doc_id, {FILTER_BITS}) % 64 AS int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def _set_rows(width: int, packed: bytes):
    """The full sets of the rows that the filter lets through."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool)
        for batch in batches:
            batch = batch.filter(pa.array(held[batch.column(0).to_numpy() % len(held)]))
            if not batch.num_rows:
                continue
            for lo, hi, data, offsets in slices(batch.column(1)):
                values, first = _distinct(*shingles(words(data, offsets, WORD_BYTES), width))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), _lists(values, first)], names=["doc_id", "members"])

    return rows


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("of_a"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("of_b"))
    both = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("of_a", "of_b")))
    return both.where(100 * F.col("common") >= percent * (F.size("of_a") + F.size("of_b") - F.col("common"))).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, round_pairs: int = ROUND_PAIRS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id that links reach), kept.

    Links join sets with 100 * intersection >= ``percent`` * union of their
    shingles of ``width`` words.
    """
    bounded_batches(docs.sparkSession)
    texts = id_and_text(docs, id_col, text_col)
    signed = written(texts.mapInArrow(_signature_rows(width), "doc_id long, n_shingles long, digest_1 long, digest_2 long, bands array<long>"), "signatures")
    same = ["n_shingles", "digest_1", "digest_2"]
    firsts = signed.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("copy_of"))
    named = signed.join(firsts, same, "left").select("doc_id", "n_shingles", F.coalesce("copy_of", "doc_id").alias("copy_of"), F.expr("CASE WHEN doc_id = copy_of THEN bands END").alias("bands"))
    named = written(named, "representatives")

    buckets = named.where("bands IS NOT NULL").select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("a")).repartition("bucket")
    heads = buckets.groupBy("bucket").agg(F.min("a").alias("b"), F.max("a").alias("last")).where("b <> last").drop("last")
    stars = written(buckets.join(heads, "bucket").where("a <> b").select("a", "b").distinct(), "stars")
    needed = stars.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    # a filter of fixed size keeps most other texts from being hashed again, the join drops the rest; texts are not shuffled
    packed = np.packbits(id_filter(needed)).tobytes()
    sets = written(texts.mapInArrow(_set_rows(width, packed), "doc_id long, members array<long>").join(needed, "doc_id", "left_semi"), "sets")
    # texts of rows with the same id are one document's
    several = named.groupBy("doc_id").agg(F.min("copy_of").alias("one"), F.max("copy_of").alias("other")).where("one <> other").select("doc_id")
    repeated = named.join(several, "doc_id").select(F.col("copy_of").alias("a"), F.col("doc_id").alias("b"))
    groups = components(_confirmed(stars, sets, percent).unionByName(repeated))
    families = components(stars).withColumnRenamed("component", "family")

    apart = _families_apart(families, groups)
    if apart.limit(1).count():
        members = written(_against_consensus(apart, sets), "families")
        nearest = members.groupBy("family").agg(F.max_by("a", F.struct(F.col("core") / (F.col("size") + F.col("consensus") - F.col("core")), -F.col("a"))).alias("b"))
        central = members.join(nearest, "family").where("a <> b").select("a", "b")
        groups = _contracted(groups, _confirmed(central, sets, percent))
        groups = _remaining(members, nearest, groups, sets, percent, round_pairs)

    grouped = groups.select(F.col("node").alias("copy_of"), "component")
    return named.join(grouped, "copy_of", "left").select("doc_id", "n_shingles", F.coalesce("component", "copy_of").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _contracted(groups: DataFrame, more: DataFrame) -> DataFrame:
    return components(groups.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))


def _families_apart(families: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, family) of the families that have more than one component."""
    named = families.join(groups, "node", "left").select("family", F.col("node").alias("a"), F.coalesce("component", "node").alias("component"))
    several = named.groupBy("family").agg(F.min("component").alias("one"), F.max("component").alias("other")).where("one <> other").select("family")
    return named.join(several, "family").select("a", "family")


def _against_consensus(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """(family, a, size, consensus, core, others): how many shingles a member, the consensus, and both have, and the member's other ones."""
    # the number of members goes along with them, so that a large family's shingles are counted by all tasks and only its consensus comes together
    sized = apart.join(apart.groupBy("family").agg(F.count("*").alias("n")), "family")
    rows = sized.join(sets, F.col("a") == F.col("doc_id")).select("family", "a", "n", "members")
    each = rows.select("family", "n", F.explode("members").alias("shingle")).groupBy("family", "shingle").agg(F.count("*").alias("have"), F.any_value("n").alias("n"))
    shared = each.where("have > 1 AND 2 * have > n").groupBy("family").agg(F.collect_list("shingle").alias("common"))
    both = rows.join(shared, "family", "left").withColumn("common", F.coalesce("common", F.array().cast("array<long>")))
    both = both.withColumn("others", F.array_except("members", "common"))
    size = F.size("members").cast("long")
    return both.select("family", "a", size.alias("size"), F.size("common").cast("long").alias("consensus"), (size - F.size("others")).alias("core"), "others")


def _remaining(members: DataFrame, nearest: DataFrame, groups: DataFrame, sets: DataFrame, percent: int, round_pairs: int) -> DataFrame:
    """The components after all pairs of families that are still apart and that may be linked."""
    named = members.join(groups, F.col("a") == F.col("node"), "left").withColumn("component", F.coalesce("component", "a")).drop("node")
    central = nearest.join(groups, F.col("b") == F.col("node"), "left").select("family", F.coalesce("component", "b").alias("main"))
    named = written(named.join(central, "family"), "named")

    # pairs without a common shingle outside the consensus: the far member bounds the other one's size
    slim = named.select("family", "a", "size", "core", "component", "main")
    most = F.floor(((100 + percent) * F.col("core") - percent * F.col("size")) / percent)
    far = slim.where("component <> main").select("family", F.col("a").alias("b"), F.col("size").alias("b_size"), F.col("core").alias("b_core"), F.col("component").alias("b_component"), most.alias("most"))
    sizes = slim.select("family", "size").distinct()
    fitting = far.join(sizes, "family").where("size <= most AND 100 * size >= %d * b_size" % percent)
    allowed = F.least("core", "b_core") * (100 + percent) >= percent * (F.col("size") + F.col("b_size"))
    pairs = fitting.join(slim, ["family", "size"]).where((F.col("component") != F.col("b_component")) & allowed).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = written(_confirmed(pairs, sets, percent), "confirmed")
    if more.limit(1).count():
        groups = _contracted(groups, more)

    # pairs with one: a link needs so many of them in common that each member may leave out its most frequent ones
    shingle = named.select("family", "a", "size", "core", F.explode("others").alias("shingle"))
    often = shingle.groupBy("family", "shingle").agg(F.count("*").alias("n")).where("n > 1")
    spare = F.ceil(percent * F.col("size") / 100) - F.col("core") - 1
    ordered = shingle.join(often, ["family", "shingle"]).withColumn("at", F.row_number().over(Window.partitionBy("family", "a").orderBy(F.desc("n"), F.desc("shingle"))))
    met = written(ordered.where(F.col("at") > spare).select("family", F.xxhash64("family", "shingle").alias("bucket"), "a"), "met")
    # of buckets with the same members one is enough
    sets_of = met.groupBy("family", "bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("a").cast("decimal(38,0)")).alias("who")).where("n > 1")
    chosen = sets_of.groupBy("family", "n", "who").agg(F.min("bucket").alias("bucket")).select("bucket")
    open_, pivoted, pivots = met.join(chosen, "bucket", "left_semi").select("bucket", "a"), 0, 0
    while True:
        here = open_.join(groups, F.col("a") == F.col("node"), "left").withColumn("component", F.coalesce("component", "a")).drop("node")
        # those that have been pivots are compared with all behind them
        left = here.where(F.col("rank") > pivoted) if pivoted else here
        several = left.groupBy("bucket").agg(F.min("component").alias("one"), F.max("component").alias("other")).where("one <> other").select("bucket")
        open_ = here.join(several, "bucket")
        if not pivoted:
            counts = open_.groupBy("bucket", "component").agg(F.count("*").alias("n"))
            order = Window.partitionBy("bucket").orderBy("n", "component", "a")
            open_ = open_.join(counts, ["bucket", "component"]).withColumn("rank", F.row_number().over(order)).drop("n")
        open_ = written(open_, "open")
        rows = open_.count()
        if not rows:
            return groups
        # twice as many in each round: the rounds grow with the logarithm of the largest bucket
        pivots = max(1, round_pairs // rows, 2 * pivots)
        chosen = open_.where((F.col("rank") > pivoted) & (F.col("rank") <= pivoted + pivots)).select("bucket", F.col("a").alias("pivot"), F.col("component").alias("its"), F.col("rank").alias("at"))
        pairs = open_.join(chosen, "bucket").where("component <> its AND rank > at").select(F.least("a", "pivot").alias("a"), F.greatest("a", "pivot").alias("b")).distinct()
        more = written(_confirmed(pairs, sets, percent), "confirmed")
        if more.limit(1).count():
            groups = _contracted(groups, more)
        open_, pivoted = open_.drop("component"), pivoted + pivots


def op9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)
