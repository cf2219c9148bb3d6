"""A stored proximity index: inverted lists around learned centres, quantised vectors, exact re-ranking.

Centres are learned by k-means on the sphere from a bounded sample, every vector is put in the list of its nearest centre,
as one signed byte a dimension. A question looks into the lists whose centres are nearest to it, as many as hold enough records of its
scope and time by the stored counts. The nearest by their bytes, ``overfetch`` times as many as are wanted, are ranked anew by the exact
cosine of the records' own vectors, so a result never shows an approximate score, a vector that has changed, or a record out of scope.
The last of them is a mark: by the triangle inequality a list is opened again only if its farthest record lets it reach the mark, and a record of it
is ranked too if its bytes, with all that their rounding may hide, do. So the result is that of the exact leg, as long as vectors are those indexed.

Stored below a path (``sources.parts``): ``centres`` of each version, ``lists`` (by list) and ``sizes`` of each of its parts. ``append``
adds a part with the version's centres, ``build`` a version.
In the index are finite vectors that are not zero, of the version's dimension; of repeated ids every row is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import vectors
from ..sources import parts
from ..sources.shared import importable, written
from .scope import as_of
from .sizes import small

#: Lists, vectors of the training sample for each of them, rounds of training, and slots that a list's rows are dealt in.
LISTS, SAMPLE_PER_LIST, ROUNDS, SLOTS = 64, 64, 8, 16
#: Lists that a question looks into at least, records it meets there for each that is wanted, and those re-ranked for each that is wanted.
PROBES, ENOUGH, OVERFETCH = 4, 4, 4

_SCOPE = ("user_id", "agent_type", "project_id", "customer_id", "is_active")


#: Columns of the lists of an index without a vector.
_EMPTY = "id string, user_id string, agent_type string, project_id string, customer_id string, is_active boolean, occurred_at timestamp, list int, slot int, close double, scale double, codes array<tinyint>"


@dataclass(frozen=True)
class Index:
    """A version: its centres (on the driver, ``lists`` x ``dimension``), rows of its lists, and their counts."""

    path: str
    version: int
    centres: np.ndarray
    lists: DataFrame
    sizes: DataFrame


def _usable(records: DataFrame) -> DataFrame:
    norm = vectors.norm(F.col("embedding"))
    return records.where(F.col("embedding").isNotNull() & (norm > 0) & (norm < float("inf")))


def trained(sample: np.ndarray, lists: int, rounds: int, seed: int) -> np.ndarray:
    """Unit centres of unit vectors; an empty list takes the vector that is farthest from its centre."""
    draw = np.random.default_rng(seed)
    centres = sample[draw.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(rounds):
        close = sample @ centres.T
        own, best = close.argmax(axis=1), close.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        sums[empty] = sample[np.argsort(best)[: len(empty)]]
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centres)
    return centres


def _listed(records: DataFrame, centres: np.ndarray) -> DataFrame:
    """Rows of the lists: the nearest centre, and the unit vector in bytes with their scale."""
    names = ["id", *_SCOPE, "occurred_at"]
    kinds = {f.name: f.dataType.simpleString() for f in records.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in names), "list int", "slot int", "close double", "scale double", "codes array<tinyint>"])
    dimension = centres.shape[1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(len(names))
            batch, held = batch.slice(0), np.asarray(held.flatten(), dtype=np.float64).reshape(-1, dimension)
            unit = held / np.linalg.norm(held, axis=1, keepdims=True) if len(held) else held
            most = np.abs(unit).max(axis=1) if len(held) else np.zeros(0)
            codes = np.rint(unit * (127 / most[:, None])).astype(np.int8) if len(held) else np.zeros((0, dimension), np.int8)
            close = unit @ centres.T
            own = close.argmax(axis=1).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1, dtype=np.int32) * dimension), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(own), batch.column(len(names) + 1), pa.array(close.max(axis=1)), pa.array(most / 127), listed], names=[*names, "list", "slot", "close", "scale", "codes"])

    slot = F.pmod(F.xxhash64("id"), F.lit(SLOTS)).cast("int").alias("slot")
    fitting = _usable(records).where(F.size("embedding") == dimension).select(*names, F.col("embedding").cast("array<double>"), slot)
    return fitting.mapInArrow(rows, schema)


def _month() -> Column:
    return F.date_trunc("month", "occurred_at")


def _write_part(records: DataFrame, path: str, version: int, part: int, centres: np.ndarray) -> None:
    importable(records.sparkSession)
    spark, at = records.sparkSession, parts.place(path, "lists", version, part)
    rows = _listed(records, centres)
    # Spark splits a crowded list among tasks
    rows.hint("rebalance", "list").sortWithinPartitions("list").write.mode("overwrite").partitionBy("list").parquet(at)
    held = spark.read.schema(rows.schema).parquet(at)
    counts = held.groupBy("list", *_SCOPE, _month().alias("month")).agg(F.count("*").alias("n"), F.min("close").alias("edge"))
    counts.write.mode("overwrite").parquet(parts.place(path, "sizes", version, part))
    parts.finish(spark, path, version, part, held.count())


def build(records: DataFrame, path: str, lists: int = LISTS, seed: int = 1, rounds: int = ROUNDS) -> Index:
    """A new version: centres from the ``lists`` x ``SAMPLE_PER_LIST`` vectors with the smallest hashes of their ids (what the driver gets), every vector in a list.

    The dimension is the most frequent one of the records; without a vector the index is empty.
    """
    spark = records.sparkSession
    usable = _usable(records)
    common = usable.groupBy(F.size("embedding").alias("dimension")).count().orderBy(F.desc("count"), F.desc("dimension")).first()
    dimension = common.dimension if common else 1
    sample = usable.where(F.size("embedding") == dimension).select(F.col("embedding").cast("array<double>").alias("v"), F.xxhash64(F.lit(seed), "id").alias("h")).orderBy("h").limit(lists * SAMPLE_PER_LIST).collect()
    held = np.array([r.v for r in sample]).reshape(-1, dimension)
    centres = trained(held / np.linalg.norm(held, axis=1, keepdims=True), lists, rounds, seed) if len(held) else np.eye(1)
    version = max((x[0] for x in parts.finished(spark, path)), default=0) + 1
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "list int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres/version={version}")
    _write_part(records, path, version, 0, centres)
    return load(spark, path)


def append(index: Index, records: DataFrame) -> Index:
    """The version with a part more; its centres stay as they are."""
    spark = records.sparkSession
    _write_part(records, index.path, index.version, max(parts.newest(spark, index.path)[1]) + 1, index.centres)
    return load(spark, index.path)


def load(spark: SparkSession, path: str) -> Index:
    """The newest version with all its finished parts."""
    version, some = parts.newest(spark, path)
    centres = np.array([r.centre for r in spark.read.parquet(f"{path}/centres/version={version}").orderBy("list").collect()])
    full = [part for v, part, rows in parts.finished(spark, path) if v == version and rows]
    counts = spark.read.parquet(*(parts.place(path, "sizes", version, part) for part in some))
    lists = spark.read.option("basePath", f"{path}/lists/version={version}").parquet(*(parts.place(path, "lists", version, part) for part in full)) if full else spark.createDataFrame([], _EMPTY)
    return Index(path, version, centres, lists, counts)


def probes(index: Index, questions: DataFrame, scope: Column, limit: int, least: int = PROBES, enough: int = ENOUGH) -> DataFrame:
    """(qid, as_of, vector, list): the lists that each question looks into, nearest centres first.

    At least ``least``, and on until those before hold ``enough`` x ``limit`` records of the scope that are surely old enough by their month.
    """
    spark = questions.sparkSession
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(index.centres)], "list int, centre array<double>")
    held = index.sizes.where(scope).groupBy("list", "month").agg(F.sum("n").alias("n"))
    asked = questions.where("vector IS NOT NULL").select("qid", "as_of", F.col("vector").cast("array<double>").alias("vector"), vectors.norm(F.col("vector")).alias("_asked")).where(F.size("vector") == index.centres.shape[1])
    close = vectors.cosine(F.col("vector"), F.col("centre"), F.col("_asked"), F.lit(1.0))
    pairs = asked.crossJoin(F.broadcast(centres)).select("qid", "as_of", "vector", "_asked", "list", close.alias("close"))  # as many rows as there are lists
    old = F.col("as_of").isNull() | (F.col("month") < F.date_trunc("month", "as_of"))
    there = pairs.join(F.broadcast(held), "list", "left").groupBy("qid", "list").agg(F.coalesce(F.sum(F.when(old, F.col("n"))), F.lit(0)).alias("n"), F.sum("n").alias("total"))  # rows: lists and months
    order = Window.partitionBy("qid").orderBy(F.desc("close"), "list")
    ranked = pairs.join(there, ["qid", "list"]).where("total > 0")
    ranked = ranked.withColumn("_n", F.row_number().over(order)).withColumn("_before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    return ranked.where((F.col("_n") <= least) | (F.col("_before") < enough * limit)).select("qid", "as_of", "vector", "_asked", "list")


def candidates(index: Index, wanted: DataFrame, scope: Column, limit: int, max_bytes: int) -> DataFrame:
    """(qid, id, near): of each question the ``limit`` nearest of its lists by their bytes; only rows of probed lists are joined."""
    asked = wanted.select("qid", "as_of", "list", F.transform("vector", lambda x: x / F.col("_asked")).alias("unit"), F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot"))
    met = index.lists.where(scope).join(small(asked, max_bytes), ["list", "slot"]).where(as_of())
    near = F.col("scale") * vectors.dot(F.col("codes"), F.col("unit"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("near"), "id"))
    return met.select("qid", "id", near.alias("near")).withColumn("_n", place).where(F.col("_n") <= limit).drop("_n")


def beyond(index: Index, questions: DataFrame, marks: DataFrame, scope: Column, max_bytes: int) -> DataFrame:
    """(qid, id): all records of the scope that may be as near to a question as its mark; without a mark all that are old enough."""
    spark = questions.sparkSession
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(index.centres)], "list int, centre array<double>")
    edges = index.sizes.where(scope).groupBy("list").agg(F.min("edge").alias("edge"))
    asked = questions.where("vector IS NOT NULL").select("qid", "as_of", F.col("vector").cast("array<double>").alias("vector")).where(F.size("vector") == index.centres.shape[1])
    asked = asked.select("qid", "as_of", F.transform("vector", lambda x: x / vectors.norm(F.col("vector"))).alias("unit")).join(marks.select("qid", "mark"), "qid", "left")
    angle = lambda x: F.acos(F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0)))
    nearest = F.greatest(angle(vectors.dot(F.col("unit"), F.col("centre"))) - angle(F.col("edge")), F.lit(0.0))
    low = F.coalesce("mark", F.lit(-2.0)) - 1e-6
    lists = asked.crossJoin(F.broadcast(centres.join(F.broadcast(edges), "list"))).where(F.cos(nearest) >= low)  # as many rows as there are lists
    spread = F.aggregate("unit", F.lit(0.0), lambda s, x: s + F.abs(x)) / 2  # a byte hides at most half of its scale in each dimension
    each = lists.select("qid", "as_of", "list", "unit", low.alias("low"), spread.alias("spread"), F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot"))
    met = index.lists.where(scope).join(small(each, max_bytes), ["list", "slot"]).where(as_of())
    return met.where(F.col("scale") * (vectors.dot(F.col("codes"), F.col("unit")) + F.col("spread")) >= F.col("low")).select("qid", "id")


def index_leg(index: Index, records: DataFrame, questions: DataFrame, scope: Column, config: Config, least: int = PROBES, enough: int = ENOUGH, overfetch: int = OVERFETCH, complete: bool = True) -> DataFrame:
    """(qid, id, rank, cosine) as ``recall.vector_leg`` gives them, of the indexed records; ``records`` are those of the scope, prepared.

    Without ``complete`` no list is opened again: what the first lists don't hold is missing.
    """
    wanted = probes(index, questions, scope, config.candidate_limit, least, enough)
    found = candidates(index, wanted, scope, overfetch * config.candidate_limit, config.max_broadcast_bytes).select("qid", "id").distinct()
    length = vectors.norm(F.col("vector"))
    asked = questions.where("vector IS NOT NULL").select("qid", "as_of", "vector", length.alias("_asked"))

    def first(found: DataFrame) -> DataFrame:
        rows = found.join(asked, "qid").join(records.where("embedding IS NOT NULL").select("id", "occurred_at", "embedding", "_norm"), "id")
        exact = F.round(vectors.cosine(F.col("embedding"), F.col("vector"), F.col("_norm"), F.col("_asked")), 9)
        scored = rows.where(as_of() & (F.size("embedding") == F.size("vector"))).select("qid", "id", exact.alias("cosine"))
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("cosine"), "id"))
        return scored.withColumn("_n", place).where(F.col("_n") <= config.candidate_limit)

    out = first(found)
    if complete:
        head = written(out, "head")
        marks = head.where(F.col("_n") == config.candidate_limit).select("qid", F.col("cosine").alias("mark"))
        more = beyond(index, questions, marks, scope, config.max_broadcast_bytes)
        out = first(head.select("qid", "id").unionByName(more).distinct())
    return out.select("qid", "id", (F.col("_n") - 1).alias("rank"), "cosine")
