"""Near-duplicate grouping by vectors: greedy, in order of writing, anchors only.

A record joins the first anchor that is similar enough, else it is an anchor
itself. On the graph of similar pairs these anchors are the first maximal
independent set in order, which is found in rounds over all pools at once: what
has no undecided neighbour before it is an anchor, what has an anchor before it
is a member; a member joins the first of the anchors before it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import vectors
from ..sources.shared import importable, written
from .sizes import bytes_held, small

#: Pivots of a cell, chosen from a sample of so many of its records; pairs of a cell that is cut no further, and pairs of a task. A
#: matrix product compares a pair in nanoseconds, so that cutting a smaller cell would cost more than its pairs.
PIVOTS, SAMPLE, CELL_PAIRS, TASK_PAIRS = 64, 1024, 1 << 32, 1 << 24
#: A cut is kept if it leaves at most this share of a cell's pairs, or if the cell has this many records at home for each pivot, beside whose pairs the copies are few.
LEAST_GAIN, LARGE = 0.7, 1 << 14
#: More than what rounding may change an angle by.
_SLACK = 1e-5
#: Entries of a matrix product, and pairs whose cosines are computed at once.
_PRODUCT, _CHECKED = 1 << 22, 1 << 17


def _angles(marks: str) -> Column:
    """The angle to each pivot of the row's cell, with the pivot's number."""
    angle = lambda m: F.acos(F.least(F.greatest(vectors.cosine(F.col("embedding"), m["v"], F.col("norm"), m["n"]), F.lit(-1.0)), F.lit(1.0)))
    return F.transform(marks, lambda m, i: F.struct(angle(m).alias("angle"), i.alias("pivot")))


def _spread(pivots: int):
    """Of a cell's sample the pivots that are far apart: each is the record farthest from those before it."""

    def rows(key: tuple, sample: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, alike in sample.sort_values("id").groupby(sample["v"].map(len)):  # vectors of one length are compared
            held = np.array(alike["v"].tolist(), dtype=float).reshape(len(alike), -1)
            length = np.linalg.norm(held, axis=1, keepdims=True)
            unit = np.divide(held, length, out=np.zeros_like(held), where=length > 0)
            nearest, at = np.full(len(held), -2.0), 0
            for _ in range(min(pivots, len(held))):
                out.append((key[0], list(held[at]), float(length[at, 0])))
                nearest = np.maximum(nearest, unit @ unit[at])
                at = int(nearest.argmin())
                if nearest[at] > 1 - 1e-12:
                    break
        return pd.DataFrame(out, columns=["cell", "v", "n"])

    return rows


def _cut(rows: DataFrame, threshold: float, pivots: int, most_bytes: int, turn: int) -> DataFrame:
    """The rows in the cells that theirs are cut into, not yet written; ``parent`` is the cell that they were in."""
    place = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("id", F.lit(turn)), "id"))
    vector = F.col("embedding").cast("array<double>").alias("v")
    sample = rows.where("home").withColumn("_n", place).where(F.col("_n") <= SAMPLE).select("cell", F.col("id").cast("string").alias("id"), vector)
    some = written(sample.groupBy("cell").applyInPandas(_spread(pivots), "cell long, v array<double>, n double"), "pivots")
    marks = some.groupBy("cell").agg(F.collect_list(F.struct("v", "n")).alias("marks"))
    marks = F.broadcast(marks) if bytes_held(some) <= most_bytes else marks
    near = math.acos(min(max(threshold - 1e-9, -1.0), 1.0)) + _SLACK
    seen = written(rows.join(marks, "cell").withColumn("angles", _angles("marks")).drop("marks"), "angles")
    home = F.array_min("angles")
    # what is similar to a record of a home is no farther from its pivot than the farthest one, but for the threshold's angle
    radius = seen.where("home").groupBy("cell", home["pivot"].alias("visited")).agg(F.max(home["angle"]).alias("radius"))
    each = seen.withColumn("nearest", home["pivot"]).withColumn("_at", F.explode(F.filter("angles", lambda x: x["angle"] <= home["angle"] + 2 * near))).drop("angles")
    each = each.withColumns({"visited": F.col("_at.pivot"), "angle": F.col("_at.angle")}).drop("_at")
    met = each.join(small(written(radius, "radius"), most_bytes), ["cell", "visited"]).where(F.col("angle") <= F.col("radius") + near)
    return met.withColumns({"parent": F.col("cell"), "home": F.col("home") & (F.col("visited") == F.col("nearest")), "cell": F.xxhash64("cell", "visited")}).drop("nearest", "visited", "angle", "radius")


def _pairs_in(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg((F.count_if("home") * F.count("*")).alias("pairs"), F.count_if("home").alias("homes"))


def cells(records: DataFrame, pool: list[str], threshold: float, pivots: int = PIVOTS, most_bytes: int = 32 << 20, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """(pool..., id, created_at, embedding, norm, cell, home, pairs): cells of records such that of each similar pair one is at home in a cell where the other is too.

    A pool is a cell. A cell with more than ``cell_pairs`` pairs is cut by pivots of its own: a record is at home with the pivot it is nearest
    to (if it was at home before), and visits every pivot that is at most twice the threshold's angle further away, and not farther than the records at
    home there by more than that angle. Angles obey the triangle inequality, so what is similar to a record visits its home. Where a cut would
    leave most of the pairs, because the vectors have no clusters there, the cell stays whole and its pairs are dealt to tasks.
    Each round is a written table; a cell has ever fewer records, so rounds grow with the logarithm of a pool.
    """
    importable(records.sparkSession)
    norm = vectors.norm(F.col("embedding"))
    held = records.where("embedding IS NOT NULL").select(*pool, "id", "created_at", "embedding", norm.alias("norm")).where(F.col("norm") < F.lit(math.inf))
    open_ = written(held.withColumns({"cell": F.xxhash64(*pool), "home": F.lit(True)}), "vectors")
    ready, turn = [], 0
    while True:
        sizes = written(_pairs_in(open_, "cell").where("pairs > 0"), "sizes")
        ready.append(open_.join(sizes.where(F.col("pairs") <= cell_pairs), "cell"))
        large = sizes.where(F.col("pairs") > cell_pairs)
        if not large.limit(1).count():
            break
        rows = open_.join(large, "cell")
        cut = _cut(rows, threshold, pivots, most_bytes, turn)  # counted first: only what gains is copied
        left = _pairs_in(cut, "parent", "cell").groupBy("parent").agg(F.sum("pairs").alias("left"))
        gains = (F.col("left") <= LEAST_GAIN * F.col("pairs")) | (F.col("homes") >= LARGE * pivots)
        judged = written(large.join(left, large.cell == left.parent).select("parent", gains.alias("gains")), "judged")
        ready.append(rows.join(judged.where("NOT gains").select(F.col("parent").alias("cell")), "cell", "left_semi"))
        open_, turn = written(cut.join(F.broadcast(judged.where("gains").select("parent")), "parent", "left_semi").drop("parent", "pairs", "homes"), "cells"), turn + 1
    columns = [*pool, "id", "created_at", "embedding", "norm", "cell", "home", "pairs"]
    return reduce(DataFrame.unionByName, [x.select(*columns) for x in ready])


def _order(table: pa.Table) -> np.ndarray:
    """The place of each row in order of writing; equal rows have equal places."""
    by = table.select(["created_at", "id"])
    order = pc.sort_indices(by, sort_keys=[("created_at", "ascending"), ("id", "ascending")], null_placement="at_start")
    sorted_ = by.take(order)
    new = np.zeros(len(by), dtype=bool)
    for name in by.column_names:
        here, before = sorted_[name].slice(1), sorted_[name].slice(0, max(len(by) - 1, 0))
        alike = pc.or_(pc.fill_null(pc.equal(here, before), False), pc.and_(pc.is_null(here), pc.is_null(before)))
        new[1:] |= ~alike.to_numpy(zero_copy_only=False)
    place = np.empty(len(by), dtype=np.int64)
    place[order.to_numpy()] = np.cumsum(new)
    return place


def _close(held: np.ndarray, norm: np.ndarray, one: np.ndarray, two: np.ndarray, place: np.ndarray, threshold: float):
    """(a, b, cosine) of rows ``one`` with later rows ``two`` where the cosine may reach the threshold.

    A product in single precision, with more room than its rounding needs, says which pairs to look at; their cosines are added up in double
    precision, in order of the dimensions.
    """
    dimension = held.shape[1]
    unit = np.divide(held, norm[:, None], out=np.zeros_like(held), where=norm[:, None] > 0).astype(np.float32)
    least = np.float32(threshold - 1e-6 - 2.5e-7 * (dimension + 8))
    right = np.ascontiguousarray(unit[two].T)
    step = max(1, _PRODUCT // max(1, len(two)))
    for at in range(0, len(one), step):
        found = np.flatnonzero(unit[one[at : at + step]] @ right >= least)
        for start in range(0, len(found), _CHECKED):
            row, column = np.divmod(found[start : start + _CHECKED], len(two))
            a, b = one[at + row], two[column]
            later = place[a] < place[b]
            a, b = a[later], b[later]
            total, both = np.zeros(len(a)), norm[a] * norm[b]
            for d in range(dimension):
                total += held[a, d] * held[b, d]
            yield a, b, np.divide(total, both, out=np.full(len(a), -1.0), where=both > 0)


def _compared(pool: list[str], threshold: float, names: list[str]):
    """Of the rows of two parts of a cell, or of one, the pairs of a record at home and a later one."""

    def rows(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        place, norms = _order(table), table["norm"].to_numpy()
        home, part = table["home"].to_numpy(), table["part"].to_numpy()
        size = pc.list_value_length(table["embedding"]).to_numpy()
        one, two = key[-2].as_py(), key[-1].as_py()
        for n in np.unique(size):  # vectors of one length are compared
            alike = np.flatnonzero(size == n)
            held = pc.list_flatten(table["embedding"].take(pa.array(alike))).to_numpy().astype(np.float64).reshape(len(alike), n)
            for x, y in {(one, two), (two, one)}:
                mine, theirs = np.flatnonzero((part[alike] == x) & home[alike]), np.flatnonzero(part[alike] == y)
                for a, b, cosine in _close(held, norms[alike], mine, theirs, place[alike], threshold):
                    first, later = table.take(pa.array(alike[a])), table.take(pa.array(alike[b]))
                    columns = [*(first[c] for c in pool), first["id"], later["id"], first["created_at"], later["created_at"], pa.array(cosine)]
                    yield from pa.Table.from_arrays(columns, names=names).to_batches()

    return rows


def near_pairs(records: DataFrame, pool: list[str], threshold: float, pivots: int = PIVOTS, most_bytes: int = 32 << 20, cell_pairs: int = CELL_PAIRS, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """(pool..., a, b, at_a, at_b, cosine): similar pairs of a pool, a before b in order of writing. Vectors that are not finite have none.

    Pairs are compared in the cells of ``cells`` only, each once, at the home of the earlier one. A cell's records are dealt in parts, and every two
    parts meet in a task of about ``task_pairs``: a record is copied as often as its cell has parts, the root of the tasks.
    """
    rows = written(cells(records, pool, threshold, pivots, most_bytes, cell_pairs), "cells")
    counts = written(rows.groupBy("cell").agg(F.count("*").alias("n")), "counts")
    dealt = rows.join(small(counts, most_bytes), "cell").withColumn("parts", F.ceil(F.col("n") / max(1, math.isqrt(task_pairs))))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    copied = dealt.select(*pool, "cell", "id", "created_at", "embedding", "norm", "home", "part", other.alias("_other"))
    copied = copied.withColumns({"_one": F.least("part", "_other"), "_two": F.greatest("part", "_other")}).drop("_other")
    kinds = {f.name: f for f in copied.schema.fields}
    named = [(c, c) for c in pool] + [("a", "id"), ("b", "id"), ("_at_a", "created_at"), ("_at_b", "created_at")]
    out = StructType([*(StructField(name, kinds[kind].dataType) for name, kind in named), StructField("cosine", DoubleType())])
    found = copied.groupBy(*pool, "cell", "_one", "_two").applyInArrow(_compared(pool, threshold, out.names), out)
    at = lambda created, id_: F.struct(F.col(created).alias("created_at"), F.col(id_).alias("id"))
    return found.select(*pool, "a", "b", at("_at_a", "a").alias("at_a"), at("_at_b", "b").alias("at_b"), F.round("cosine", 9).alias("cosine")).where(F.col("cosine") >= threshold)


def groups(pairs: DataFrame) -> DataFrame:
    """(anchor, id): groups of two or more, the anchor being one of its group. A round takes what it has decided out of the pairs, so that rounds get ever smaller."""
    edges = written(pairs.select("a", "b", "at_a"), "pairs")
    left, taken = edges.select("a", "b"), []
    while left.limit(1).count():
        # without an undecided neighbour before them they are anchors, and what is near them after them are members
        anchors = written(left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti"), "anchors")
        members = written(left.join(anchors, "a", "left_semi").select("b").distinct(), "members")
        open_ = left.join(anchors, "a", "left_anti").join(members, "b", "left_anti").join(members.select(F.col("b").alias("a")), "a", "left_anti")
        left = written(open_.select("a", "b"), "left")
        taken.append(members)
    if not taken:
        return edges.select(F.col("a").alias("anchor"), F.col("b").alias("id"))
    # what is no member is an anchor
    anchored = edges.join(reduce(DataFrame.union, taken).select(F.col("b").alias("a")), "a", "left_anti")
    joined = anchored.groupBy(F.col("b").alias("id")).agg(F.min_by("a", "at_a").alias("anchor")).select("anchor", "id")
    return joined.unionByName(joined.select("anchor", F.col("anchor").alias("id")).distinct())
