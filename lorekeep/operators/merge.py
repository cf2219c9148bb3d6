"""Three-way merge of table versions, and verification between versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def three_way(base: DataFrame, ours: DataFrame, latest: DataFrame, key: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(key, action) of merging our changes since ``base`` into ``latest``: keep, insert, update, delete, none or conflict.

    An insert of a row that is there already, but for the ``ignored`` columns,
    is a repeated try and does nothing. Rows are compared null-safely.
    """
    columns = [c for c in base.columns if c != key]
    # a flag beside the row: a row of nulls is not a missing row
    side = lambda df, name: df.select(key, F.struct(F.lit(1).alias("_there"), *columns).alias(name), F.struct(F.lit(1).alias("_there"), *(c for c in columns if c not in ignored)).alias(f"{name}_core"))
    every = side(base, "b").join(side(ours, "o"), key, "full").join(side(latest, "l"), key, "full")
    b, o, now = F.col("b"), F.col("o"), F.col("l")
    change = F.when(b.isNull(), "insert").when(o.isNull(), "delete").otherwise("update")
    action = (
        F.when(b.eqNullSafe(o), "keep")
        .when(b.eqNullSafe(now), change)
        .when(o.isNull() & now.isNull(), "none")
        .when(b.isNull() & o.isNotNull() & F.col("o_core").eqNullSafe(F.col("l_core")), "none")
        .otherwise("conflict")
    )
    return every.select(key, action.alias("action"))


def merged(base: DataFrame, ours: DataFrame, latest: DataFrame, key: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """The table after the merge; conflicts raise."""
    actions = three_way(base, ours, latest, key, ignored)
    clashes = actions.where("action = 'conflict'").select(key).limit(5).collect()
    if clashes:
        raise ValueError(f"concurrent changes of {[r[0] for r in clashes]}")
    ours_rows = ours.join(actions.where("action IN ('insert', 'update')").select(key), key, "left_semi")
    gone = actions.where("action IN ('insert', 'update', 'delete')").select(key)
    return latest.join(gone, key, "left_anti").unionByName(ours_rows)


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with the side; empty if they are equal as bags."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def coverage(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys that are missing or extra."""
    both = expected.select(key, F.lit(1).alias("e")).join(actual.select(key, F.lit(1).alias("a")), key, "full")
    return both.where("e IS NULL OR a IS NULL").select(key, F.when(F.col("a").isNull(), "missing").otherwise("extra").alias("state"))
