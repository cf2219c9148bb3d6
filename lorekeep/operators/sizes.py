"""Broadcasts behind a check of how many bytes they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField


def _width(field: StructField) -> Column:
    """About how many bytes a row's value takes; a null takes as little as it can."""
    value, kind = F.col(field.name), field.dataType
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        inner = F.aggregate(value, F.lit(0), lambda s, x: s + F.coalesce(F.octet_length(x), F.lit(0)) + 16) if isinstance(kind.elementType, StringType) else F.size(value) * 8
        return F.greatest(F.coalesce(inner, F.lit(0)), F.lit(0)) + 16
    return F.lit(16)


def bytes_held(rows: DataFrame) -> int:
    """About how many bytes the rows take in memory."""
    width = sum((_width(x) for x in rows.schema.fields[1:]), _width(rows.schema.fields[0]))
    return rows.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("n")).first().n


def small(rows: DataFrame, most_bytes: int) -> DataFrame:
    """The rows as a broadcast if they hold at most ``most_bytes``; else as they are, to be joined by a shuffle."""
    return F.broadcast(rows) if bytes_held(rows) <= most_bytes else rows


#: Pairs of a row and one of the few (a record and a question) that a task is dealt, or about so.
TASK_PAIRS = 1 << 20


def tasks_for(rows: DataFrame, few: DataFrame) -> int:
    """To how many tasks ``rows`` are dealt, so that what a task holds of their pairs with ``few`` does not grow with either."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-rows.count() * few.count() // TASK_PAIRS))


def paired(rows: DataFrame, few: DataFrame, condition: Column, most_bytes: int, key: str = "id") -> DataFrame:
    """The pairs of ``rows`` and ``few`` that meet a condition: ``few`` as a broadcast if they are small; else ``rows`` are dealt in slots by
    their key and ``few`` are copied to each slot, so that no task has all of either and what is shuffled is ``few`` times the slots."""
    if bytes_held(few) <= most_bytes:
        return rows.join(F.broadcast(few), condition)
    slots = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_slot", F.pmod(F.xxhash64(key), F.lit(slots)))
    copied = few.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    return dealt.join(copied, (F.col("_slot") == F.col("_copy")) & condition).drop("_slot", "_copy")
