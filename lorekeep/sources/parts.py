"""Stored tables that grow by parts: a version has parts, and a part counts once its row in ``versions`` is written.

What a broken write leaves in its folder has no such row and is not read. Rows are read back by those folders only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_DONE = "version int, part int, rows long"


def finished(spark: SparkSession, path: str) -> list[tuple[int, int, int]]:
    """(version, part, rows) of what was finished below a path, in order."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return []
    return sorted((r.version, r.part, r.rows) for r in spark.read.schema(_DONE).parquet(f"{path}/versions").collect())


def finish(spark: SparkSession, path: str, version: int, part: int, rows: int) -> None:
    spark.createDataFrame([(version, part, rows)], _DONE).coalesce(1).write.mode("append").parquet(f"{path}/versions")


def newest(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """The last version and its parts."""
    done = finished(spark, path)
    if not done:
        raise ValueError(f"no index at {path}")
    return done[-1][0], [part for version, part, _ in done if version == done[-1][0]]


def place(path: str, table: str, version: int, part: int) -> str:
    return f"{path}/{table}/version={version}/part={part}"


def read(spark: SparkSession, path: str, table: str, version: int, parts: list[int], schema: StructType | str) -> DataFrame:
    """A table's rows of some parts of a version."""
    return spark.read.schema(schema).parquet(*(place(path, table, version, part) for part in parts))
