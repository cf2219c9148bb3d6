"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else the folder given to ``setCheckpointDir``.

    Where neither is set, a session on one machine gets a folder of its own; any other is refused, since its
    executors could not read what the driver's machine holds.
    """
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and known.isDefined():
        return known.get()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lorekeep-")
    if known.isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def importable(spark: SparkSession) -> None:
    """Python workers begun from now on find this library, wherever the driver was started."""
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, environment.get("PYTHONPATH")]))


#: Rows and bytes that go to a Python worker at once.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches small enough for a worker's memory, unless the session has asked for smaller ones; and workers that find this library."""
    importable(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    size = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")
    if not size.isdigit() or int(size) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def new_path(spark: SparkSession, name: str) -> str:
    """The URI of a folder in the shared one that nobody uses yet; what is put there goes when the process ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/lorekeep-{name}-{uuid.uuid4().hex}")
    path = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    path = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: its lineage ends there and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear() -> None:
    """Remove the tables of this process; a result that has not been read yet needs them."""
    while _made:
        spark, path = _made.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session has ended before
            return


atexit.register(clear)
