"""Index shards of a submission: files with their digests, and the test indices that they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def digests(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(name, bytes, sha256) of each file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def indices(spark: SparkSession, folder: str, column: str = "test_idx") -> DataFrame:
    """The indices of all shards (Arrow IPC files); negative or repeated ones raise when they are checked."""

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0):
                with pa.ipc.open_file(pa.py_buffer(content.as_py())) as f:
                    for i in range(f.num_record_batches):
                        part = f.get_batch(i)
                        yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(column)).cast(pa.int64())], names=["index"])

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(rows, "index long")


def problems(found: DataFrame) -> DataFrame:
    """Indices that are negative or occur more than once."""
    reason: Column = F.when(F.col("index") < 0, "negative").when(F.col("n") > 1, "repeated")
    return found.groupBy("index").agg(F.count("*").alias("n")).withColumn("reason", reason).where("reason IS NOT NULL").select("index", "reason")
