"""Counters that expire: a stream in batches against the batch form; late hits, users that come again."""

import pytest
from pyspark.sql import functions as F

from lorekeep.streaming.counters import counters, expired

BASE = 1_700_000_000
#: (batch, user, second): users that come again, two counters of one user in a batch, hits out of order, one too late.
HITS = [
    (0, 1, 0), (0, 1, 50), (0, 2, 10), (0, 3, 5), (0, 3, 200),
    (1, 1, 120), (1, 2, 300), (1, 4, 310), (1, 4, 295), (1, 5, 280),
    (2, 1, 500), (2, 2, 5), (2, 4, 330),
    (3, 6, 1000),
    (4, 6, 1001),
]


def frame(spark, hits):
    return spark.createDataFrame(hits, "batch int, user_id long, second long").select("user_id", F.timestamp_seconds(F.lit(BASE) + F.col("second")).alias("ts"))


def rows(found):
    return sorted((r.user_id, r.hits, r.since.timestamp() - BASE, r.until.timestamp() - BASE) for r in found)


def test_stream_equals_batch(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for i in range(5):
            frame(spark, [h for h in HITS if h[0] == i]).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        seen = []
        made = counters(stream, 100, 60)
        query = made.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c").foreachBatch(lambda df, _: seen.extend(df.collect())).trigger(availableNow=True).start()
        query.awaitTermination(300)
    finally:
        spark.conf.set(name, before)
    kept = [h for h in HITS if h != (2, 2, 5)]  # that hit came too late
    assert rows(r for r in seen if r.expired) == rows(expired(frame(spark, kept), 100, "2023-11-14 22:29:20").collect())  # second 960: the watermark is at 941
    open_ = {r.user_id: r.hits for r in seen if not r.expired}
    assert open_[6] == 2


def test_limits(spark):
    with pytest.raises(ValueError, match="idle"):
        counters(frame(spark, HITS), 60, 60)
    assert rows(expired(frame(spark, HITS), 100, "2030-01-01 00:00:00").collect())[1] == (1, 3, 0.0, 120.0)
