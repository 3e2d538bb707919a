"""Streams end where batches do."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import lsm
from palimpsest.streaming import newest


def test_stateful_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").limit(400)
    rows = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "value")
    # late and early writes mixed over three files
    for k in range(3):
        rows.filter(F.pmod(F.hash("seq"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {}

    def keep(batch, _):
        for r in batch.collect():
            got[r["key"]] = (r["value"], r["seq"])

    q = newest.stateful_latest(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert got == {r["key"]: (r["value"], r["seq"]) for r in lsm.latest(rows).collect()}
