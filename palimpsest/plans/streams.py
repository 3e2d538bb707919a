"""The streaming ingest as a query: it must end where the batch read does."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import lsm
from ..sources.scratch import scratch_root
from ..streaming import newest
from .registry import query


def scratch(spark) -> str:
    """A new folder that all executors reach."""
    return f"{scratch_root(spark)}/stream-{uuid.uuid4().hex}"


@query("SELECT user_id AS key, arg_max(value, event_id) AS value, max(event_id) AS seq FROM events GROUP BY user_id")
def stream_ingest_latest(spark, d):
    """The events as a stream, flushed run by run and read back newest-wins.

    A batch takes a bounded number of files, so writers ahead of the ingest wait in
    the folder; the query ends when all that was there is written.
    """
    at = scratch(spark)
    shape = spark.read.parquet(f"{d}/events.parquet").schema
    writes = spark.readStream.schema(shape).option("maxFilesPerTrigger", 8).parquet(f"{d}/events*.parquet")
    rows = writes.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "value")
    newest.ingest_runs(rows, f"{at}/runs", f"{at}/checkpoint").awaitTermination()
    return lsm.latest(spark.read.parquet(f"{at}/runs").select("key", "seq", "value"))
