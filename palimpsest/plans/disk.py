"""A device from its creation to the reads after a crash, as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.disk import Device
from ..sources.scratch import scratch_root
from ..sources.tables import table
from .registry import query

#: Events are the writes: the first third is synced, the second too, the last is lost.
THIRDS = "w AS (SELECT user_id AS lba, event_id AS seq, value, event_id * 3 // (SELECT max(event_id) + 1 FROM events) AS part FROM events)"


def _crashed(spark, d):
    events = table(spark, d, "events").select(F.col("user_id").alias("lba"), F.col("event_id").alias("seq"), "value")
    facts = events.agg(F.max("seq").alias("seq"), F.max("lba").alias("lba")).first()
    total = (facts["lba"] + 1) * 16 // 15 + 1
    device = Device.create(spark, f"{scratch_root(spark)}/device-{uuid.uuid4().hex}", total, "seed")
    part = F.call_function("div", F.col("seq") * 3, F.lit(facts["seq"] + 1).cast("long"))
    for k in range(3):
        newest = events.filter(part == k).groupBy("lba").agg(F.max_by("value", "seq").alias("value"))
        device.write(newest.select("lba", F.col("value").cast("string").alias("payload")))
        if k < 2:
            device.sync()
    return Device.open(spark, device.folder, "seed"), events


@query(
    f"""WITH {THIRDS}, kept AS (SELECT lba, arg_max(value, seq) AS value FROM w WHERE part < 2 GROUP BY lba)
SELECT lba, value, true AS intact FROM (SELECT DISTINCT lba FROM w) LEFT JOIN kept USING (lba)"""
)
def disk_write_sync_crash_open(spark, d):
    """Reads after a crash see the synced writes and none of the others."""
    device, events = _crashed(spark, d)
    return device.read(events).select("lba", F.col("payload").cast("double").alias("value"), "intact")


@query(
    f"""WITH {THIRDS}, kept AS (SELECT lba, arg_max(value, seq) AS value FROM w WHERE part < 2 GROUP BY lba)
SELECT lba, CASE WHEN lba % 4 = 1 THEN -1.0 ELSE value END AS value FROM (SELECT DISTINCT lba FROM w) LEFT JOIN kept USING (lba)"""
)
def disk_write_after_open(spark, d):
    """A write after opening takes the place of the lost batch."""
    device, events = _crashed(spark, d)
    device.write(events.filter("lba % 4 = 1").select("lba", F.lit("-1.0").alias("payload")).distinct())
    device.sync()
    return Device.open(spark, device.folder, "seed").read(events).select("lba", F.col("payload").cast("double").alias("value"))
