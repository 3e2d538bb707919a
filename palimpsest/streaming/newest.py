"""Newest-wins ingest of a stream of writes.

``stateful_latest`` keeps one row of state a key and gives each change as it comes.
``ingest_runs`` writes every micro-batch as one sorted run, as a full in-memory
table would be flushed; ``lsm.latest`` over the runs then answers reads.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that this processor needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class NewestWins(StatefulProcessor):
    """Holds (seq, value) of the newest write of a key, however late writes arrive."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("newest", "seq bigint, value double")

    def handleInputRows(self, key, rows, timer_values):
        best = self.state.get() if self.state.exists() else None
        changed = False
        for pdf in rows:
            top = pdf.loc[pdf["seq"].idxmax()]
            if best is None or int(top["seq"]) > best[0]:
                best, changed = (int(top["seq"]), None if pd.isna(top["value"]) else float(top["value"])), True
        if changed:
            self.state.update(best)
            yield pd.DataFrame({"key": [key[0]], "seq": [best[0]], "value": [best[1]]})

    def close(self) -> None:
        pass


def stateful_latest(writes: DataFrame) -> DataFrame:
    """A stream of (key, seq, value) changes from a stream of writes."""
    return writes.groupBy("key").transformWithStateInPandas(
        statefulProcessor=NewestWins(), outputStructType="key bigint, seq bigint, value double", outputMode="Update", timeMode="None"
    )


def ingest_runs(writes: DataFrame, path: str, checkpoint: str):
    """Start a query that appends each micro-batch as a run; a batch that is retried writes the same run again."""

    def flush(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
        newest.sortWithinPartitions("key").write.mode("overwrite").parquet(f"{path}/run={batch_id}")

    return writes.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
