"""A versioned block device in a folder: create, write, sync, lose power, open, read.

A write appends its sealed blocks as one batch of Parquet files.  ``sync`` makes all
batches so far durable by one marker, after the data and in this order: batches,
index, marker.  Opening reads the superblock, finds the last marker and forgets the
batches behind it, as after a crash.  Reads take the newest write of each block.

``before`` and ``after`` are called with (event, batch or sync id) around each step;
one that raises before a step keeps it from happening.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.blocks import OutOfRange
from . import integrity

MAGIC = "palimpsest-1"
#: Sixteenths of the device that hold data; the others hold the journal.
DATA_SHARE = 15


class NotADevice(ValueError):
    """The folder holds no superblock of ours."""


class Device:
    def __init__(self, spark: SparkSession, folder: str, total: int, seed: str, synced: int, before: Callable | None = None, after: Callable | None = None):
        self.spark, self.folder, self.total, self.seed = spark, folder, total, seed
        self.next, self.synced = synced, synced
        self.before, self.after = before or (lambda *_: None), after or (lambda *_: None)

    # ------------------------------------------------------------- life of a device
    @classmethod
    def create(cls, spark: SparkSession, folder: str, total: int, seed: str, **hooks) -> Device:
        """An empty device of ``total`` blocks; a folder that holds one is an error."""
        spark.createDataFrame([(MAGIC, total)], "magic string, total bigint").write.mode("error").parquet(f"{folder}/superblock")
        return cls(spark, folder, total, seed, 0, **hooks)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, seed: str, **hooks) -> Device:
        """What the last sync left; later batches are forgotten and their numbers used again."""
        block = spark.read.parquet(f"{folder}/superblock").first()
        if block is None or block["magic"] != MAGIC:
            raise NotADevice(folder)
        return cls(spark, folder, block["total"], seed, max(cls._numbers(spark, folder, "sync"), default=0), **hooks)

    @staticmethod
    def _numbers(spark: SparkSession, folder: str, kind: str) -> list[int]:
        """Numbers n of the finished tables ``kind=n`` in the folder."""
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath() for s in store.listStatus(path) if s.getPath().getName().startswith(f"{kind}=")]
        done = spark._jvm.org.apache.hadoop.fs.Path
        return [int(p.getName().split("=")[1]) for p in names if store.exists(done(p, "_SUCCESS"))]

    # -------------------------------------------------------------------- requests
    def capacity(self) -> int:
        """Blocks that data may take."""
        return self.total * DATA_SHARE // 16

    def write(self, blocks: DataFrame) -> None:
        """Append ``blocks(lba, payload)``, each block at most once, as one batch."""
        if blocks.filter((F.col("lba") < 0) | (F.col("lba") >= self.capacity())).limit(1).count():
            raise OutOfRange(f"a write beyond the {self.capacity()} blocks of the device")
        self.before("write", self.next)
        sealed = integrity.sealed(blocks.select(F.col("lba").alias("pos"), "payload"), f"{self.seed}|{self.next}").withColumnRenamed("pos", "lba")
        sealed.repartitionByRange("lba").sortWithinPartitions("lba").write.mode("overwrite").parquet(f"{self.folder}/batch={self.next}")
        self.next += 1
        self.after("write", self.next - 1)

    def sync(self) -> int:
        """All batches so far are kept from now on; the id of the sync."""
        self.before("sync", self.next)
        index = self._records(self.next)
        if index is not None:
            index.groupBy("batch").agg(F.min("lba").alias("lo"), F.max("lba").alias("hi"), F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.folder}/index={self.next}")
        self.spark.createDataFrame([(self.next,)], "batches bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/sync={self.next}")
        self.synced = self.next
        self.after("sync", self.next)
        return self.next

    def read(self, wanted: DataFrame) -> DataFrame:
        """(lba, payload, intact) for each block of ``wanted(lba)``; null payloads where nothing was written."""
        asked = wanted.select("lba").distinct()
        if asked.filter((F.col("lba") < 0) | (F.col("lba") >= self.capacity())).limit(1).count():
            raise OutOfRange(f"a read beyond the {self.capacity()} blocks of the device")
        records = self._records(self.next)
        if records is None:
            return asked.select("lba", F.lit(None).cast("string").alias("payload"), F.lit(True).alias("intact"))
        newest = records.groupBy("lba").agg(F.max_by(F.struct("batch", "iv", "cipher", "mac"), "batch").alias("r")).select(F.col("lba").alias("pos"), "r.*")
        text = integrity.unsealed(F.concat_ws("|", F.lit(self.seed), F.col("batch").cast("string"), F.col("pos").cast("string")))
        opened = newest.select(F.col("pos").alias("lba"), text.cast("string").alias("payload"), F.lit(True).alias("there"))
        found = asked.join(opened, "lba", "left")
        return found.select("lba", "payload", (F.col("there").isNull() | F.col("payload").isNotNull()).alias("intact"))

    def _records(self, upto: int) -> DataFrame | None:
        """(lba, iv, cipher, mac, batch) of the batches before ``upto``."""
        if not upto:
            return None
        return self.spark.read.option("basePath", self.folder).parquet(*[f"{self.folder}/batch={k}" for k in range(upto)]).withColumn("batch", F.col("batch").cast("long"))
