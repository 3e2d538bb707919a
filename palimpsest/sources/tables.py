"""Tables as sources, in the roles that versioned records give them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import int_div

#: A sync marker stands before every write whose number is a multiple of this.
SYNC_EVERY = 300
#: Writes that fill one in-memory table and so make one sorted run.
RUN_WRITES = 100


def session(name: str = "palimpsest", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; settings can be added."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_log(spark: SparkSession, sf_dir: str, sync_every: int = SYNC_EVERY, run_writes: int = RUN_WRITES) -> DataFrame:
    """(key, seq, value, epoch, run): events as an append-only log of writes by user."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"),
        F.col("event_id").alias("seq"),
        "value",
        int_div(F.col("event_id"), sync_every).alias("epoch"),
        int_div(F.col("event_id"), run_writes).alias("run"),
    )


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, seq, value): orders as writes by customer."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"))


def allocation_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hba, op, at): line items as allocations and deallocations of blocks, in one total order.

    (order, line) is not unique, so the order goes on with further columns; rows
    that agree in all of them agree in the operation too.
    """
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("hba"),
        F.when(F.col("l_returnflag") == "R", "Dealloc").otherwise("Alloc").alias("op"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", F.col("l_returnflag").alias("flag")).alias("at"),
    )


def leaf_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, payload): documents as the data blocks of a protected log."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.coalesce("text", F.lit("")).alias("payload"))


def log_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_id, bucket, name): nations as logs in the bucket of their region."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("long").alias("log_id"), F.col("r_name").alias("bucket"), F.col("n_name").alias("name")
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tx_id, item, status): orders as transactions; F committed, O aborted, P undecided."""
    status = F.when(F.col("o_orderstatus") == "F", "Committed").when(F.col("o_orderstatus") == "O", "Aborted").otherwise("Ongoing")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx_id"), F.col("o_custkey").alias("item"), status.alias("status"))
