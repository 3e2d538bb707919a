"""Space accounting: free blocks, allocation, replay of changes, runs of block ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bits import int_div
from .lsm import numbered


def all_free(spark: SparkSession, n: int) -> DataFrame:
    """(id, is_free): a table of n free blocks."""
    return spark.range(n).select("id", F.lit(True).alias("is_free"))


def last_ops(ops: DataFrame) -> DataFrame:
    """(hba, op): the last operation on each block; ``ops(hba, op, at)`` with a total order ``at``."""
    return ops.groupBy("hba").agg(F.max_by("op", "at").alias("op"))


def replay(table: DataFrame, ops: DataFrame) -> DataFrame:
    """The table ``(id, is_free)`` after the recorded operations, id by id."""
    new = last_ops(ops).select(F.col("hba").alias("id"), (F.col("op") == "Dealloc").alias("now"))
    return table.join(new, "id", "left").select("id", F.coalesce("now", "is_free").alias("is_free"))


def recover(table: DataFrame, ops: DataFrame, after: Column) -> DataFrame:
    """A snapshot and the operations that came after it."""
    return replay(table, ops.filter(after))


def free_count(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("capacity"), F.count_if("is_free").alias("n_free"))


def allocate(table: DataFrame, n: int, hint: int = 0) -> DataFrame:
    """(id): n free blocks, next-fit from ``hint`` and then from the start; all of them or none."""
    free = table.filter("is_free").select("id", (F.col("id") < hint).cast("int").alias("wrapped"))
    taken = free.orderBy("wrapped", "id").limit(n).select("id")
    return taken.crossJoin(F.broadcast(taken.agg(F.count("*").alias("found")))).filter(F.col("found") == n).select("id")


def deallocate(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The table with ``ids(id)`` free again."""
    given = ids.select("id", F.lit(True).alias("now")).dropDuplicates(["id"])
    return table.join(given, "id", "left").select("id", F.coalesce("now", "is_free").alias("is_free"))


def repeated_ops(ops: DataFrame) -> DataFrame:
    """(hba, n_repeats): blocks with an operation that repeats the one before it."""
    before = F.lag("op").over(Window.partitionBy("hba").orderBy("at"))
    return ops.withColumn("before", before).filter("op = before").groupBy("hba").agg(F.count("*").alias("n_repeats"))


def net_edits(ops: DataFrame, tx: Column) -> DataFrame:
    """(tx, hba, net): what a transaction's operations on a block come to.

    Allocated and deallocated in one transaction cancel out; otherwise the last
    operation stands.
    """
    each = ops.select(tx.alias("tx"), "hba", "op", "at").groupBy("tx", "hba")
    first, last = F.min_by("op", "at"), F.max_by("op", "at")
    return each.agg(F.when((first == "Alloc") & (last == "Dealloc"), "None").otherwise(last).alias("net"))


def islands(ids: DataFrame) -> DataFrame:
    """(first, last, n): maximal runs of consecutive ``id`` values.

    A run begins where the id before is missing and ends where the one after is;
    begins and ends pair up by their place in order, which no single task sorts.
    """
    d = ids.select("id").distinct()
    begins = d.join(d.select((F.col("id") + 1).alias("id")), "id", "left_anti").select(F.col("id").alias("first"))
    ends = d.join(d.select((F.col("id") - 1).alias("id")), "id", "left_anti").select(F.col("id").alias("last"))
    return numbered(begins, "first", "k").join(numbered(ends, "last", "k"), "k").select("first", "last", (F.col("last") - F.col("first") + 1).alias("n"))


# ------------------------------------------------------------------ logs of chunks
def chunks_needed(append: Column, used: Column, chunk: int) -> Column:
    """Chunks to allocate before ``append`` blocks fit behind ``used`` ones."""
    spare = F.pmod(-used, F.lit(chunk))
    return F.ceil(F.greatest(append - spare, F.lit(0)) / F.lit(chunk)).cast("long")


def physical(logs: DataFrame, wanted: DataFrame, chunk: int) -> DataFrame:
    """(log_id, logical, block): where blocks of a log lie; ``logs(log_id, chunks ARRAY)``."""
    each = logs.select("log_id", F.posexplode("chunks").alias("no", "chunk_id"))
    asked = wanted.withColumn("no", int_div(F.col("logical"), chunk).cast("int"))
    return asked.join(each, ["log_id", "no"]).select("log_id", "logical", (F.col("chunk_id") * chunk + F.pmod("logical", F.lit(chunk))).alias("block"))


def head_and_tail(head: DataFrame, tail: DataFrame) -> DataFrame:
    """(log_id, chunks, n_blocks): a transaction's tail folded into the committed head."""
    t = tail.select("log_id", F.col("chunks").alias("tc"), F.col("n_blocks").alias("tn"))
    empty = F.array().cast("array<bigint>")
    return head.join(t, "log_id", "full").select(
        "log_id", F.concat(F.coalesce("chunks", empty), F.coalesce("tc", empty)).alias("chunks"), (F.coalesce("n_blocks", F.lit(0)) + F.coalesce("tn", F.lit(0))).alias("n_blocks")
    )
