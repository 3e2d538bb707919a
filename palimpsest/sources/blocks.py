"""Block sets, logs and rings as tables, and requests against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bits import int_div

BLOCK = 4096


# ------------------------------------------------------------------------ block sets
def zeroed(spark: SparkSession, n: int, size: int = BLOCK) -> DataFrame:
    """(pos, data): n blocks of zeros."""
    return spark.range(n).select(F.col("id").alias("pos"), F.unhex(F.repeat(F.lit("00"), size)).alias("data"))


class OutOfRange(ValueError):
    """A request reaches beyond the blocks there are."""


def read_blocks(blocks: DataFrame, pos: int, n: int, capacity: int | None = None) -> DataFrame:
    """Blocks pos .. pos + n - 1; with a ``capacity`` they must lie below it."""
    if pos < 0 or n < 0 or capacity is not None and pos + n > capacity:
        raise OutOfRange(f"blocks {pos} .. {pos + n - 1} of {capacity}")
    return blocks.filter(F.col("pos").between(pos, pos + n - 1))


def write_blocks(blocks: DataFrame, new: DataFrame, capacity: int | None = None) -> DataFrame:
    """The set with the blocks of ``new(pos, data)`` in place of its own.

    With a ``capacity`` a block beyond it fails the job that computes the set.
    """
    if capacity is not None:
        inside = (F.col("pos") >= 0) & (F.col("pos") < capacity)
        new = new.withColumn("pos", F.when(inside, F.col("pos")).otherwise(F.raise_error(F.concat(F.lit("write out of range: block "), F.col("pos").cast("string"))).cast("long")))
    n = new.select("pos", F.col("data").alias("new"))
    return blocks.join(n, "pos", "left").select("pos", F.coalesce("new", "data").alias("data"))


def subset(blocks: DataFrame, start: int, end: int) -> DataFrame:
    """Blocks start .. end - 1, numbered from 0."""
    return blocks.filter((F.col("pos") >= start) & (F.col("pos") < end)).withColumn("pos", F.col("pos") - start)


def read_slice(blocks: DataFrame, offset: int, length: int, size: int = BLOCK) -> DataFrame:
    """One row ``data``: bytes at any offset; only the blocks concerned are read."""
    first, last = offset // size, (offset + length - 1) // size
    parts = F.sort_array(F.collect_list(F.struct("pos", "data")))
    joined = F.aggregate(F.col("p"), F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["data"]))
    return read_blocks(blocks, first, last - first + 1).agg(parts.alias("p")).select(F.substr(joined, F.lit(offset - first * size + 1), F.lit(length)).alias("data"))


def write_slice(blocks: DataFrame, offset: int, data: bytes, size: int = BLOCK) -> DataFrame:
    """The set with ``data`` written at any offset; blocks at the ends keep their other bytes."""
    begin = F.greatest(F.col("pos") * size, F.lit(offset))
    end = F.least((F.col("pos") + 1) * size, F.lit(offset + len(data)))
    cut = F.substr(F.lit(bytes(data)), (begin - offset + 1).cast("int"), (end - begin).cast("int"))
    new = F.overlay(F.col("data"), cut, (begin - F.col("pos") * size + 1).cast("int"), (end - begin).cast("int"))
    return blocks.withColumn("data", F.when(end > begin, new).otherwise(F.col("data")))


def split(buffers: DataFrame, size: int) -> DataFrame:
    """(id, no, part): a buffer cut into blocks of ``size`` characters, the last may be short."""
    n = F.ceil(F.length("body") / F.lit(size)).cast("int")
    each = buffers.filter(F.length("body") > 0).select("id", "body", F.explode(F.sequence(F.lit(0), n - 1)).alias("no"))
    return each.select("id", F.col("no").cast("long").alias("no"), F.substr("body", F.col("no") * size + 1, F.lit(size)).alias("part"))


# --------------------------------------------------------------------- logs and rings
def append(log: DataFrame, new: DataFrame) -> DataFrame:
    """(pos, data): the log with ``new(ord, data)`` behind its last block."""
    end = log.agg((F.coalesce(F.max("pos"), F.lit(-1)) + 1).alias("end"))
    place = F.row_number().over(Window.orderBy("ord")) - 1  # one buffer's blocks
    return log.select("pos", "data").union(new.withColumn("place", place).crossJoin(F.broadcast(end)).select((F.col("end") + F.col("place")).alias("pos"), "data"))


def ring(log: DataFrame, n: int, value: str = "data") -> DataFrame:
    """(slot, pos, value): what a ring of n slots still holds of an append log."""
    return log.groupBy(F.pmod("pos", F.lit(n)).alias("slot")).agg(F.max("pos").alias("pos"), F.max_by(value, "pos").alias(value))


# --------------------------------------------------------------------------- requests
def out_of_bounds(requests: DataFrame, capacity: int) -> DataFrame:
    """Requests that reach beyond the last block, or start before the first."""
    return requests.filter((F.col("lba") < 0) | (F.col("lba") + F.col("n") > capacity))


def scatter(buffers: DataFrame) -> DataFrame:
    """(req, buf, block, lba): the address of each block of the buffers of a request.

    ``buffers(req, lba, buf, n)``: buffers follow each other from the request's lba.
    """
    before = F.sum("n").over(Window.partitionBy("req").orderBy("buf").rowsBetween(Window.unboundedPreceding, -1))
    placed = buffers.filter("n > 0").withColumn("first", F.coalesce(before, F.lit(0)))
    each = placed.select("req", "buf", "lba", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("block"))
    return each.select("req", "buf", "block", (F.col("lba") + F.col("first") + F.col("block")).alias("lba"))


def read_requests(requests: DataFrame, buffered: DataFrame, tree: DataFrame) -> DataFrame:
    """(req, lba, value, source): each block from the write buffer, else the tree, else missing.

    A missing block is a null of its own; the others of its request are read.
    """
    each = requests.select("req", F.explode(F.sequence("lba", F.col("lba") + F.col("n") - 1)).alias("lba"))
    b = buffered.select(F.col("key").alias("lba"), F.struct("value").alias("b"))
    t = tree.select(F.col("key").alias("lba"), F.struct("value").alias("t"))
    found = each.join(b, "lba", "left").join(t, "lba", "left")
    source = F.when(F.col("b").isNotNull(), "buffer").when(F.col("t").isNotNull(), "tree").otherwise("missing")
    return found.select("req", "lba", F.coalesce("b", "t")["value"].alias("value"), source.alias("source"))


STEPS = {"Init": 0, "Submitted": 1, "Completed": 2}


def state_anomalies(states: DataFrame) -> DataFrame:
    """(req, seq, before, state): steps of a request that do not follow the one before."""
    order = Window.partitionBy("req").orderBy("seq")
    step = F.create_map(*[x for k, v in STEPS.items() for x in (F.lit(k), F.lit(v))])
    before = F.lag("state").over(order)
    known = states.withColumn("before", before)
    right = F.when(F.col("before").isNull(), step[F.col("state")] == 0).otherwise(step[F.col("state")] == step[F.col("before")] + 1)
    return known.filter(~F.coalesce(right, F.lit(False))).select("req", "seq", "before", "state")


def flushes(log: DataFrame, capacity: int) -> DataFrame:
    """(flush, n_writes, n_blocks): a write buffer emptied at every ``capacity`` writes holds each key once."""
    each = log.groupBy(int_div(F.col("seq"), capacity).alias("flush"), "key").agg(F.count("*").alias("n"))
    return each.groupBy("flush").agg(F.sum("n").alias("n_writes"), F.count("*").alias("n_blocks"))
