"""Scalar arithmetic on ids and bitmaps, as columns that stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def int_div(x: Column, n: int) -> Column:
    """Whole division of non-negative longs."""
    return F.call_function("div", x.cast("long"), F.lit(n).cast("long"))


def align_down(x: Column, to: int) -> Column:
    """The largest multiple of ``to`` that is not above x."""
    return (x - F.pmod(x, F.lit(to))).cast("long")


def align_up(x: Column, to: int) -> Column:
    """The least multiple of ``to`` that is not below x."""
    return (x + F.pmod(-x, F.lit(to))).cast("long")


def is_aligned(x: Column, to: int) -> Column:
    """A buffer of x bytes is valid if it is not empty and a multiple of ``to``."""
    return (x > 0) & (F.pmod(x, F.lit(to)) == 0)


def words(bits: DataFrame, id_col: str = "id", on: str = "is_set") -> DataFrame:
    """(word LONG, mask LONG): 32 bits to a word, as a bitmap is stored."""
    bit = F.when(F.col(on), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col(id_col), F.lit(32)).cast("int"))).otherwise(F.lit(0).cast("long"))
    return bits.groupBy(int_div(F.col(id_col), 32).alias("word")).agg(F.sum(bit).alias("mask"))


def test_bit(mask: Column, place: Column) -> Column:
    return F.getbit(mask, place) == 1


def repeat(spark: SparkSession, value: bool, n: int) -> DataFrame:
    """A bitmap of n equal bits."""
    return spark.range(n).select("id", F.lit(value).alias("is_set"))


def put_bits(bits: DataFrame, changes: DataFrame) -> DataFrame:
    """The bitmap with ``changes(id, is_set)`` applied; ids beyond it are ignored."""
    new = changes.select("id", F.col("is_set").alias("new"))
    return bits.join(new, "id", "left").select("id", F.coalesce("new", "is_set").alias("is_set"))


def counts(bits: DataFrame) -> DataFrame:
    """One row: bits, ones, zeros."""
    return bits.agg(F.count("*").alias("bits"), F.count_if("is_set").alias("ones"), F.count_if(~F.col("is_set")).alias("zeros"))


def edges(bits: DataFrame, start: int = 0) -> DataFrame:
    """One row: first one and zero at or after ``start``, last one and zero (null: none)."""
    at = lambda c: F.when(c, F.col("id"))
    after = F.col("id") >= start
    one, zero = F.col("is_set"), ~F.col("is_set")
    return bits.agg(
        F.min(at(one & after)).alias("first_one"),
        F.min(at(zero & after)).alias("first_zero"),
        F.max(at(one)).alias("last_one"),
        F.max(at(zero)).alias("last_zero"),
    )


def first_k(bits: DataFrame, k: int, start: int = 0, value: bool = True) -> DataFrame:
    """The first k ids at or after ``start`` that hold ``value``: all k or none."""
    found = bits.filter((F.col("is_set") == value) & (F.col("id") >= start)).orderBy("id").limit(k).select("id")
    return found.crossJoin(F.broadcast(found.agg(F.count("*").alias("n")))).filter(F.col("n") == k).select("id")
