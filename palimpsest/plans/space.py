"""Queries over allocated space, bitmaps, chunks and runs of block ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits
from ..operators import space
from ..sources.tables import allocation_ops, table
from .registry import query

#: Blocks of the device: one for each part.
OPS = """ops AS (
  SELECT l_partkey AS hba, CASE WHEN l_returnflag = 'R' THEN 'Dealloc' ELSE 'Alloc' END AS op,
    row(l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_returnflag) AS ord, l_orderkey FROM lineitem
), device AS (SELECT unnest(range(0, (SELECT max(p_partkey) + 1 FROM part))) AS id)"""
STATE = f"""{OPS}, last AS (SELECT hba, arg_max(op, ord) AS op FROM ops GROUP BY hba), state AS (
  SELECT id, coalesce(op = 'Dealloc', true) AS is_free FROM device LEFT JOIN last ON hba = id
)"""


def _device(spark, d):
    """(id, is_free): all blocks free; the table of parts sets how many there are."""
    n = table(spark, d, "part").agg((F.max("p_partkey") + 1).alias("n"))
    return n.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("id"), F.lit(True).alias("is_free"))


def _state(spark, d):
    return space.replay(_device(spark, d), allocation_ops(spark, d))


@query(f"WITH {STATE} SELECT id, is_free FROM state")
def alloc_diff_replay(spark, d):
    return _state(spark, d)


@query(f"WITH {STATE} SELECT count(*) AS capacity, count(*) FILTER (WHERE is_free) AS n_free FROM state")
def alloc_free_count(spark, d):
    return space.free_count(_state(spark, d))


FIT = f"""WITH {STATE}, taken AS (SELECT id FROM state WHERE is_free ORDER BY id < {{1}}, id LIMIT {{0}})
SELECT id FROM taken WHERE (SELECT count(*) FROM taken) = {{0}}"""


@query(FIT.format(10, 0))
def alloc_first_k(spark, d):
    return space.allocate(_state(spark, d), 10)


@query(FIT.format(25, 150))
def alloc_next_fit(spark, d):
    return space.allocate(_state(spark, d), 25, hint=150)


@query(FIT.format(100_000_000, 0))
def alloc_all_or_none(spark, d):
    return space.allocate(_state(spark, d), 100_000_000)


@query(f"WITH {STATE} SELECT id, is_free OR id < 50 AS is_free FROM state")
def alloc_dealloc_batch(spark, d):
    return space.deallocate(_state(spark, d), spark.range(50))


@query(
    f"""WITH {OPS} SELECT hba, count(*) AS n_repeats FROM (SELECT hba, op, lag(op) OVER (PARTITION BY hba ORDER BY ord) AS before FROM ops)
WHERE op = before GROUP BY hba"""
)
def alloc_double_op_anomalies(spark, d):
    return space.repeated_ops(allocation_ops(spark, d))


@query(
    f"""WITH {OPS} SELECT l_orderkey AS tx, hba, CASE WHEN arg_min(op, ord) = 'Alloc' AND arg_max(op, ord) = 'Dealloc' THEN 'None' ELSE arg_max(op, ord) END AS net
FROM ops GROUP BY l_orderkey, hba"""
)
def alloc_tx_net(spark, d):
    return space.net_edits(allocation_ops(spark, d), F.col("at.l_orderkey"))


@query(
    f"""WITH {OPS}, old AS (SELECT hba, arg_max(op, ord) AS op FROM ops WHERE l_orderkey < 300 GROUP BY hba),
snap AS (SELECT id, coalesce(op = 'Dealloc', true) AS is_free FROM device LEFT JOIN old ON hba = id),
new AS (SELECT hba, arg_max(op, ord) AS op FROM ops WHERE l_orderkey >= 300 GROUP BY hba)
SELECT id, coalesce(op = 'Dealloc', is_free) AS is_free FROM snap LEFT JOIN new ON hba = id"""
)
def alloc_snapshot_recover(spark, d):
    ops = allocation_ops(spark, d)
    snapshot = space.replay(_device(spark, d), ops.filter("at.l_orderkey < 300"))
    return space.recover(snapshot, ops, F.col("at.l_orderkey") >= 300)


# --------------------------------------------------------------------------- bitmaps
BITS = f"{STATE}, bits AS (SELECT id, is_free AS is_set FROM state)"


def _bits(spark, d):
    return _state(spark, d).withColumnRenamed("is_free", "is_set")


@query(f"WITH {BITS} SELECT count(*) AS bits, count(*) FILTER (WHERE is_set) AS ones, count(*) FILTER (WHERE NOT is_set) AS zeros FROM bits")
def bitmap_counts(spark, d):
    return bits.counts(_bits(spark, d))


@query(
    f"""WITH {BITS} SELECT min(id) FILTER (WHERE is_set AND id >= 40) AS first_one, min(id) FILTER (WHERE NOT is_set AND id >= 40) AS first_zero,
  max(id) FILTER (WHERE is_set) AS last_one, max(id) FILTER (WHERE NOT is_set) AS last_zero FROM bits"""
)
def bitmap_edges(spark, d):
    return bits.edges(_bits(spark, d), 40)


@query(f"WITH {BITS} SELECT id FROM bits WHERE NOT is_set AND id >= 40 ORDER BY id LIMIT 12")
def bitmap_first_zeros(spark, d):
    return bits.first_k(_bits(spark, d), 12, 40, value=False)


@query(f"WITH {BITS} SELECT id // 32 AS word, CAST(sum(CASE WHEN is_set THEN 1::BIGINT << CAST(id % 32 AS INTEGER) ELSE 0 END) AS BIGINT) AS mask FROM bits GROUP BY id // 32")
def bitmap_words(spark, d):
    return bits.words(_bits(spark, d))


@query(f"WITH {BITS} SELECT id, CASE WHEN id = 3 THEN true WHEN id = 4 THEN false ELSE is_set END AS is_set FROM bits")
def bitmap_set(spark, d):
    return bits.put_bits(_bits(spark, d), spark.createDataFrame([(3, True), (4, False)], "id bigint, is_set boolean"))


# ------------------------------------------------------------------- runs and chunks
@query(
    f"""WITH {STATE}, f AS (SELECT id, id - row_number() OVER (ORDER BY id) AS g FROM state WHERE is_free)
SELECT min(id) AS first, max(id) AS last, count(*) AS n FROM f GROUP BY g"""
)
def block_islands(spark, d):
    return space.islands(_state(spark, d).filter("is_free").select("id"))


@query("WITH f AS (SELECT o_orderkey AS id, o_orderkey - row_number() OVER (ORDER BY o_orderkey) AS g FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'F')) SELECT min(id) AS first, max(id) AS last, count(*) AS n FROM f GROUP BY g")
def block_islands_orders(spark, d):
    return space.islands(table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")))


@query("SELECT doc_id, CAST(ceil(greatest(n_chars - (1000 - doc_id % 1000) % 1000, 0) / 1000.0) AS BIGINT) AS n_chunks FROM documents")
def chunks_needed(spark, d):
    return table(spark, d, "documents").select("doc_id", space.chunks_needed(F.col("n_chars"), F.col("doc_id"), 1000).alias("n_chunks"))


@query(
    """WITH logs AS (SELECT s_nationkey AS log_id, list(s_suppkey ORDER BY s_suppkey) AS chunks FROM supplier GROUP BY s_nationkey)
SELECT CAST(log_id AS BIGINT) AS log_id, l AS logical, CAST(chunks[l // 64 + 1] * 64 + l % 64 AS BIGINT) AS block
FROM logs, (SELECT unnest([0, 63, 64, 100, 200]) AS l) WHERE l // 64 < len(chunks)"""
)
def logical_to_physical(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("log_id"), "s_suppkey")
    logs = s.groupBy("log_id").agg(F.sort_array(F.collect_list("s_suppkey")).alias("chunks"))
    at = F.explode(F.array(*[F.lit(x) for x in (0, 63, 64, 100, 200)])).alias("logical")
    return space.physical(logs, logs.select("log_id", at), 64)


@query(
    """WITH s AS (SELECT CAST(s_nationkey AS BIGINT) AS log_id, s_suppkey, s_suppkey % 3 = 0 AS fresh FROM supplier),
h AS (SELECT log_id, list(s_suppkey ORDER BY s_suppkey) AS chunks, count(*) * 10 AS n FROM s WHERE NOT fresh GROUP BY log_id),
t AS (SELECT log_id, list(s_suppkey ORDER BY s_suppkey) AS chunks, count(*) * 7 AS n FROM s WHERE fresh GROUP BY log_id)
SELECT coalesce(h.log_id, t.log_id) AS log_id, array_to_string(list_concat(coalesce(h.chunks, []), coalesce(t.chunks, [])), ',') AS chunks,
  CAST(coalesce(h.n, 0) + coalesce(t.n, 0) AS BIGINT) AS n_blocks FROM h FULL JOIN t ON h.log_id = t.log_id"""
)
def raw_log_head_and_tail(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("log_id"), "s_suppkey")

    def part(rows, n):
        return rows.groupBy("log_id").agg(F.sort_array(F.collect_list("s_suppkey")).alias("chunks"), (F.count("*") * n).alias("n_blocks"))

    fresh = F.col("s_suppkey") % 3 == 0
    both = space.head_and_tail(part(s.filter(~fresh), 10), part(s.filter(fresh), 7))
    return both.withColumn("chunks", F.array_join(F.col("chunks").cast("array<string>"), ","))


@query(
    """SELECT page_id, length(html) AS chars, CAST((length(html) + 511) // 512 * 512 AS BIGINT) AS up, CAST(length(html) // 512 * 512 AS BIGINT) AS down,
  length(html) > 0 AND length(html) % 512 = 0 AS valid FROM pages"""
)
def align_check(spark, d):
    n = F.length("html").cast("long")
    return table(spark, d, "pages").select("page_id", n.alias("chars"), bits.align_up(n, 512).alias("up"), bits.align_down(n, 512).alias("down"), bits.is_aligned(n, 512).alias("valid"))


@query("SELECT CAST(n * 15 // 16 AS BIGINT) AS data_blocks, CAST(n - n * 15 // 16 AS BIGINT) AS index_blocks, CAST((n - n * 15 // 16) * 9 // 10 AS BIGINT) AS store_blocks FROM (SELECT count(*) AS n FROM part)")
def device_split(spark, d):
    n = table(spark, d, "part").agg(F.count("*").alias("n"))
    data = F.floor(F.col("n") * 15 / 16)
    return n.select(data.alias("data_blocks"), (F.col("n") - data).alias("index_blocks"), F.floor((F.col("n") - data) * 9 / 10).alias("store_blocks"))
