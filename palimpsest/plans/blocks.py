"""Queries over blocks, buffers and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lsm
from ..sources import blocks
from ..sources.tables import SYNC_EVERY, table, write_log
from .registry import query


def _bytes(spark, d):
    """(pos, data): each page, address and html, as one block."""
    page = F.concat(F.col("url"), F.lit("\n"), F.coalesce("html", F.lit("")))
    return table(spark, d, "pages").select(F.col("page_id").alias("pos"), page.cast("binary").alias("data"))


PAGES = "b AS (SELECT page_id AS pos, url || chr(10) || coalesce(html, '') AS data FROM pages)"


def _hashed(spark, d):
    """(pos, data): the digest of each whole page as a block of 32 bytes."""
    return _bytes(spark, d).select("pos", F.unhex(F.sha2("data", 256)).alias("data"))


HASHED = f"{PAGES}, h AS (SELECT pos, sha256(data) AS hex FROM b)"


def _text(df):
    return df.withColumn("data", F.col("data").cast("string"))


@query(f"WITH {PAGES} SELECT pos, data FROM b WHERE pos BETWEEN 3 AND 7")
def io_read_blocks(spark, d):
    return _text(blocks.read_blocks(_bytes(spark, d), 3, 5))


@query(f"WITH {HASHED} SELECT substr(string_agg(hex, '' ORDER BY pos), 11, 200) AS data FROM h WHERE pos BETWEEN 2 AND 5")
def io_unaligned_slice(spark, d):
    """100 bytes from the fifth byte of block 2 on."""
    return blocks.read_slice(_hashed(spark, d), 69, 100, 32).select(F.lower(F.hex("data")).alias("data"))


@query(
    f"""WITH {HASHED}, w AS (SELECT *, greatest(pos * 32, 37) AS s, least(pos * 32 + 32, 77) AS e FROM h)
SELECT pos, CASE WHEN e > s THEN substr(hex, 1, 2 * (s - pos * 32)) || repeat('5a', CAST(e - s AS INTEGER)) || substr(hex, 2 * (e - pos * 32) + 1) ELSE hex END AS data FROM w"""
)
def io_write_slice(spark, d):
    """40 bytes from byte 37 on: the ends of the blocks concerned stay."""
    return blocks.write_slice(_hashed(spark, d), 37, b"Z" * 40, 32).select("pos", F.lower(F.hex("data")).alias("data"))


@query(f"WITH {PAGES} SELECT pos, CASE pos WHEN 4 THEN 'new block four' ELSE data END AS data FROM b")
def io_write_blocks(spark, d):
    new = spark.createDataFrame([(4, b"new block four")], "pos bigint, data binary")
    return _text(blocks.write_blocks(_bytes(spark, d), new))


@query(f"WITH {PAGES} SELECT pos - 10 AS pos, data FROM b WHERE pos >= 10 AND pos < 20")
def io_subset(spark, d):
    return _text(blocks.subset(_bytes(spark, d), 10, 20))


@query(f"WITH {PAGES} SELECT pos, data FROM b UNION ALL SELECT (SELECT max(pos) FROM b) + 1, 'first' UNION ALL SELECT (SELECT max(pos) FROM b) + 2, 'second'")
def io_append(spark, d):
    new = spark.createDataFrame([(0, b"first"), (1, b"second")], "ord bigint, data binary")
    return _text(blocks.append(_bytes(spark, d), new))


@query("SELECT event_id % 64 AS slot, max(event_id) AS pos, arg_max(value, event_id) AS data FROM events GROUP BY event_id % 64")
def io_ring(spark, d):
    log = table(spark, d, "events").select(F.col("event_id").alias("pos"), F.col("value").alias("data"))
    return blocks.ring(log, 64)


@query("SELECT doc_id AS id, no, substr(text, no * 4096 + 1, 4096) AS part FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 4095) // 4096)) AS no FROM documents)")
def io_split_blocks(spark, d):
    return blocks.split(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body")), 4096)


# requests: an order writes its lines, each a buffer of some blocks
BUFFERS = "bufs AS (SELECT l_orderkey AS req, l_orderkey * 16 AS lba, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS buf, CAST(l_quantity AS BIGINT) % 5 AS n FROM lineitem)"


def _buffers(spark, d):
    from pyspark.sql import Window

    buf = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("long")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("req"), (F.col("l_orderkey") * 16).alias("lba"), buf.alias("buf"), (F.col("l_quantity").cast("long") % 5).alias("n"))


@query(
    f"""WITH {BUFFERS}, p AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY req ORDER BY buf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM bufs)
SELECT req, buf, block, CAST(lba + before + block AS BIGINT) AS lba FROM (SELECT *, unnest(range(0, n)) AS block FROM p)"""
)
def io_scatter_map(spark, d):
    return blocks.scatter(_buffers(spark, d))


@query("SELECT o_orderkey AS req, o_custkey AS lba, o_orderkey % 40 AS n FROM orders WHERE o_custkey + o_orderkey % 40 > (SELECT count(*) FROM customer)")
def io_bounds_violations(spark, d):
    r = table(spark, d, "orders").select(F.col("o_orderkey").alias("req"), F.col("o_custkey").alias("lba"), (F.col("o_orderkey") % 40).alias("n"))
    return blocks.out_of_bounds(r, table(spark, d, "customer").count())


LOG = f"log AS (SELECT user_id AS key, event_id AS seq, value FROM events), mark AS (SELECT (max(seq) + 1) // {SYNC_EVERY} * {SYNC_EVERY} AS upto FROM log)"


@query(
    f"""WITH {LOG}, u AS (SELECT key, arg_max(value, seq) AS value FROM log, mark WHERE seq >= upto GROUP BY key),
s AS (SELECT key, arg_max(value, seq) AS value FROM log, mark WHERE seq < upto GROUP BY key),
r AS (SELECT req, unnest(range(lba, lba + n)) AS lba FROM (VALUES (1, 0, 4), (2, 8, 10), (3, 100000000, 3)) v(req, lba, n))
SELECT CAST(req AS BIGINT) AS req, lba, CASE WHEN u.key IS NOT NULL THEN u.value ELSE s.value END AS value,
  CASE WHEN u.key IS NOT NULL THEN 'buffer' WHEN s.key IS NOT NULL THEN 'tree' ELSE 'missing' END AS source
FROM r LEFT JOIN u ON u.key = lba LEFT JOIN s ON s.key = lba"""
)
def io_read_requests(spark, d):
    log = write_log(spark, d)
    old = lsm.synced(log, SYNC_EVERY)
    new = log.join(old.select("seq"), "seq", "left_anti")
    requests = spark.createDataFrame([(1, 0, 4), (2, 8, 10), (3, 100_000_000, 3)], "req bigint, lba bigint, n bigint")
    return blocks.read_requests(requests, lsm.latest(new), lsm.latest(old))


STATES = "states AS (SELECT user_id AS req, event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'Init' WHEN 1 THEN 'Submitted' ELSE 'Completed' END AS state FROM events)"


@query(
    f"""WITH {STATES}, s AS (SELECT *, lag(state) OVER (PARTITION BY req ORDER BY seq) AS before FROM states)
SELECT req, seq, before, state FROM s WHERE NOT coalesce(CASE WHEN before IS NULL THEN state = 'Init' ELSE
  before = 'Init' AND state = 'Submitted' OR before = 'Submitted' AND state = 'Completed' END, false)"""
)
def io_state_anomalies(spark, d):
    e = table(spark, d, "events")
    state = F.when(F.col("event_id") % 3 == 0, "Init").when(F.col("event_id") % 3 == 1, "Submitted").otherwise("Completed")
    return blocks.state_anomalies(e.select(F.col("user_id").alias("req"), F.col("event_id").alias("seq"), state.alias("state")))


@query("SELECT event_id AS seq, user_id AS req, row_number() OVER (ORDER BY event_id) - 1 AS place FROM events WHERE event_type = 'click'")
def io_queue_order(spark, d):
    """Requests first in, first out: the place of each of them in the queue."""
    queued = table(spark, d, "events").filter("event_type = 'click'").select(F.col("event_id").alias("seq"), F.col("user_id").alias("req"))
    return lsm.numbered(queued, "seq")


@query("SELECT flush, CAST(sum(n) AS BIGINT) AS n_writes, count(*) AS n_blocks FROM (SELECT event_id // 128 AS flush, user_id, count(*) AS n FROM events GROUP BY event_id // 128, user_id) GROUP BY flush")
def io_buffer_flushes(spark, d):
    return blocks.flushes(write_log(spark, d), 128)
