"""Queries over the log catalog, transactions and journals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bits import int_div
from ..operators import catalog
from ..sources.tables import log_catalog, table, transactions
from .registry import query

LOGS = "logs AS (SELECT CAST(n_nationkey AS BIGINT) AS log_id, r_name AS bucket FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(f"WITH {LOGS} SELECT log_id FROM logs WHERE bucket = 'ASIA'")
def catalog_list_bucket(spark, d):
    return catalog.list_bucket(log_catalog(spark, d), "ASIA")


@query(f"WITH {LOGS} SELECT bucket, max(log_id) AS log_id FROM logs GROUP BY bucket")
def catalog_newest_in_bucket(spark, d):
    return catalog.newest_in_bucket(log_catalog(spark, d))


@query(f"WITH {LOGS} SELECT log_id, CASE WHEN log_id = 3 AND bucket = 'AMERICA' OR log_id = 8 AND bucket = 'ASIA' THEN 'ARCHIVE' ELSE bucket END AS bucket FROM logs")
def catalog_move(spark, d):
    moves = spark.createDataFrame([(3, "AMERICA", "ARCHIVE"), (8, "ASIA", "ARCHIVE")], "log_id bigint, source string, target string")
    return catalog.move(log_catalog(spark, d), moves)


def _tx_edits(spark):
    created = spark.createDataFrame([(100, "ASIA"), (101, "NEW")], "log_id bigint, bucket string")
    deleted = spark.createDataFrame([(2,), (101,)], "log_id bigint")
    return created, deleted


@query(f"WITH {LOGS} SELECT log_id, bucket FROM logs WHERE log_id <> 2 UNION ALL SELECT 100, 'ASIA'")
def catalog_overlay(spark, d):
    return catalog.overlay(log_catalog(spark, d), *_tx_edits(spark))


@query(f"WITH {LOGS} SELECT w.id AS log_id, l.log_id IS NOT NULL AS \"exists\" FROM (VALUES (0::BIGINT), (24), (25), (77)) w(id) LEFT JOIN logs l ON l.log_id = w.id")
def catalog_contains(spark, d):
    return catalog.contains(log_catalog(spark, d), spark.createDataFrame([(0,), (24,), (25,), (77,)], "log_id bigint"))


@query(f"WITH {LOGS} SELECT max(log_id) + 1 AS log_id FROM (SELECT log_id FROM logs UNION ALL SELECT 101)")
def catalog_next_log_id(spark, d):
    created, _ = _tx_edits(spark)
    return catalog.next_log_id(log_catalog(spark, d).select("log_id").union(created.select("log_id")))


# customers are open handles, nations that supply nothing costly are deleted logs
DELETED = "deleted AS (SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS log_id FROM supplier WHERE s_acctbal < 0), handles AS (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS log_id FROM customer WHERE c_acctbal > 9900)"


def _deleted(spark, d):
    deleted = table(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").cast("long").alias("log_id")).distinct()
    handles = table(spark, d, "customer").filter("c_acctbal > 9900").select(F.col("c_nationkey").cast("long").alias("log_id")).distinct()
    return deleted, handles


@query(f"WITH {DELETED} SELECT log_id FROM deleted SEMI JOIN handles USING (log_id)")
def lazy_delete_pending(spark, d):
    return catalog.lazy_deletes(*_deleted(spark, d))[0]


@query(f"WITH {DELETED} SELECT log_id FROM deleted ANTI JOIN handles USING (log_id)")
def lazy_delete_ready(spark, d):
    return catalog.lazy_deletes(*_deleted(spark, d))[1]


@query("SELECT l_orderkey AS log_id, count(DISTINCT l_suppkey) AS n_writers FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) > 1")
def single_writer_conflicts(spark, d):
    return catalog.writer_conflicts(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("log_id"), F.col("l_suppkey").alias("tx_id")))


EDITS = """edits AS (SELECT event_id // 50 AS tx_id, user_id AS log_id, event_id AS ord, ['create', 'append', 'append', 'delete', 'move'][1 + (event_id // 3) % 5] AS kind,
  CASE (event_id // 3) % 5 WHEN 4 THEN 'old' END AS source,
  CASE WHEN (event_id // 3) % 5 IN (0, 4) THEN event_type END AS bucket, CASE WHEN (event_id // 3) % 5 < 3 THEN event_id END AS root FROM events)"""
#: The legal sequences of one log in one transaction, by the first letters of the steps.
NET = """net AS (
  SELECT tx_id, log_id, CASE WHEN steps LIKE '%d' THEN 'delete' ELSE born END AS kind, source, bucket, root, regexp_full_match(steps, 'ca*d?|a+|md?|d') AS legal
  FROM (SELECT tx_id, log_id, string_agg(left(kind, 1), '' ORDER BY ord) AS steps, arg_min(kind, ord) AS born, arg_max(coalesce(source, ''), ord) AS s,
    nullif(s, '') AS source, arg_max(bucket, ord) FILTER (WHERE bucket IS NOT NULL) AS bucket, arg_max(root, ord) FILTER (WHERE root IS NOT NULL) AS root FROM edits GROUP BY tx_id, log_id)
)"""


def _log_edits(spark, d):
    e = table(spark, d, "events")
    n = int_div(F.col("event_id"), 3) % 5
    kinds = F.array(*map(F.lit, ("create", "append", "append", "delete", "move")))
    return e.select(
        int_div(F.col("event_id"), 50).alias("tx_id"),
        F.col("user_id").alias("log_id"),
        F.col("event_id").alias("ord"),
        kinds[n.cast("int")].alias("kind"),
        F.when(n == 4, "old").alias("source"),
        F.when(n.isin(0, 4), F.col("event_type")).alias("bucket"),
        F.when(n < 3, F.col("event_id")).alias("root"),
    )


@query(f"WITH {EDITS}, {NET} SELECT * FROM net")
def catalog_edit_algebra(spark, d):
    return catalog.net_edits(_log_edits(spark, d))


# logs that were there: one for each customer; a transaction with an illegal step aborts as a whole
@query(
    f"""WITH RECURSIVE {EDITS}, {NET}, good AS (SELECT * FROM net WHERE tx_id NOT IN (SELECT tx_id FROM net WHERE NOT legal) OR tx_id % 2 = 0),
steps AS (SELECT log_id, kind, bucket, root, row_number() OVER (PARTITION BY log_id ORDER BY tx_id) AS k FROM good),
f AS (SELECT CAST(c_custkey AS BIGINT) AS log_id, 0::BIGINT AS k, true AS alive, c_mktsegment AS bucket, 0::BIGINT AS root FROM customer
  UNION SELECT log_id, 0, false, NULL, NULL FROM steps WHERE log_id NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT s.log_id, s.k, CASE s.kind WHEN 'create' THEN true WHEN 'delete' THEN false ELSE f.alive END,
    CASE WHEN s.kind IN ('create', 'move') THEN s.bucket ELSE f.bucket END, CASE WHEN s.kind IN ('create', 'append') THEN s.root ELSE f.root END
  FROM f JOIN steps s ON s.log_id = f.log_id AND s.k = f.k + 1)
SELECT log_id, arg_max(coalesce(bucket, ''), k) AS bucket, max_by(root, k) AS root FROM f GROUP BY log_id HAVING arg_max(alive, k)"""
)
def catalog_apply_edits(spark, d):
    net = catalog.net_edits(_log_edits(spark, d))
    # every other transaction is replayed as it is, to have some with several edits
    bad = net.filter("NOT legal AND tx_id % 2 <> 0").select("tx_id").distinct()
    state = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("log_id"), F.col("c_mktsegment").alias("bucket"), F.lit(0).cast("long").alias("root"))
    return catalog.apply_edits(state, net.join(bad, "tx_id", "left_anti"))


# -------------------------------------------------------------------- transactions
TX = "tx AS (SELECT o_orderkey AS tx_id, o_custkey AS item, CASE o_orderstatus WHEN 'F' THEN 'Committed' WHEN 'O' THEN 'Aborted' ELSE 'Ongoing' END AS status FROM orders)"


@query(f"WITH {TX} SELECT DISTINCT item FROM tx WHERE status = 'Committed'")
def tx_committed_items(spark, d):
    return catalog.visible(transactions(spark, d)).select("item").distinct()


@query(f"WITH {TX} SELECT tx_id, item FROM tx WHERE status = 'Aborted'")
def tx_aborted_rows(spark, d):
    return transactions(spark, d).filter("status = 'Aborted'").select("tx_id", "item")


@query(f"WITH {TX} SELECT tx_id FROM tx WHERE status = 'Ongoing'")
def tx_undecided(spark, d):
    return catalog.undecided(transactions(spark, d))


@query(f"WITH {TX} SELECT DISTINCT item FROM tx WHERE status = 'Committed' OR tx_id = 7")
def tx_read_your_writes(spark, d):
    return catalog.visible(transactions(spark, d), own=7).select("item").distinct()


# ------------------------------------------------------------------------- journals
JOURNAL = "edits AS (SELECT event_id // 20 AS group_id, event_id AS ord, event_type AS key, event_id % 1000 AS x FROM events)"
COMMITS = "commits AS (SELECT DISTINCT group_id FROM edits WHERE group_id % 7 <> 3)"


def _edits(spark, d):
    e = table(spark, d, "events")
    return e.select(int_div(F.col("event_id"), 20).alias("group_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("key"), (F.col("event_id") % 1000).alias("x"))


def _commits(spark, d):
    return _edits(spark, d).filter("group_id % 7 <> 3").select("group_id").distinct()


@query(f"WITH {JOURNAL} SELECT key, CAST(sum(x) AS BIGINT) AS total, count(*) AS n FROM edits GROUP BY key")
def journal_fold_state(spark, d):
    return catalog.fold_sum(_edits(spark, d))


@query(f"WITH {JOURNAL} SELECT key, CAST(sum(x) AS BIGINT) AS total, count(*) AS n FROM edits GROUP BY key")
def journal_recover_from_snapshot(spark, d):
    edits = _edits(spark, d)
    return catalog.recover_sum(catalog.fold_sum(edits.filter("ord < 700")), edits, 700)


STORES = "['chunk', 'raw log', 'log root']"


@query(
    f"""WITH e AS (SELECT event_id // 20 AS group_id, event_id AS ord, {STORES}[1 + event_id % 3] AS store, user_id AS key,
  CASE event_id % 3 WHEN 0 THEN event_id // 3 % 2 WHEN 1 THEN event_id % 7 ELSE event_id END AS x FROM events), c AS (SELECT * FROM e WHERE group_id % 7 <> 3)
SELECT store, key, last(x ORDER BY ord) AS state FROM c WHERE store <> 'raw log' GROUP BY store, key
UNION ALL SELECT store, key, CAST(sum(x) AS BIGINT) FROM c WHERE store = 'raw log' GROUP BY store, key"""
)
def journal_three_stores(spark, d):
    """One committed group changes chunks, raw logs and the catalog together."""
    id_, n = F.col("event_id"), F.col("event_id") % 3
    x = F.when(n == 0, int_div(id_, 3) % 2).when(n == 1, id_ % 7).otherwise(id_)
    store = F.when(n == 0, "chunk").when(n == 1, "raw log").otherwise("log root")
    edits = table(spark, d, "events").select(int_div(id_, 20).alias("group_id"), id_.alias("ord"), store.alias("store"), F.col("user_id").alias("key"), x.alias("x"))
    commits = edits.filter("group_id % 7 <> 3").select("group_id").distinct()
    return catalog.apply_journal(catalog.committed_edits(edits, commits))


@query(f"WITH {JOURNAL}, {COMMITS} SELECT group_id, ord, key, x FROM edits SEMI JOIN commits USING (group_id)")
def journal_atomic_groups(spark, d):
    return catalog.committed_edits(_edits(spark, d), _commits(spark, d)).select("group_id", "ord", "key", "x")


@query(f"WITH {JOURNAL}, {COMMITS} SELECT group_id, ord, key, x FROM edits ANTI JOIN commits USING (group_id)")
def journal_aborted_groups(spark, d):
    return catalog.aborted_edits(_edits(spark, d), _commits(spark, d)).select("group_id", "ord", "key", "x")


COPIES = "copies AS (SELECT o_custkey AS key, o_orderkey AS version, o_totalprice AS copy, o_orderstatus <> 'P' AS valid FROM orders)"


def _copies(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("copy"), (F.col("o_orderstatus") != "P").alias("valid"))


@query(f"WITH {COPIES} SELECT key, arg_max(copy, version) AS copy, max(version) AS version FROM copies WHERE valid GROUP BY key")
def journal_two_copy_pick(spark, d):
    return catalog.newest_snapshot(_copies(spark, d))


@query(f"WITH {COPIES} SELECT key, version, copy, valid FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS p FROM copies) WHERE p <= 2")
def journal_kept_versions(spark, d):
    return catalog.kept_versions(_copies(spark, d))


@query(
    """WITH r AS (SELECT conv_id, CAST((sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 512 AS BIGINT) AS block FROM conversations WHERE length(text) > 0)
SELECT conv_id, block, count(*) AS n FROM r GROUP BY conv_id, block"""
)
def journal_record_packing(spark, d):
    rows = table(spark, d, "conversations").filter(F.length("text") > 0).withColumn("ord", F.col("turn"))
    return catalog.packed(rows, F.length("text"), 512, "conv_id")


@query(
    """WITH a AS (SELECT event_id // 500 AS group_id, count(*) AS n FROM events GROUP BY event_id // 500)
SELECT group_id, CAST(sum(n) OVER (ORDER BY group_id) AS BIGINT) AS used, sum(n) OVER (ORDER BY group_id) >= 2000 AS due FROM a"""
)
def journal_compaction_due(spark, d):
    each = table(spark, d, "events").groupBy(int_div(F.col("event_id"), 500).alias("group_id")).agg(F.count("*").alias("n_blocks"))
    return catalog.compaction_due(each, 2000)
