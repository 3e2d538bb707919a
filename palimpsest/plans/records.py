"""Queries over versioned records: reads, value states, runs, compaction."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.bits import int_div
from ..operators import lsm
from ..sources.scratch import scratch_root
from ..sources.tables import RUN_WRITES, SYNC_EVERY, order_log, write_log
from .registry import query

#: The events as a log, for SQL.
LOG = f"""log AS (
  SELECT user_id AS key, event_id AS seq, value, event_id // {SYNC_EVERY} AS epoch, event_id // {RUN_WRITES} AS run FROM events
), mark AS (SELECT (max(seq) + 1) // {SYNC_EVERY} * {SYNC_EVERY} AS upto FROM log)"""
LATEST = "SELECT key, arg_max(value, seq) AS value, max(seq) AS seq FROM {} GROUP BY key"
RUNS = f"""{LOG}, runs AS (
  SELECT run, key, arg_max(value, seq) AS value, max(seq) AS seq, max(epoch) AS epoch FROM log GROUP BY run, key
), ranges AS (SELECT run, min(key) AS lo, max(key) AS hi, count(*) AS n FROM runs GROUP BY run)"""
LEVELS = f"""{RUNS}, levels AS (
  SELECT run, lo, hi, n, CAST(CASE WHEN age < 4 THEN 0 WHEN age < 14 THEN 1 WHEN age < 114 THEN 2 WHEN age < 1114 THEN 3 WHEN age < 11114 THEN 4 ELSE 5 END AS INTEGER) AS level
  FROM (SELECT *, row_number() OVER (ORDER BY run DESC) - 1 AS age FROM ranges)
)"""
STATES = f"""{LOG}, states AS (
  SELECT key, arg_max(value, seq) FILTER (WHERE seq < upto) AS sv, max(seq) FILTER (WHERE seq < upto) AS ss,
    arg_max(value, seq) FILTER (WHERE seq >= upto) AS uv, max(seq) FILTER (WHERE seq >= upto) AS us
  FROM log, mark GROUP BY key
)"""
#: Keys to a cell when key ranges are joined.
CELL = 64


# ------------------------------------------------------------------------- lookups
@query(f"WITH {LOG} " + LATEST.format("log"))
def lsm_latest(spark, d):
    return lsm.latest(write_log(spark, d))


@query("SELECT o_custkey AS key, arg_max(o_totalprice, o_orderkey) AS value, max(o_orderkey) AS seq FROM orders GROUP BY o_custkey")
def lsm_latest_orders(spark, d):
    return lsm.latest(order_log(spark, d))


@query(f"WITH {LOG} " + LATEST.format("log, mark WHERE seq < upto").replace("GROUP BY key", "GROUP BY key"))
def lsm_asof_sync(spark, d):
    return lsm.latest(lsm.synced(write_log(spark, d), SYNC_EVERY))


@query(f"WITH {LOG} " + LATEST.format("log WHERE seq < 500"))
def lsm_asof_seq(spark, d):
    return lsm.as_of(write_log(spark, d), 500)


POINT = f"""WITH {LOG}, newest AS ({LATEST.format("log")})
SELECT w.key, value, seq IS NOT NULL AS found FROM (VALUES {{}}) w(key) LEFT JOIN newest n ON n.key = w.key"""


@query(POINT.format("(3::BIGINT), (7), (11)"))
def lsm_point_get(spark, d):
    return lsm.point_get(spark, write_log(spark, d), [3, 7, 11])


@query(POINT.format("(5::BIGINT), (999999999)"))
def lsm_point_get_missing(spark, d):
    return lsm.point_get(spark, write_log(spark, d), [5, 999_999_999])


RANGE = f"""WITH {LOG}, newest AS ({LATEST.format("log")}), slots AS (
  SELECT s.key, value, seq IS NOT NULL AS found FROM (SELECT unnest(range({{0}}, {{0}} + {{1}})) AS key) s LEFT JOIN newest n ON n.key = s.key
)"""


@query(RANGE.format(2, 6) + " SELECT * FROM slots")
def lsm_range_get(spark, d):
    return lsm.range_get(spark, write_log(spark, d), 2, 6)


@query(RANGE.format(-3, 9) + " SELECT * FROM slots")
def lsm_range_holes(spark, d):
    return lsm.range_get(spark, write_log(spark, d), -3, 9)


MISSING = """ SELECT min(key) FILTER (WHERE NOT found) AS first_missing, max(key) FILTER (WHERE NOT found) AS last_missing,
  count(*) FILTER (WHERE NOT found) AS n_missing, count(*) FILTER (WHERE NOT found) = 0 AS is_complete FROM slots"""


@query(RANGE.format(-3, 9) + MISSING)
def range_uncompleted(spark, d):
    return lsm.uncompleted(lsm.range_get(spark, write_log(spark, d), -3, 9))


@query(RANGE.format(2, 6) + MISSING)
def range_is_complete(spark, d):
    return lsm.uncompleted(lsm.range_get(spark, write_log(spark, d), 2, 6))


@query(f"WITH {RUNS} SELECT key, arg_max(value, run) AS value, -max(run) AS layer FROM runs GROUP BY key")
def range_first_layer_wins(spark, d):
    layers = lsm.runs(write_log(spark, d)).select((-F.col("run")).alias("layer"), "key", "value")
    return lsm.first_layer_wins(layers)


# ----------------------------------------------------------------------- durability
@query(f"WITH {LOG} SELECT key, seq, value FROM log, mark WHERE seq < upto")
def wal_synced_prefix(spark, d):
    return lsm.synced(write_log(spark, d), SYNC_EVERY).select("key", "seq", "value")


@query(f"WITH {LOG} SELECT CAST(upto // {SYNC_EVERY} AS BIGINT) AS sync_id, CAST(upto AS BIGINT) AS synced_upto FROM mark")
def wal_max_sync_id(spark, d):
    return lsm.sync_point(write_log(spark, d), SYNC_EVERY).select((F.col("synced_upto") / SYNC_EVERY).cast("long").alias("sync_id"), "synced_upto")


@query(f"WITH {STATES} SELECT key, sv AS value FROM states WHERE ss IS NOT NULL")
def recover_drop_unsynced(spark, d):
    return lsm.after_crash(lsm.value_states(write_log(spark, d), SYNC_EVERY))


# --------------------------------------------------------------------- value states
@query(
    f"""WITH {STATES} SELECT CASE WHEN ss IS NOT NULL AND us IS NOT NULL THEN 'SyncedAndUnsynced' WHEN ss IS NOT NULL THEN 'Synced' ELSE 'Unsynced' END AS state,
  count(*) AS n FROM states GROUP BY ALL"""
)
def value_state_counts(spark, d):
    return lsm.value_states(write_log(spark, d), SYNC_EVERY).groupBy("state").agg(F.count("*").alias("n"))


@query(f"WITH {STATES} SELECT key, CASE WHEN us IS NOT NULL THEN uv ELSE sv END AS value FROM states")
def value_read_prefers_unsynced(spark, d):
    return lsm.visible(lsm.value_states(write_log(spark, d), SYNC_EVERY))


@query(f"WITH {LOG} SELECT key, seq, value, epoch FROM (SELECT *, lead(seq) OVER (PARTITION BY key, epoch ORDER BY seq) AS later FROM log) WHERE later IS NOT NULL")
def value_put_drops(spark, d):
    return lsm.put_drops(write_log(spark, d))


@query(
    f"""WITH {LOG}, last AS (SELECT key, epoch, arg_max(value, seq) AS value, max(seq) AS seq FROM log GROUP BY key, epoch)
SELECT key, seq, value, dropped_at FROM (SELECT *, lead(epoch) OVER (PARTITION BY key ORDER BY epoch) AS dropped_at FROM last) WHERE dropped_at IS NOT NULL"""
)
def value_sync_drops(spark, d):
    return lsm.sync_drops(write_log(spark, d))


@query(
    f"""WITH {STATES} SELECT key, CASE WHEN us IS NOT NULL THEN uv ELSE sv END AS value,
  CASE WHEN us IS NOT NULL AND ss IS NOT NULL THEN sv END AS dropped_value, CASE WHEN us IS NOT NULL AND ss IS NOT NULL THEN ss END AS dropped_seq FROM states"""
)
def value_sync_transition(spark, d):
    return lsm.after_sync(lsm.value_states(write_log(spark, d), SYNC_EVERY))


@query(f"WITH {STATES} SELECT count(ss) + count(us) AS n_values, count(*) AS n_keys FROM states")
def memtable_size(spark, d):
    return lsm.table_size(lsm.value_states(write_log(spark, d), SYNC_EVERY))


# ----------------------------------------------------------------------------- runs
def _runs(spark, d):
    return lsm.runs(write_log(spark, d))


def _master(spark, d):
    return lsm.sync_point(write_log(spark, d), SYNC_EVERY).select((F.col("synced_upto") / SYNC_EVERY).cast("long").alias("sync_id"))


@query(f"WITH {RUNS} SELECT run, key, value, seq, epoch FROM runs")
def run_build(spark, d):
    return _runs(spark, d)


@query(
    f"""WITH {RUNS} SELECT run, block, min(key) AS lo, max(key) AS hi, count(*) AS n
FROM (SELECT *, (row_number() OVER (PARTITION BY run ORDER BY key) - 1) // 16 AS block FROM runs) GROUP BY run, block"""
)
def run_index(spark, d):
    return lsm.run_index(_runs(spark, d), 16)


@query(f"WITH {RUNS} SELECT * FROM ranges")
def run_key_ranges(spark, d):
    return lsm.key_ranges(_runs(spark, d))


@query(f"WITH {RUNS} SELECT r.run, key, value, seq FROM runs r JOIN ranges g ON r.run = g.run WHERE lo <= 5 AND hi >= 5 AND key = 5")
def run_point_pruned(spark, d):
    """Runs as files: the footers of all but those that may hold the key are all that is read of them."""
    path = f"{scratch_root(spark)}/runs-{uuid.uuid4().hex}"
    lsm.write_runs(_runs(spark, d), path)
    return spark.read.parquet(path).filter(F.col("key") == 5).select(F.col("run").cast("long").alias("run"), "key", "value", "seq")

@query(f"WITH {LEVELS} SELECT a.run AS a_run, b.run AS b_run FROM levels a JOIN levels b ON b.level = a.level + 1 AND a.lo <= b.hi AND b.lo <= a.hi")
def run_overlap_pairs(spark, d):
    """Each run with those of the next level that a compaction would have to merge with it."""
    return lsm.overlaps_below(_leveled_spans(spark, d))


SCAN = f"WITH {RUNS} SELECT run, key, value, epoch < upto // {SYNC_EVERY} AS is_synced FROM runs, mark"


@query(SCAN)
def run_scan_promote(spark, d):
    return lsm.scan_run(_runs(spark, d), _master(spark, d))


@query(SCAN + f" WHERE epoch < upto // {SYNC_EVERY}")
def run_scan_discard(spark, d):
    return lsm.scan_run(_runs(spark, d), _master(spark, d), discard=True)


@query(SCAN + f" WHERE epoch < upto // {SYNC_EVERY}")
def migration_drop_unsynced(spark, d):
    return lsm.migrate(_runs(spark, d), _master(spark, d))


# ----------------------------------------------------------------------- compaction
MERGE = f"""{RUNS}, u AS (SELECT *, run // 2 AS pair FROM runs WHERE run % 2 = 1), l AS (SELECT *, run // 2 AS pair FROM runs WHERE run % 2 = 0), merged AS (
  SELECT coalesce(u.pair, l.pair) AS pair, coalesce(u.key, l.key) AS key, CASE WHEN u.seq IS NOT NULL THEN u.value ELSE l.value END AS value, coalesce(u.seq, l.seq) AS seq,
    CASE WHEN u.seq IS NOT NULL AND l.seq IS NOT NULL THEN l.value END AS dropped_value,
    CASE WHEN u.seq IS NOT NULL AND l.seq IS NOT NULL THEN l.seq END AS dropped_seq
  FROM u FULL JOIN l ON u.pair = l.pair AND u.key = l.key
)"""


def _merged(spark, d):
    """Every run of odd number with the one before it."""
    runs = _runs(spark, d).withColumn("pair", int_div(F.col("run"), 2))
    return lsm.merge(runs.filter("run % 2 = 1"), runs.filter("run % 2 = 0"), ("pair",))


@query(f"WITH {MERGE} SELECT * FROM merged")
def merge_two_runs(spark, d):
    return _merged(spark, d)


@query(f"WITH {MERGE} SELECT pair, key, dropped_value AS value, dropped_seq AS seq FROM merged WHERE dropped_seq IS NOT NULL")
def merge_drop_events(spark, d):
    return _merged(spark, d).filter("dropped_seq is not null").select("pair", "key", F.col("dropped_value").alias("value"), F.col("dropped_seq").alias("seq"))


@query(
    """WITH s(x) AS (VALUES ('Synced'), ('Unsynced'), ('SyncedAndUnsynced'))
SELECT n.x AS newer, o.x AS older, r.result, r.dropped FROM s n CROSS JOIN s o LEFT JOIN (VALUES
  ('Synced', 'Synced', 'Synced', 'older'), ('Unsynced', 'Synced', 'SyncedAndUnsynced', 'none'), ('Unsynced', 'Unsynced', 'Unsynced', 'older'),
  ('Unsynced', 'SyncedAndUnsynced', 'SyncedAndUnsynced', 'older unsynced'), ('SyncedAndUnsynced', 'Synced', 'SyncedAndUnsynced', 'older')
) r(newer, older, result, dropped) ON r.newer = n.x AND r.older = o.x"""
)
def merge_rule_matrix(spark, d):
    names = ["Synced", "Unsynced", "SyncedAndUnsynced"]
    return lsm.merge_rule(spark.createDataFrame([(a, b) for a in names for b in names], "newer string, older string"))


def _levels(spark, d):
    return lsm.leveled(lsm.key_ranges(_runs(spark, d)))


def _leveled_spans(spark, d):
    """Levels without the number of keys: the writes of a run have its first and last key too."""
    return lsm.leveled(lsm.key_ranges(write_log(spark, d)).drop("n"))


@query(f"WITH {LEVELS} SELECT level, run, lo, hi, n FROM levels")
def level_listing(spark, d):
    return _levels(spark, d).select("level", "run", "lo", "hi", "n")


@query(
    f"""WITH {LEVELS} SELECT level, count(*) AS n_runs, CASE WHEN level = 0 THEN 4 ELSE CAST(10 ** level AS BIGINT) END AS threshold,
  count(*) >= CASE WHEN level = 0 THEN 4 ELSE 10 ** level END AND level < 5 AS due FROM levels GROUP BY level"""
)
def compaction_trigger(spark, d):
    return lsm.compaction_trigger(_levels(spark, d))


@query(
    f"""WITH {LEVELS}, o AS (SELECT * FROM levels WHERE level = 0 ORDER BY run LIMIT 1)
SELECT run, 'upper' AS role FROM o UNION ALL SELECT l.run, 'lower' FROM o, levels l WHERE l.level = 1 AND o.lo <= l.hi AND l.lo <= o.hi"""
)
def compaction_inputs(spark, d):
    return lsm.compaction_inputs(_levels(spark, d), 0, CELL)


@query(
    f"""WITH {LEVELS} SELECT run, level FROM levels a WHERE level < 5 AND NOT EXISTS (
  SELECT 1 FROM levels b WHERE b.level = a.level + 1 AND a.lo <= b.hi AND b.lo <= a.hi)"""
)
def trivial_move_candidates(spark, d):
    return lsm.trivial_moves(_leveled_spans(spark, d))


@query(f"WITH {LEVELS} SELECT run, lo, hi, n, level FROM levels WHERE run NOT IN (2, 5) UNION ALL SELECT 1000000, 0, 9, 10, 1")
def compaction_swap(spark, d):
    created = spark.createDataFrame([(1_000_000, 0, 9, 10, 1)], "run bigint, lo bigint, hi bigint, n bigint, level int")
    return lsm.swap_runs(_levels(spark, d), created, spark.createDataFrame([(2,), (5,)], "run bigint"))


@query(
    f"""WITH {LOG}, k AS (SELECT DISTINCT key FROM log)
SELECT chunk, min(key) AS lo, max(key) AS hi, count(*) AS n FROM (SELECT key, (row_number() OVER (ORDER BY key) - 1) // 40 AS chunk FROM k) GROUP BY chunk"""
)
def compaction_output_chunks(spark, d):
    return lsm.output_chunks(lsm.latest(write_log(spark, d)), 40)


@query("SELECT CAST(unnest(range(0, 6)) AS INTEGER) AS level, CASE WHEN unnest(range(0, 6)) > 0 THEN CAST(unnest(range(0, 6)) - 1 AS INTEGER) END AS upper_level, CASE WHEN unnest(range(0, 6)) < 5 THEN CAST(unnest(range(0, 6)) + 1 AS INTEGER) END AS lower_level")
def level_navigation(spark, d):
    level = F.col("id").cast("int")
    return spark.range(6).select(level.alias("level"), F.when(level > 0, level - 1).alias("upper_level"), F.when(level < 5, level + 1).alias("lower_level"))


# -------------------------------------------------------------------------- derived
@query(f"WITH {RUNS} SELECT count(*) AS stored, count(DISTINCT key) AS live, CAST(count(*) * 1000 // count(DISTINCT key) AS BIGINT) AS per_mille FROM runs")
def space_amplification(spark, d):
    # distinct keys by a second grouping, not by one wide distinct count
    per_key = _runs(spark, d).groupBy("key").agg(F.count("*").alias("c"))
    return per_key.agg(F.sum("c").alias("stored"), F.count("*").alias("live")).withColumn("per_mille", F.floor(F.col("stored") * 1000 / F.col("live")).cast("long"))


@query(f"WITH {STATES} SELECT key, us - ss AS lag FROM states WHERE us IS NOT NULL AND ss IS NOT NULL")
def sync_lag_per_key(spark, d):
    s = lsm.value_states(write_log(spark, d), SYNC_EVERY)
    return s.filter("unsynced_seq is not null and synced_seq is not null").select("key", (F.col("unsynced_seq") - F.col("synced_seq")).alias("lag"))
