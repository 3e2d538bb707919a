"""Reads and merges of versioned keyed records.

A log has (key, seq, value); seq orders all writes.  The newest write of a key
wins, which a grouped ``max_by`` computes with partial aggregation before its one
shuffle.  Whether a value is there is decided by seq, never by value, so that a
null value remains a value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bits import int_div


# ------------------------------------------------------------------------ lookups
def latest(log: DataFrame) -> DataFrame:
    """(key, value, seq): the newest write of every key."""
    return log.groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def sync_point(log: DataFrame, every: int) -> DataFrame:
    """One row: the number of the write that the last sync marker stands before."""
    return log.agg((int_div(F.coalesce(F.max("seq") + 1, F.lit(0)), every) * every).alias("synced_upto"))


def synced(log: DataFrame, every: int) -> DataFrame:
    """The prefix of the log before its last sync marker; what follows is lost in a crash."""
    return log.crossJoin(F.broadcast(sync_point(log, every))).filter("seq < synced_upto").drop("synced_upto")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """Newest values among writes before ``seq``; the filter reaches the scan."""
    return latest(log.filter(F.col("seq") < seq))


def point_get(spark: SparkSession, log: DataFrame, keys: list[int]) -> DataFrame:
    """(key, value, found) for each wanted key; missing ones have a null value."""
    wanted = spark.createDataFrame([(k,) for k in keys], "key bigint")
    found = latest(log.filter(F.col("key").isin(keys)))
    return wanted.join(found, "key", "left").select("key", "value", F.col("seq").isNotNull().alias("found"))


def range_get(spark: SparkSession, log: DataFrame, start: int, n: int) -> DataFrame:
    """(key, value, found): n consecutive keys from ``start``, a row for each slot."""
    hit = latest(log.filter(F.col("key").between(start, start + n - 1)))
    slots = spark.range(start, start + n).withColumnRenamed("id", "key")
    return slots.join(hit, "key", "left").select("key", "value", F.col("seq").isNotNull().alias("found"))


def uncompleted(slots: DataFrame) -> DataFrame:
    """One row: first and last empty slot, how many there are, whether none is left."""
    gap = F.when(~F.col("found"), F.col("key"))
    return slots.agg(
        F.min(gap).alias("first_missing"), F.max(gap).alias("last_missing"), F.count(gap).alias("n_missing"), (F.count(gap) == 0).alias("is_complete")
    )


def first_layer_wins(layers: DataFrame) -> DataFrame:
    """(key, value, layer): of ``layers(layer, key, value)`` the lowest layer that has a key."""
    return layers.groupBy("key").agg(F.min_by("value", "layer").alias("value"), F.min("layer").alias("layer"))


# --------------------------------------------------------- synced and unsynced values
def value_states(log: DataFrame, every: int) -> DataFrame:
    """(key, synced_value, synced_seq, unsynced_value, unsynced_seq, state) of every key."""
    marked = log.crossJoin(F.broadcast(sync_point(log, every)))
    old, new = F.col("seq") < F.col("synced_upto"), F.col("seq") >= F.col("synced_upto")
    pick = lambda c: (F.max_by(F.when(c, F.struct("value")), F.when(c, F.col("seq")))["value"], F.max(F.when(c, F.col("seq"))))
    (sv, ss), (uv, us) = pick(old), pick(new)
    out = marked.groupBy("key").agg(sv.alias("synced_value"), ss.alias("synced_seq"), uv.alias("unsynced_value"), us.alias("unsynced_seq"))
    return out.withColumn("state", state_name(F.col("synced_seq"), F.col("unsynced_seq")))


def state_name(synced_seq, unsynced_seq):
    return F.when(synced_seq.isNotNull() & unsynced_seq.isNotNull(), "SyncedAndUnsynced").when(synced_seq.isNotNull(), "Synced").when(unsynced_seq.isNotNull(), "Unsynced")


def visible(states: DataFrame) -> DataFrame:
    """(key, value): reads prefer the unsynced value."""
    return states.select("key", F.when(F.col("unsynced_seq").isNotNull(), F.col("unsynced_value")).otherwise(F.col("synced_value")).alias("value"))


def after_crash(states: DataFrame) -> DataFrame:
    """(key, value): unsynced values are gone, keys that had no other with them."""
    return states.filter("synced_seq is not null").select("key", F.col("synced_value").alias("value"))


def after_sync(states: DataFrame) -> DataFrame:
    """(key, value, dropped_value, dropped_seq): unsynced values take the place of synced ones."""
    fresh = F.col("unsynced_seq").isNotNull()
    both = fresh & F.col("synced_seq").isNotNull()
    return states.select(
        "key",
        F.when(fresh, F.col("unsynced_value")).otherwise(F.col("synced_value")).alias("value"),
        F.when(both, F.col("synced_value")).alias("dropped_value"),
        F.when(both, F.col("synced_seq")).alias("dropped_seq"),
    )


def put_drops(log: DataFrame) -> DataFrame:
    """(key, seq, value, epoch): writes replaced by a later one of the same key and sync epoch."""
    later = F.lead("seq").over(Window.partitionBy("key", "epoch").orderBy("seq"))
    return log.withColumn("later", later).filter("later is not null").select("key", "seq", "value", "epoch")


def sync_drops(log: DataFrame) -> DataFrame:
    """(key, seq, value, dropped_at): last writes of an epoch that a later epoch's sync replaces."""
    last = log.groupBy("key", "epoch").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
    later = F.lead("epoch").over(Window.partitionBy("key").orderBy("epoch"))
    return last.withColumn("dropped_at", later).filter("dropped_at is not null").select("key", "seq", "value", "dropped_at")


def table_size(states: DataFrame) -> DataFrame:
    """One row: values held (a key with two values counts twice), and keys."""
    return states.agg((F.count("synced_seq") + F.count("unsynced_seq")).alias("n_values"), F.count("*").alias("n_keys"))


# ------------------------------------------------------------------------- sorted runs
def runs(log: DataFrame) -> DataFrame:
    """(run, key, value, seq, epoch): the newest write of each key in each batch of the log."""
    return log.groupBy("run", "key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"), F.max("epoch").alias("epoch"))


def write_runs(run_rows: DataFrame, path: str, tasks: int | None = None) -> None:
    """Runs as Parquet, clustered so that key statistics prune files and row groups."""
    run_rows.repartitionByRange(*([tasks] if tasks else []), "run", "key").sortWithinPartitions("run", "key").write.mode("overwrite").parquet(path)


def key_ranges(run_rows: DataFrame) -> DataFrame:
    """(run, lo, hi, n): the footer of each run."""
    return run_rows.groupBy("run").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n"))


def run_index(run_rows: DataFrame, block: int) -> DataFrame:
    """(run, block, lo, hi, n): first and last key of each block of records."""
    place = F.row_number().over(Window.partitionBy("run").orderBy("key")) - 1
    return run_rows.withColumn("block", int_div(place, block)).groupBy("run", "block").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n"))


def overlaps(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """Pairs (a_run, b_run) whose key ranges meet, by an equi-join on buckets of keys.

    Each range visits the buckets of ``width`` keys that it covers; a pair is kept
    in the bucket where its common part begins, so it comes out once.
    """

    def spread(d: DataFrame, p: str) -> DataFrame:
        return d.select(
            F.col("run").alias(f"{p}_run"), F.col("lo").alias(f"{p}_lo"), F.col("hi").alias(f"{p}_hi"),
            F.explode(F.sequence(int_div(F.col("lo"), width), int_div(F.col("hi"), width))).alias("cell"),
        )

    met = spread(a, "a").join(spread(b, "b"), "cell").filter("a_lo <= b_hi AND b_lo <= a_hi")
    return met.filter(F.col("cell") == int_div(F.greatest("a_lo", "b_lo"), width)).select("a_run", "b_run")


def _facing(levels: DataFrame, deepest: int) -> tuple[DataFrame, DataFrame]:
    """(level, a_run, a_lo, a_hi) and (level, b_run, b_lo, b_hi): runs, and those of the level that they face.

    The first holds a bounded number of runs, all but those of the deepest level.
    """
    upper = levels.filter(F.col("level") < deepest).select((F.col("level") + 1).alias("level"), F.col("run").alias("a_run"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    return upper, levels.filter(F.col("level") > 0).select("level", F.col("run").alias("b_run"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))


def _met(upper: DataFrame, lower: DataFrame, by: str) -> DataFrame:
    """Runs and those that they face joined where they meet: a broadcast, so that no key range or level is one task's."""
    # not by the columns of a grouping before it: its parts would be taken over and, small as they are, merged into one task
    parts = int(lower.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lower.repartition(parts, by, "level").join(F.broadcast(upper), "level").filter("a_lo <= b_hi AND b_lo <= a_hi")


def overlaps_below(levels: DataFrame, deepest: int = 5) -> DataFrame:
    """Pairs (a_run, b_run) whose key ranges meet, the second of the level below the first.

    A pair is formed once, however long the ranges are and however many begin at one key.
    """
    upper, lower = _facing(levels, deepest)
    return _met(upper, lower, "b_run").select("a_run", "b_run")


def scan_run(run_rows: DataFrame, master: DataFrame, discard: bool = False) -> DataFrame:
    """(run, key, value, is_synced): a run older than the master sync id counts as synced.

    ``master(sync_id)`` has one row.  With ``discard`` unsynced records go.
    """
    out = run_rows.crossJoin(F.broadcast(master)).select("run", "key", "value", (F.col("epoch") < F.col("sync_id")).alias("is_synced"))
    return out.filter("is_synced") if discard else out


# -------------------------------------------------------------------------- compaction
def merge(upper: DataFrame, lower: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., key, value, seq, dropped_value, dropped_seq): runs merged two by two, the upper one wins."""
    u = upper.select(*by, "key", F.col("value").alias("uv"), F.col("seq").alias("us"))
    v = lower.select(*by, "key", F.col("value").alias("lv"), F.col("seq").alias("ls"))
    won = F.col("us").isNotNull()
    both = won & F.col("ls").isNotNull()
    return u.join(v, [*by, "key"], "full").select(
        *by,
        "key",
        F.when(won, F.col("uv")).otherwise(F.col("lv")).alias("value"),
        F.coalesce("us", "ls").alias("seq"),
        F.when(both, F.col("lv")).alias("dropped_value"),
        F.when(both, F.col("ls")).alias("dropped_seq"),
    )


def merge_rule(pairs: DataFrame) -> DataFrame:
    """(newer, older, result, dropped): the outcome of merging two values of one key by state.

    The five pairs that can occur; all others give null.
    """
    new, old = F.col("newer"), F.col("older")
    case = lambda *rules: F.coalesce(*[F.when((new == n) & (old == o), r) for n, o, r in rules])
    s, u, b = "Synced", "Unsynced", "SyncedAndUnsynced"
    return pairs.select(
        "newer",
        "older",
        case((s, s, F.lit(s)), (u, s, F.lit(b)), (u, u, F.lit(u)), (u, b, F.lit(b)), (b, s, F.lit(b))).alias("result"),
        case((s, s, F.lit("older")), (u, s, F.lit("none")), (u, u, F.lit("older")), (u, b, F.lit("older unsynced")), (b, s, F.lit("older"))).alias("dropped"),
    )


#: Rows that one task numbers.
NUMBERED = 1_000_000


def running(rows: DataFrame, by: str, value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` up to and with each row, in the order of a numeric column of distinct values.

    Quantiles, one for every ``NUMBERED`` rows, cut the rows into ranges; each range is
    summed alone and shifted by what the ranges before it hold, so no task sorts all
    rows and the cuts are the same wherever they are used.
    """
    parts = min(100_000, -(-rows.count() // NUMBERED))
    shares = [i / parts for i in range(1, parts)]
    cuts = sorted(set(rows.agg(F.percentile_approx(by, shares, max(10_000, 2 * parts)).alias("cuts")).first()["cuts"] or [])) if shares else []
    part = F.array_size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(by))) if cuts else F.lit(0)
    dealt = rows.withColumn("part", part).withColumn("own", value.cast("long"))
    shift = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = dealt.groupBy("part").agg(F.sum("own").alias("n")).select("part", shift.alias("shift"))  # one row a range
    own = F.sum("own").over(Window.partitionBy("part").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("own", own).join(F.broadcast(sizes), "part").withColumn(name, F.col("own") + F.col("shift")).drop("part", "own", "shift")


def numbered(rows: DataFrame, by: str, name: str = "place") -> DataFrame:
    """Adds ``name``: the place of each row, from 0, in the order of a numeric column of distinct values."""
    return running(rows, by, F.lit(1), name).withColumn(name, F.col(name) - 1)


def output_chunks(merged: DataFrame, capacity: int) -> DataFrame:
    """(chunk, lo, hi, n): merged records cut into runs of ``capacity`` records."""
    chunk = numbered(merged.select("key"), "key").select("key", int_div(F.col("place"), capacity).alias("chunk"))
    return chunk.groupBy("chunk").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n"))


def leveled(ranges: DataFrame, l0: int = 4, growth: int = 10, deepest: int = 5) -> DataFrame:
    """Runs with a ``level``: the newest ``l0`` in level 0, then 10, 100, ... older ones."""
    level, at = F.lit(deepest), [l0]
    for i in range(1, deepest):
        at.append(at[-1] + growth**i)
    for i in range(deepest - 1, -1, -1):
        level = F.when(F.col("age") < at[i], i).otherwise(level)
    # all but a fixed number of runs are in the deepest level
    newest = ranges.select("run").orderBy(F.desc("run")).limit(at[-1])
    placed = newest.withColumn("age", F.row_number().over(Window.orderBy(F.desc("run"))) - 1)
    return ranges.join(placed, "run", "left").withColumn("level", level.cast("int")).drop("age")


def level_threshold(level, l0: int = 4, growth: int = 10):
    """Runs that a level may hold before it is compacted."""
    return F.when(level == 0, l0).otherwise(F.pow(F.lit(growth), level)).cast("long")


def compaction_trigger(levels: DataFrame, deepest: int = 5) -> DataFrame:
    """(level, n_runs, threshold, due): the deepest level is never compacted."""
    n = levels.groupBy("level").agg(F.count("*").alias("n_runs"))
    limit = level_threshold(F.col("level"))
    return n.select("level", "n_runs", limit.alias("threshold"), ((F.col("n_runs") >= limit) & (F.col("level") < deepest)).alias("due"))


def compaction_inputs(levels: DataFrame, level: int, width: int) -> DataFrame:
    """(run, role): the oldest run of a level and the runs below that it overlaps."""
    oldest = levels.filter(F.col("level") == level).orderBy("run").limit(1)
    below = levels.filter(F.col("level") == level + 1)
    met = overlaps(oldest.select("run", "lo", "hi"), below.select("run", "lo", "hi"), width)
    return oldest.select("run", F.lit("upper").alias("role")).union(met.select(F.col("b_run").alias("run"), F.lit("lower").alias("role")))


def trivial_moves(levels: DataFrame, deepest: int = 5) -> DataFrame:
    """(run, level): runs that no run of the next level overlaps, so they can move as they are.

    Of the runs below that begin at one key the longest decides, the others meet no more.
    """
    upper, lower = _facing(levels, deepest)
    longest = lower.groupBy("level", "b_lo").agg(F.max("b_hi").alias("b_hi"))
    met = _met(upper, longest, "b_lo").select(F.col("a_run").alias("run")).distinct()
    return levels.filter(F.col("level") < deepest).join(met, "run", "left_anti").select("run", "level")


def swap_runs(levels: DataFrame, created: DataFrame, deleted: DataFrame) -> DataFrame:
    """The level table after a compaction: deleted runs out, created ones in."""
    return levels.join(deleted.select("run"), "run", "left_anti").unionByName(created)


def migrate(run_rows: DataFrame, master: DataFrame) -> DataFrame:
    """Runs after recovery: records that the last sync does not cover are dropped for good."""
    return scan_run(run_rows, master, discard=True)
