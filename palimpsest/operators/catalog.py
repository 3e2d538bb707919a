"""Catalog of logs in buckets, transactions over it, and edit journals."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lsm import running


# ------------------------------------------------------------------------- catalog
def overlay(committed: DataFrame, created: DataFrame, deleted: DataFrame) -> DataFrame:
    """(log_id, bucket) as one transaction sees it: its own creations, not its deletions."""
    return committed.select("log_id", "bucket").union(created.select("log_id", "bucket")).join(deleted.select("log_id"), "log_id", "left_anti")


def list_bucket(catalog: DataFrame, bucket: str) -> DataFrame:
    return catalog.filter(F.col("bucket") == bucket).select("log_id")


def newest_in_bucket(catalog: DataFrame) -> DataFrame:
    """(bucket, log_id): the log that opening a bucket gives."""
    return catalog.groupBy("bucket").agg(F.max("log_id").alias("log_id"))


def move(catalog: DataFrame, moves: DataFrame) -> DataFrame:
    """(log_id, bucket) after ``moves(log_id, source, target)``; a wrong source moves nothing."""
    m = moves.select("log_id", "source", "target")
    there = F.when(F.col("source") == F.col("bucket"), F.col("target"))
    return catalog.join(m, "log_id", "left").select("log_id", F.coalesce(there, F.col("bucket")).alias("bucket"))


def contains(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """(log_id, exists) for each wanted id."""
    have = catalog.select("log_id", F.lit(True).alias("have"))
    return wanted.join(have, "log_id", "left").select("log_id", F.coalesce("have", F.lit(False)).alias("exists"))


def next_log_id(seen: DataFrame) -> DataFrame:
    """One row: an id that no log ever had."""
    return seen.agg((F.coalesce(F.max("log_id"), F.lit(-1)) + 1).alias("log_id"))


def lazy_deletes(deleted: DataFrame, handles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pending, ready): deleted logs that are still open, and those whose space can go."""
    return deleted.join(handles, "log_id", "left_semi").select("log_id"), deleted.join(handles, "log_id", "left_anti").select("log_id")


def writer_conflicts(writers: DataFrame) -> DataFrame:
    """(log_id, n_writers): logs that more than one transaction writes."""
    each = writers.select("log_id", "tx_id").distinct().groupBy("log_id").agg(F.count("*").alias("n_writers"))
    return each.filter("n_writers > 1")


def net_edits(edits: DataFrame) -> DataFrame:
    """(tx_id, log_id, kind, source, bucket, root, legal): the one edit of a log that each transaction leaves.

    ``edits(tx_id, log_id, ord, kind, source, bucket, root)`` in the order ``ord``.  A
    log is created, appended to, moved or deleted; what was created or moved may be
    deleted, what was created or appended to may be appended to, and nothing else
    follows.  The last root counts.  ``legal`` is false where a step may not follow.
    """
    key = Window.partitionBy("tx_id", "log_id").orderBy("ord")
    before, kind = F.lag("kind").over(key), F.col("kind")
    born = F.first("kind").over(key) == "create"
    step = (
        F.when(before.isNull(), True)
        .when(kind == "append", before.isin("create", "append"))
        .when(kind == "delete", before.isin("create", "move") | ((before == "append") & born))
        .otherwise(False)
    )
    last, first = F.max_by("kind", "ord"), F.min_by("kind", "ord")
    each = edits.withColumn("step", step).groupBy("tx_id", "log_id")
    return each.agg(
        F.when(last == "delete", "delete").otherwise(first).alias("kind"),
        F.max_by("source", "ord").alias("source"),
        F.max_by("bucket", F.when(F.col("bucket").isNotNull(), F.col("ord"))).alias("bucket"),
        F.max_by("root", F.when(F.col("root").isNotNull(), F.col("ord"))).alias("root"),
        F.bool_and("step").alias("legal"),
    )


def apply_edits(state: DataFrame, edits: DataFrame) -> DataFrame:
    """(log_id, bucket, root) after the net edits of committed transactions, in the order of ``tx_id``.

    ``state(log_id, bucket, root)``.  A log is there if its last creation is not
    followed by a deletion; its bucket is that of the last creation or move, its
    root that of the last creation or append.  One shuffle, no replay.
    """
    none = F.lit(None)
    given = state.select("log_id", F.lit(-1).cast("long").alias("tx_id"), F.lit("create").alias("kind"), "bucket", "root")
    every = given.unionByName(edits.select("log_id", F.col("tx_id").cast("long").alias("tx_id"), "kind", "bucket", "root"))
    at = lambda *kinds: F.when(F.col("kind").isin(*kinds), F.col("tx_id")).otherwise(none)
    folded = every.groupBy("log_id").agg(
        F.max_by("kind", at("create", "delete")).alias("life"), F.max_by("bucket", at("create", "move")).alias("bucket"), F.max_by("root", at("create", "append")).alias("root")
    )
    return folded.filter("life = 'create'").select("log_id", "bucket", "root")


def apply_journal(edits: DataFrame) -> DataFrame:
    """(store, key, state): three stores folded from one journal of committed edits.

    ``edits(ord, store, key, x)``: chunks are taken (1) or given back (0), the last
    one counts; raw logs grow by x blocks; logs of the catalog get the root x.
    """
    last = F.max_by("x", "ord")
    state = F.when(F.first("store") == "raw log", F.sum("x")).otherwise(last)
    return edits.groupBy("store", "key").agg(state.alias("state"))


# -------------------------------------------------------------------- transactions
def visible(rows: DataFrame, own: int | None = None) -> DataFrame:
    """Rows of committed transactions, and those of the reader's own."""
    seen = F.col("status") == "Committed"
    return rows.filter(seen if own is None else seen | (F.col("tx_id") == own))


def undecided(rows: DataFrame) -> DataFrame:
    """Transactions that ended without a decision."""
    return rows.filter("status = 'Ongoing'").select("tx_id").distinct()


class Transactions:
    """Handlers around a decision: the last registered run first.

    A precommit handler may raise, which aborts; commit handlers must not fail.
    """

    def __init__(self):
        self.precommit: list[Callable] = []
        self.commit: list[Callable] = []
        self.abort: list[Callable] = []
        self.next_id = 0

    @contextmanager
    def begin(self):
        tx = {"id": self.next_id, "status": "Ongoing", "data": {}}
        self.next_id += 1
        try:
            yield tx
            for h in reversed(self.precommit):
                h(tx)
        except BaseException:
            tx["status"] = "Aborted"
            for h in reversed(self.abort):
                h(tx)
            raise
        tx["status"] = "Committed"
        for h in reversed(self.commit):
            h(tx)


# ------------------------------------------------------------------------ journals
def committed_edits(edits: DataFrame, commits: DataFrame) -> DataFrame:
    """Edits of groups that have a commit record; others are as if never written."""
    return edits.join(commits.select("group_id").distinct(), "group_id", "left_semi")


def aborted_edits(edits: DataFrame, commits: DataFrame) -> DataFrame:
    return edits.join(commits.select("group_id").distinct(), "group_id", "left_anti")


def fold_sum(edits: DataFrame) -> DataFrame:
    """(key, total, n): edits that add to a state."""
    return edits.groupBy("key").agg(F.sum("x").alias("total"), F.count("*").alias("n"))


def recover_sum(snapshot: DataFrame, edits: DataFrame, marker: int) -> DataFrame:
    """The snapshot and the edits after its marker."""
    later = fold_sum(edits.filter(F.col("ord") >= marker)).select("key", F.col("total").alias("more"), F.col("n").alias("m"))
    zero = F.lit(0).cast("long")
    return snapshot.join(later, "key", "full").select(
        "key", (F.coalesce("total", zero) + F.coalesce("more", zero)).alias("total"), (F.coalesce("n", zero) + F.coalesce("m", zero)).alias("n")
    )


def newest_snapshot(copies: DataFrame) -> DataFrame:
    """(key, copy, version): of two stored copies the newest valid one."""
    return copies.filter("valid").groupBy("key").agg(F.max_by("copy", "version").alias("copy"), F.max("version").alias("version"))


def kept_versions(copies: DataFrame, keep: int = 2) -> DataFrame:
    """The newest ``keep`` versions of each key."""
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("version")))
    return copies.withColumn("place", place).filter(F.col("place") <= keep).drop("place")


def packed(records: DataFrame, size: Column, block: int, by: str) -> DataFrame:
    """(by, block, n): records packed by their running size; one that crosses a border counts to the next block."""
    run = F.sum(size).over(Window.partitionBy(by).orderBy("ord"))
    return records.withColumn("block", F.floor((run - 1) / F.lit(block)).cast("long")).groupBy(by, "block").agg(F.count("*").alias("n"))


def compaction_due(appended: DataFrame, capacity: int) -> DataFrame:
    """(group_id, used, due): blocks appended so far and whether the journal is full."""
    used = F.col("used")
    return running(appended, "group_id", F.col("n_blocks"), "used").select("group_id", used, (used >= capacity).alias("due"))
