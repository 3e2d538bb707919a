"""Mixing sources to target weights, with DataFrame operations only.

Documents are leaves of a domain - language - source tree.  A token budget flows
from the root down: the children of a node share its budget by weight, but none
gets more than its subtree can supply in ``epochs`` passes; what one cannot use
goes to its siblings by weight, and only what all siblings together cannot use is
lost to the level above, whose own sharing has already counted with it.

Each leaf then takes documents in seeded order, epoch after epoch, as long as
their tokens fit its budget: a prefix of an order that depends on the seed, the
epoch and the document only.

Tokens are words.  Null language or source is the branch ''; null texts have no
tokens and are always taken with their epoch; rows with equal ids stand at one place in
the order and are taken together or not at all.  Weights that are missing count as 1, weights of 0 get nothing.
Extra columns pass through.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

LEVELS = ("domain", "lang", "source")
#: Leaves are dealt into parts by leading hex digits of the order key, and only the
#: part where the budget ends is ordered in full.  Digits are added, from two on, until
#: a part of a leaf that holds all rows would have about this many.
PART_ROWS = 1 << 20


def part_digits(rows: int) -> int:
    return max(2, math.ceil(math.log(max(1.0, rows / PART_ROWS), 16)))


def word_count(text: Column) -> Column:
    """Runs of characters outside the six ASCII white-space ones."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    space = lambda c: c.isin(" ", "\t", "\n", "\x0b", "\f", "\r").cast("int")
    pieces = F.size(F.split(t, "[ \t-\r]+", -1))
    return F.when(t == "", 0).otherwise(pieces - space(F.substring(t, 1, 1)) - space(F.substring(t, -1, 1))).cast("long")


def shared_budget(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Adds ``share`` to ``nodes(parent..., child, weight, capacity, budget)``.

    Water level of the children of each parent: in the order of capacity / weight,
    a child is full if the level that would serve it and all later ones, after the
    earlier ones took their capacity, is not below its own ratio.
    """
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight"))
    order = Window.partitionBy(*parent).orderBy(F.col("ratio").asc_nulls_last(), child)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    later = order.rowsBetween(0, Window.unboundedFollowing)
    leveled = nodes.withColumn("ratio", ratio).select(
        "*", F.try_divide(F.col("budget") - F.coalesce(F.sum("capacity").over(earlier), F.lit(0.0)), F.sum("weight").over(later)).alias("level")
    )
    full = (F.col("weight") > 0) & (F.col("ratio") <= F.col("level"))
    of_rest = F.min(F.when((F.col("weight") > 0) & ~full, F.struct("ratio", child, "level"))).over(Window.partitionBy(*parent))
    rest = leveled.withColumn("rest", of_rest["level"])
    share = F.when(F.col("weight") <= 0, 0.0).when(full, F.col("capacity")).otherwise(F.greatest(F.lit(0.0), F.col("weight") * F.col("rest")))
    return rest.withColumn("share", share).drop("ratio", "level", "rest")


def budgets(leaves: DataFrame, weights: DataFrame, fraction: float, epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, budget LONG) for each leaf.

    ``leaves(domain, lang, source, tokens)``; ``weights(domain, lang, source, weight)``
    names a node by its path, with nulls below it.
    """
    capacity = F.sum("tokens") * F.lit(float(epochs))
    at = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).select((F.col("t") * F.lit(fraction)).alias("budget"))
    above = None
    for depth, child in enumerate(LEVELS):
        path, parent = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        own = weights.filter(F.col(child).isNotNull())
        for lower in LEVELS[depth + 1 :]:
            own = own.filter(F.col(lower).isNull())
        sized = leaves.groupBy(*path).agg(capacity.alias("capacity"))
        weighed = sized.join(own.select(*path, "weight"), path, "left").withColumn("weight", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)))
        given = weighed.crossJoin(F.broadcast(at)) if above is None else weighed.join(above, parent)
        # the root has one group; its key is a constant
        flow = shared_budget(given.withColumn("all", F.lit(0)), parent or ["all"], child)
        above = flow.select(*path, F.col("share").alias("budget"))
    return leaves.join(above, list(LEVELS)).select(*LEVELS, "tokens", F.floor("budget").cast("long").alias("budget"))


def mix_sources(
    docs: DataFrame,
    weights: DataFrame,
    domain: Column,
    fraction: float = 0.5,
    epochs: int = 2,
    seed: int = 42,
    id_col: str = "doc_id",
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """(row STRUCT of all columns, domain, lang, source, tokens, epoch INT) for each document taken.

    ``fraction`` of all tokens is the budget of the root.  A document occurs once
    for each epoch that takes it.
    """
    scratch = Scratch(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    branch = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    named = docs.select(
        row.alias("row"),
        branch(domain).alias("domain"),
        branch(F.col(f"`{lang_col}`")).alias("lang"),
        branch(F.col(f"`{source_col}`")).alias("source"),
        branch(F.col(f"`{id_col}`")).alias("name"),
        word_count(F.col(f"`{text_col}`")).alias("tokens"),
    )
    leaf = list(LEVELS)
    key = lambda epoch: F.md5(F.concat_ws("|", F.lit(seed), epoch.cast("string"), F.col("name")))
    digits = part_digits(docs.count())
    part = lambda k: F.substring(k, 1, digits)
    passes = F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch")

    # tokens of every part of every leaf and epoch: far fewer rows than documents
    parts = scratch.save(named.select(*leaf, "tokens", "name", passes).groupBy(*leaf, "epoch", part(key(F.col("epoch"))).alias("part")).agg(F.sum("tokens").alias("tokens")), files=8 * 16 ** (digits - 2))
    leaves = parts.filter("epoch = 0").groupBy(*leaf).agg(F.sum("tokens").alias("tokens"))
    plan = budgets(leaves, weights, fraction, epochs).drop("tokens")
    before = Window.partitionBy(*leaf).orderBy("epoch", "part").rowsBetween(Window.unboundedPreceding, -1)
    started = parts.join(plan, leaf).withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    over = F.col("start") + F.col("tokens") > F.col("budget")
    # where each leaf's budget ends: the first part that does not fit as a whole
    ends = started.groupBy(*leaf).agg(F.first("budget").alias("budget"), F.min(F.when(over, F.struct("epoch", "part", "start"))).alias("end"))
    ends = scratch.save(ends.select(*leaf, "budget", F.col("end.epoch").alias("last"), F.col("end.part").alias("edge"), F.col("end.start").alias("start")), files=1)

    # only the documents of that part are put in order; equal keys go together
    inside = named.drop("row").join(ends, leaf).withColumn("key", key(F.col("last"))).filter(part(F.col("key")) == F.col("edge"))
    summed = F.col("start") + F.sum("tokens").over(Window.partitionBy(*leaf).orderBy("key"))
    fits = inside.withColumn("sum", summed).filter(F.col("sum") <= F.col("budget")).groupBy(*leaf).agg(F.max("key").alias("until"))
    cut = scratch.save(ends.join(fits, leaf, "left").select(*leaf, "last", "edge", "until"), files=1)

    copies = named.join(cut, leaf).select("row", *leaf, "name", "tokens", "last", "edge", "until", passes)
    k = key(F.col("epoch"))
    taken = F.col("last").isNull() | (F.col("epoch") < F.col("last")) | ((F.col("epoch") == F.col("last")) & ((part(k) < F.col("edge")) | F.coalesce(k <= F.col("until"), F.lit(False))))
    return copies.filter(taken).select("row", *leaf, "tokens", F.col("epoch").cast("int").alias("epoch"))
