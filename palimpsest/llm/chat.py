"""Chat formatting from reply trees, with DataFrame operations only.

``reply_paths``        root-to-leaf paths of reply trees, ranked, best ones kept
``format_paths``       one formatted conversation per path, with its loss mask
``read_conversations`` the turns and the masked text back from the formatted text

Template: ``<turn>ROLE<text>TEXT</turn>`` for each turn, nothing between turns.
A control string inside a role or text, that is ``<``, any number of backslashes,
then ``turn>``, ``/turn>`` or ``text>``, gets one more backslash after the ``<``;
reading takes one away.  So text never looks like template, every other text stays
as it is, and the change is undone exactly.  The loss mask marks the text of each
assistant turn (as escaped) and nothing else.

Null texts and roles are empty.  Conversations with a null id form one
conversation of their own.  Turns with equal numbers follow role and text; null
numbers come first.  Repeated rows are repeated turns.  Empty tables give no rows.
Extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

TURN, TEXT, END = "<turn>", "<text>", "</turn>"
ESCAPE = (r"<(\\*)(/?turn>|text>)", r"<\\$1$2")
UNESCAPE = (r"<\\(\\*)(/?turn>|text>)", r"<$1$2")


def escape(c: Column) -> Column:
    return F.regexp_replace(c, *ESCAPE)


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, *UNESCAPE)


def reply_paths(scratch: Scratch, nodes: DataFrame, best: int = 1, unique: bool = False) -> DataFrame:
    """(tree, leaf, rank INT, pos LONG, node): the ``best`` paths of each tree.

    ``nodes(tree, node, parent, score)``; a null parent, or one that does not
    exist in the tree, is a root.  Names of nodes hold within their tree.  Of rows
    that repeat a node of a tree the one with the least parent (null first), then
    the least score, counts (``unique``: there are none).  Rows with a null tree or
    node take no part; a null score is 0; other columns, whatever their names, are
    not looked at.  A path scores the sum of its nodes; ties go to the smaller leaf.  Iterative self-joins double the distance that each node sees, so a
    chain of n turns takes log2(n) rounds, and each round keeps one row a node.
    Nodes on a cycle have no root and belong to no path.
    """
    known = nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    if not unique:
        known = known.filter("tree is not null and node is not null").groupBy("tree", "node").agg(F.min(F.struct("parent", "score")).alias("row")).select("tree", "node", "row.*")
    exists = known.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    real = known.join(exists, ["tree", "parent"], "left")
    start = scratch.save(real.select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("span"), F.col("score").alias("total")))
    # jumps[i]: nodes with an ancestor 2**i above them; span and total cover what lies
    # below it.  A node that has reached its root is done and takes no further part.
    jumps, done, limit = [start.filter("up is not null")], start.filter("up is null"), start.count()
    while 1 << (len(jumps) - 1) <= limit and jumps[-1].limit(1).count():
        live = jumps[-1]
        above = live.union(done).select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("span").alias("span2"), F.col("total").alias("total2"))
        step = live.join(above, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("span") + F.col("span2")).alias("span"), (F.col("total") + F.col("total2")).alias("total"))
        step = scratch.save(step)
        done = done.union(step.filter("up is null"))
        jumps.append(step.filter("up is not null"))
    parents = jumps[0].select("tree", F.col("up").alias("node"))
    leaves = done.join(parents, ["tree", "node"], "left_anti")
    w = Window.partitionBy("tree").orderBy(F.desc("total"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= best)
    # every distance below the span is one sum of powers of two: each node once
    path = scratch.save(chosen.select("tree", "rank", F.col("node").alias("leaf"), "node", (F.col("span") - 1).alias("pos")))
    for i in range(len(jumps) - 2, -1, -1):
        hop = jumps[i].select("tree", "node", "up")
        higher = path.join(hop, ["tree", "node"]).select("tree", "rank", "leaf", F.col("up").alias("node"), (F.col("pos") - (1 << i)).alias("pos"))
        path = scratch.save(path.union(higher.select(*path.columns)))
    return path.select("tree", "leaf", "rank", "pos", "node")


def format_paths(turns: DataFrame, key: list[str], loss_role: str = "assistant") -> DataFrame:
    """(key..., n_turns, formatted, spans) from ``turns(key..., pos, role, text)``.

    ``spans``: for each turn, where its block starts and the code points under the
    loss mask, as (start, loss_start, loss_end); both null for other turns.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(TURN), escape(role), F.lit(TEXT))
    block = turns.select(*key, "pos", role.alias("role"), head.alias("head"), escape(text).alias("body"))
    length = F.length("head") + F.length("body") + F.lit(len(END))
    before = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = block.withColumn("start", F.coalesce(F.sum(length.cast("long")).over(before), F.lit(0)))
    mine = F.col("role") == loss_role
    first = F.col("start") + F.length("head")
    turn = F.struct(
        "pos",
        F.concat("head", "body", F.lit(END)).alias("block"),
        F.struct("start", F.when(mine, first).alias("loss_start"), F.when(mine, first + F.length("body")).alias("loss_end")).alias("span"),
    )
    return placed.groupBy(*key).agg(F.sort_array(F.collect_list(turn)).alias("t")).select(
        *key,
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.col("t.block"), "").alias("formatted"),
        F.col("t.span").alias("spans"),
    )


def read_conversations(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text) and ``loss_texts``, both unescaped, to formatted rows.

    The masked texts are cut out by the spans, not taken from the turns.
    """
    blocks = F.slice(F.split("formatted", END, -1), 1, F.greatest(F.size(F.split("formatted", END, -1)) - 1, F.lit(0)))

    def turn(b: Column) -> Column:
        # the header ends at the first control string <text>; none stands in a role
        part = F.split(b, TEXT, 2)
        return F.struct(
            unescape(F.substring(F.element_at(part, 1), len(TURN) + 1, 2**31 - 1)).alias("role"),
            unescape(F.element_at(part, 2)).alias("text"),
        )

    masked = F.filter(F.arrays_zip("blocks", "spans"), lambda x: x["spans"]["loss_start"].isNotNull())
    cut = lambda x: F.substring(
        x["blocks"],
        (x["spans"]["loss_start"] - x["spans"]["start"] + 1).cast("int"),
        (x["spans"]["loss_end"] - x["spans"]["loss_start"]).cast("int"),
    )
    return (
        formatted.withColumn("blocks", blocks)
        .withColumn("turns", F.transform("blocks", turn))
        .withColumn("loss_texts", F.transform(masked, lambda x: unescape(cut(x))))
        .drop("blocks")
    )


def linear_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes, turns) of conversations without branches: each turn replies to the one before."""
    plain = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    numbered = plain.withColumn("n", F.row_number().over(w))
    name = lambda n: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), n.cast("string"))
    named = numbered.withColumn("node", name(F.col("n")))
    parent = F.when(F.col("n") > 1, name(F.col("n") - 1))
    nodes = named.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("tree"), "node", parent.alias("parent"), F.lit(1.0).alias("score"))
    return nodes, named.select("conv_id", "node", "role", "text")


def format_conversations(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, formatted, spans) of whole conversations, read as reply trees."""
    scratch = Scratch(rows.sparkSession)
    nodes, turns = linear_conversations(rows)
    turns = scratch.save(turns)
    paths = reply_paths(scratch, nodes, unique=True)  # numbered, so no node repeats
    return format_paths(paths.select("node", "pos").join(turns, "node").select("conv_id", "pos", "role", "text"), ["conv_id"], loss_role)
