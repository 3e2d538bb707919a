"""Hash trees, linked checksums and authenticated blobs over test data.

These compute and check; they are no security boundary.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import int_div

#: Entries of a tree node.
FAN_OUT = 102


# -------------------------------------------------------------------------- hash tree
def leaves(blocks: DataFrame) -> DataFrame:
    """(pos, hash): the lowest level."""
    return blocks.select("pos", F.sha2(F.col("payload").cast("binary"), 256).alias("hash"))


def next_level(level: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """(pos, hash, n): nodes over ``fan_out`` children each, in order of position.

    A node gathers at most ``fan_out`` hashes, so no group grows with the data.
    """
    kids = F.sort_array(F.collect_list(F.struct("pos", "hash")))
    return level.groupBy(int_div(F.col("pos"), fan_out).alias("pos")).agg(kids.alias("kids")).select(
        "pos", F.sha2(F.array_join(F.col("kids.hash"), "").cast("binary"), 256).alias("hash"), F.size("kids").cast("long").alias("n")
    )


def height(n: int, fan_out: int = FAN_OUT) -> int:
    """Levels above the leaves; at least one."""
    h, reach = 1, fan_out
    while reach < n:
        h, reach = h + 1, reach * fan_out
    return h


def tree(blocks: DataFrame, n: int, fan_out: int = FAN_OUT) -> list[DataFrame]:
    """All levels from leaves to root; the number of leaves sets their count."""
    levels = [leaves(blocks)]
    for _ in range(height(n, fan_out)):
        levels.append(next_level(levels[-1].select("pos", "hash"), fan_out))
    return levels


def dumped(levels: list[DataFrame]) -> DataFrame:
    """(level, pos, hash): all nodes of a tree as one table."""
    each = [t.select(F.lit(k).alias("level"), "pos", "hash") for k, t in enumerate(levels)]
    out = each[0]
    for t in each[1:]:
        out = out.union(t)
    return out


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(pos): nodes whose hash differs or that only one side has."""
    x = a.select("pos", F.col("hash").alias("ha")).join(b.select("pos", F.col("hash").alias("hb")), "pos", "full")
    return x.filter(~F.col("ha").eqNullSafe(F.col("hb"))).select("pos")


def descent(a: list[DataFrame], b: list[DataFrame], fan_out: int = FAN_OUT) -> DataFrame:
    """(level, pos): nodes that differ between two trees, from the roots down.

    Below the root only the children of nodes that differ are looked at.
    """
    out, near = None, None
    for level in range(len(a) - 1, -1, -1):
        x, y = a[level], b[level]
        if near is not None:
            mine = lambda t: t.join(near, int_div(F.col("pos"), fan_out) == F.col("parent"), "left_semi")
            x, y = mine(x), mine(y)
        found = differing(x, y)
        near = found.select(F.col("pos").alias("parent"))
        own = found.select(F.lit(level).alias("level"), "pos")
        out = own if out is None else out.union(own)
    return out


def levels_above(n: Column, fan_out: int = FAN_OUT) -> Column:
    """``height`` of a tree over n leaves, for any long."""
    most, reach = [], fan_out
    while reach < 1 << 63:
        most.append(reach)
        reach *= fan_out
    return sum((n > F.lit(m)).cast("int") for m in most) + F.lit(1)


def node_shape(n: Column, pos: Column, at_height: int, fan_out: int = FAN_OUT) -> tuple[Column, Column]:
    """(complete?, complete children) of a node at a height over n leaves in all."""
    below = fan_out ** (at_height - 1)
    have = F.least(F.greatest(n - pos * (below * fan_out), F.lit(0)), F.lit(below * fan_out))
    return have == below * fan_out, int_div(have, below)


# ------------------------------------------------------------------------------ chain
def link(previous: Column, payload: Column) -> Column:
    """The checksum of a block given that of the one before it."""
    return F.sha2(F.concat(F.coalesce(previous, F.lit("")), F.sha2(payload.cast("binary"), 256)).cast("binary"), 256)


def chained(blocks: DataFrame, by: str) -> DataFrame:
    """(by, pos, payload, pre_mac, mac): each block linked to the checksum of the one before.

    A checksum needs the one before it, so a chain is followed in order; a task
    streams through its sorted chains and holds one checksum, however long they are.
    """

    def follow(batches):
        import pyarrow as pa

        held, last = None, None
        for b in batches:
            before, after = [], []
            for chain, digest in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                if held is None or held[0] != chain:
                    held, last = (chain,), None
                before.append(last)
                last = hashlib.sha256(((last or "") + digest).encode()).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(before, pa.string()), pa.array(after, pa.string())], names=[*b.schema.names[:3], "pre_mac", "mac"])

    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    ordered = blocks.select(by, "pos", "payload", F.sha2(F.col("payload").cast("binary"), 256).alias("digest")).repartition(by).sortWithinPartitions(by, "pos")
    return ordered.mapInArrow(follow, f"`{by}` {kinds[by]}, pos {kinds['pos']}, payload {kinds['payload']}, pre_mac string, mac string")


def folded(blocks: DataFrame, by: str) -> DataFrame:
    """(by, n, mac): the checksum of the last block of each chain, which stands for all of it."""
    return chained(blocks, by).groupBy(by).agg(F.count("*").alias("n"), F.max_by("mac", "pos").alias("mac"))


def verified(chain: DataFrame, by: str, first: int = 0) -> DataFrame:
    """Adds ``ok``: the stored checksum is right and names that of the block before, which is there.

    ``first``: where the readable part begins; the link of that block to what was
    trimmed is taken as given.
    """
    order = Window.partitionBy(by).orderBy("pos")
    own = F.col("mac") == link(F.col("pre_mac"), F.col("payload"))
    begins = (F.col("pos") == first) & (F.lit(True) if first else F.col("pre_mac").isNull())
    follows = (F.lag("pos").over(order) == F.col("pos") - 1) & (F.lag("mac").over(order) == F.col("pre_mac"))
    linked = F.when(F.lag("pos").over(order).isNull(), begins).otherwise(F.coalesce(follows, F.lit(False)))
    return chain.withColumn("ok", F.coalesce(own, F.lit(False)) & linked)


def valid_prefix(chain: DataFrame, by: str, first: int = 0) -> DataFrame:
    """Blocks before the first that fails."""
    bad = F.max(F.when(F.col("ok"), 0).otherwise(1)).over(Window.partitionBy(by).orderBy("pos"))
    return verified(chain, by, first).withColumn("bad", bad).filter("bad = 0").drop("bad", "ok")


def recovered(chain: DataFrame, by: str, first: int) -> DataFrame:
    """The longest valid prefix of what a chain holds from block ``first`` on."""
    return valid_prefix(trimmed(chain, first), by, first)


def trimmed(chain: DataFrame, first: int) -> DataFrame:
    """Only blocks from ``first`` on can be read."""
    return chain.filter(F.col("pos") >= first)


def block_range(chain: DataFrame, by: str) -> DataFrame:
    """(by, first, end, n): what of a chain can be read."""
    return chain.groupBy(by).agg(F.min("pos").alias("first"), (F.max("pos") + 1).alias("end"), F.count("*").alias("n"))


# ------------------------------------------------------------- authenticated encryption
def key_of(name: Column) -> Column:
    """A 16-byte key that depends on a name only, so that tests repeat."""
    return F.substring(F.unhex(F.sha2(name.cast("binary"), 256)), 1, 16)


def block_key(seed: str, pos: Column) -> Column:
    return key_of(F.concat_ws("|", F.lit(seed), pos.cast("string")))


def unsealed(name: Column) -> Column:
    """The content of (pos, iv, cipher, mac) under the key of that name; null where it was changed."""
    return F.try_aes_decrypt(F.concat("iv", "cipher", "mac"), key_of(name), F.lit("GCM"), F.lit("DEFAULT"), F.col("pos").cast("string").cast("binary"))


def sealed(blocks: DataFrame, seed: str) -> DataFrame:
    """(pos, iv, cipher, mac): AES-GCM with a key for each block and the position as its context."""
    text = F.col("payload").cast("binary")
    iv = F.unhex(F.lpad(F.hex("pos"), 24, "0"))
    blob = F.aes_encrypt(text, block_key(seed, F.col("pos")), F.lit("GCM"), F.lit("DEFAULT"), iv, F.col("pos").cast("string").cast("binary"))
    out = blocks.withColumn("blob", blob)
    n = F.length("blob")
    return out.select("pos", F.substr("blob", F.lit(1), F.lit(12)).alias("iv"), F.substr("blob", F.lit(13), n - 28).alias("cipher"), F.substr("blob", n - 15, F.lit(16)).alias("mac"))


def opened(rows: DataFrame, seed: str) -> DataFrame:
    """(pos, payload): null where the block was changed."""
    text = unsealed(F.concat_ws("|", F.lit(seed), F.col("pos").cast("string")))
    return rows.select("pos", text.cast("string").alias("payload"))


def repaired(primary: DataFrame, backup: DataFrame) -> DataFrame:
    """(pos, payload): the primary copy where it is valid, else the backup's."""
    b = backup.select("pos", F.col("payload").alias("spare"))
    return primary.join(b, "pos", "full").select("pos", F.coalesce("payload", "spare").alias("payload"))
