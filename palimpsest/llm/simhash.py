"""SimHash near-duplicates found by Golay-code fuzzy hashing, and exact ones by shingles.

``fingerprints``       one 64-bit SimHash per text
``link_fingerprints``  components of fingerprints that differ in few bits, exactly
``fingerprint_pairs``  texts whose SimHashes differ in few bits
``near_duplicates``    groups of documents whose word shingles overlap by at least
                       a given Jaccard similarity: those pairs, checked, and the rest

Every column may be null: a null text is the empty text, a null id never becomes
the name of a group that has another id.  Repeated rows and equal texts share a
fingerprint and are linked once, not pairwise.  Empty tables give empty results.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import golay
from .shared import (
    WORD_POWERS,
    Scratch,
    U,
    Words,
    bucket_bits,
    bucket_edges,
    components,
    encoded,
    group_sizes,
    in_blocks,
    small_batches,
    span_hashes,
    sweep,
    tidy,
    tidy_cogroup,
    tidy_group,
)

#: Segments of a 64-bit fingerprint: (lowest bit, width).
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: A bucket of this many fingerprints or fewer is compared pair by pair.
SMALL_BUCKET = 32
#: A fingerprint is hot if it holds more than this share of the rows: 1,000 of them at most.
HOT = 0.001
#: Longs of the sketch of a shingle set.
SKETCH = 16


# ---------------------------------------------------------------- fingerprints
def shingle_hashes(words: list[bytes], size: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of ``size`` words joined by a space; fewer words: of all."""
    if not words:
        return np.zeros(0, dtype=U)
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1)
    ends = list(accumulate(map(len, words), lambda a, b: a + 1 + b))
    starts = [0] + [e + 1 for e in ends[: n - 1]]
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], seed) for a, b in zip(starts, ends[min(size, len(words)) - 1 :])), dtype=U, count=n)


def majority(hashes: np.ndarray, step: int = 65_536) -> int:
    """The integer whose bits are those set in over half of the hashes; 0 for none."""
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), step):
        part = np.ascontiguousarray(hashes[i : i + step], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: bytes, size: int = 3) -> int:
    return majority(shingle_hashes(text.lower().split(), size))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp LONG) for every row; the long holds the 64 bits as they are."""

    def run(batches):
        for b in batches:
            fp = np.array([simhash(x, size) for x in encoded(b.column(1))], dtype=U)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


# ---------------------------------------------------------------------- linking
def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs such that fingerprints at distance 2 or less share a key.

    Of three segments with two errors in all, one has none and no other has more
    than two.  So each segment, taken exactly, is paired with the Golay keys of
    the next: about 16 keys of 34 bits for a fingerprint.
    """
    parts = [((fp >> U(at)) & U((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        j = (i + 1) % 3
        row, index = golay.fuzzy_keys(parts[j], SEGMENTS[j][1])
        rows.append(row)
        keys.append((i << 40) | (parts[i][row] << golay.DATA) | index)
    return np.concatenate(rows), np.concatenate(keys)


def link_fingerprints(scratch: Scratch, distinct: DataFrame) -> DataFrame:
    """(a LONG, b LONG): edges that connect exactly the fingerprints within 2 bits.

    ``distinct(fp LONG)`` holds each fingerprint once.  Small buckets are compared
    pair by pair.  Members of a larger bucket are linked through midpoints
    instead: each is sent to itself and its 64 neighbours, and what meets at a
    point lies within 2 bits, so all are tied to the least one there.  That finds
    every link among them with 65 rows a member, whatever the size of the bucket.
    """

    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            row, key = golay_keys(fp.view(U))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], names=["key", "fp"])

    keys = scratch.save(distinct.select("fp").mapInArrow(run, "key bigint, fp bigint"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    small = keys.join(sizes.filter(F.col("n") <= SMALL_BUCKET), "key").select("key", "fp")
    pairs = (
        small.select("key", F.col("fp").alias("a"))
        .join(small.select("key", F.col("fp").alias("b")), "key")
        .filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2))
        .select("a", "b")
    )
    crowd = keys.join(sizes.filter(F.col("n") > SMALL_BUCKET), "key", "left_semi").select("fp").distinct()
    # the highest bit is written as the negative long it is
    flips = [0] + [(1 << k) - (1 << 64 if k == 63 else 0) for k in range(64)]
    points = crowd.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(x).cast("bigint")) for x in flips])).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    met = points.join(least, "point").filter("fp > least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    return pairs.union(met).distinct()


def fingerprint_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp LONG, component): component is the smallest id reachable over links.

    Hot fingerprints, a bounded number, are broadcast to their rows, which stay where
    they are; the rows of all others meet their component by a shuffle.
    """
    scratch = Scratch(docs.sparkSession)
    marked = scratch.save(fingerprints(docs, id_col, text_col, size))
    least = marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    links = link_fingerprints(scratch, least)
    comp = components(scratch, links)
    named = comp.join(least.withColumnRenamed("fp", "node"), "node")
    roots = named.groupBy("root").agg(F.min("least").alias("component"))
    joined = comp.join(roots, "root").select(F.col("node").alias("fp"), "component")
    owner = scratch.save(least.join(joined, "fp", "left").select("fp", F.coalesce("component", "least").alias("component"), "n"))
    hot = F.col("n") > HOT * marked.count()
    most = F.broadcast(owner.filter(hot).drop("n"))
    rest = marked.join(F.broadcast(most.select("fp")), "fp", "left_anti").join(owner.filter(~hot).drop("n"), "fp")
    return marked.join(most, "fp").unionByName(rest).select("id", "fp", "component")


# -------------------------------------------------- groups by shingle similarity
def shingle_set(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of lower-case words; fewer words: one for all."""
    w = Words([text.lower()])
    h = w.hashes()
    if not len(h):
        return h
    n = max(1, len(h) - size + 1)
    at = np.arange(n)
    return np.unique(span_hashes(h, at, at + min(size, len(h)), WORD_POWERS))


def parity(hashes: np.ndarray) -> np.ndarray:
    """A set as ``SKETCH`` longs: each of its members flips one bit.

    Two sets that differ in d members have sketches that differ in d bits or fewer.
    """
    flips = np.bincount((hashes % U(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view("<i8")


def shared_prefixes(texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """(h, node, n, pos, often, sketch): shingles by which a text meets all that are similar to it.

    Let every text order its n shingles by how often the corpus holds them, then by
    hash.  Two texts that reach the similarity share at least ceil(similarity * n)
    of them, so the first one they share is among the n - ceil(similarity * n) + 1
    first of either, at ``pos``.  Those that occur once in the corpus are left out.
    ``often`` is the logarithm of the count; ``texts(node, text)`` may repeat texts.
    ``sketch`` is the text's ``parity``, on one of its rows only.
    """
    blocks, n_blocks = in_blocks(texts, "text")
    bits = bucket_bits(n_blocks, 1_300_000)

    def sets_of(table: pa.Table) -> dict[bytes, np.ndarray]:
        row = table.column("row").combine_chunks()
        out: dict[bytes, np.ndarray] = {}
        if len(row):
            for node, x in zip(row.field("node").to_pylist(), encoded(row.field("text"))):
                if node not in out:
                    out[node] = shingle_set(x, size)
        return out

    def keys_of(sets: dict[bytes, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        h = np.sort(np.concatenate([np.zeros(0, dtype=U), *sets.values()]))
        keys, at = group_sizes(h)
        return keys, np.diff(np.append(at, len(h))).astype(np.uint32)

    def ask(key, table):
        keys, n = keys_of(sets_of(table))
        edges = bucket_edges(keys, bits)
        used = np.flatnonzero(np.diff(edges))
        return pa.table(
            {
                "bucket": pa.array(used.astype(np.int32)),
                "block": pa.array([key[0].as_py()] * len(used), pa.int32()),
                "keys": pa.array([keys[edges[b] : edges[b + 1]].tobytes() for b in used], pa.binary()),
                "n": pa.array([n[edges[b] : edges[b + 1]].tobytes() for b in used], pa.binary()),
            }
        )

    def count(key, table):
        blobs = [np.frombuffer(x, dtype=U) for x in table.column("keys").to_pylist()]
        h = np.concatenate(blobs)
        n = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in table.column("n").to_pylist()])
        order = np.argsort(h)
        keys, at = group_sizes(h[order])
        often = np.minimum(255, 8 * np.log2(np.add.reduceat(n[order].astype(np.int64), at))).astype(np.uint8)
        return pa.table(
            {
                "bucket": table.column("bucket"),
                "block": table.column("block"),
                "often": pa.array([often[np.searchsorted(keys, k)].tobytes() for k in blobs], pa.binary()),
            }
        )

    def emit(key, left, right):
        sets = sets_of(left)
        keys, _ = keys_of(sets)
        answers = sorted(zip(right.column("bucket").to_pylist(), right.column("often").to_pylist()))
        often = np.frombuffer(b"".join(x for _, x in answers), dtype=np.uint8)
        nodes, found, sketches = [], [np.zeros((0, 4), dtype=np.int64)], []
        for node, h in sets.items():
            if not len(h):
                continue
            c = often[np.searchsorted(keys, h)]
            order = np.lexsort((h.view(np.int64), c))[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1]
            pos = np.flatnonzero(c[order])
            order = order[pos]
            nodes += [node] * len(pos)
            sketches += [parity(h)] * min(1, len(pos)) + [None] * (len(pos) - 1)
            found.append(np.stack([h[order].view(np.int64), np.full(len(pos), len(h)), pos, c[order].astype(np.int64)], axis=1))
        h, n, pos, c = np.concatenate(found).T
        return pa.table({"h": pa.array(h), "node": pa.array(nodes, pa.binary()), "n": pa.array(n.astype(np.int32)), "pos": pa.array(pos.astype(np.int32)), "often": pa.array(c.astype(np.int32)), "sketch": pa.array(sketches, pa.list_(pa.int64()))})

    asked = blocks.groupBy("block").applyInArrow(tidy_group(ask), "bucket int, block int, keys binary, n binary")
    answers = asked.groupBy("bucket").applyInArrow(tidy_group(count), "bucket int, block int, often binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tidy_cogroup(emit), "h bigint, node binary, n int, pos int, often int, sketch array<bigint>")


def fingerprint_pairs(scratch: Scratch, texts: DataFrame, size: int = 5, text_col: str = "text") -> DataFrame:
    """(a, b): texts whose SimHashes differ in 2 bits or fewer, found by Golay keys.

    ``texts(node, text)`` may repeat texts.  Fingerprints are linked exactly
    (``link_fingerprints``); the least node of each stands for it, and the other texts
    of that fingerprint are paired with it.
    """
    marked = scratch.save(fingerprints(texts, "node", text_col, size).distinct())
    least = scratch.save(marked.groupBy("fp").agg(F.min("id").alias("least")))
    own = marked.join(least, "fp").filter("id > least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    of = lambda end: least.select(F.col("fp").alias(end), F.col("least").alias(f"node_{end}"))
    met = link_fingerprints(scratch, least).join(of("a"), "a").join(of("b"), "b")
    across = met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    return own.union(across)


def text_node(text: Column) -> Column:
    """Half the SHA-256 of a text, which names it among all texts; null for a null text."""
    return F.unhex(F.substring(F.sha2(text.cast("string").cast("binary"), 256), 1, 32))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    similarity: float = 0.8,
    crowded: int = 48,
    rounds: int = 2,
    part_rows: int = 2_000,
) -> DataFrame:
    """(id, node, group, first): documents that repeat another, with the smallest id of their group.

    ``node`` names the text (``text_node``), as an id may have several.  ``first`` is
    true for one id and text of each group: the smallest id, at a tie the smallest node.
    Equal texts are one node.  Two nodes are linked exactly if the Jaccard similarity
    of their word shingles reaches ``similarity``, wherever their words differ.
    SimHashes and their Golay keys find the first links (``fingerprint_pairs``), which
    the sets confirm.  Two bits of a SimHash do not hold all pairs that reach the
    similarity, so an exact prefix filter (``shared_prefixes``) offers those that are
    not connected yet, and the sets decide again.  Members of its buckets of more than
    ``crowded`` texts are first compared with one of them, ``rounds`` times; then all
    pairs of a bucket are but those linked already, in parts of ``part_rows``.  Pairs
    whose places in the bucket or whose sketches show that they cannot reach the
    similarity are not even formed.  Documents that are alone do not appear.  Rows
    with a null id or no words are left alone.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), text_node(text).alias("node")).filter("id is not null")
    exact = scratch.save(rows.select("id", "node"))
    texts = rows.filter("node is not null").select("node", "text")

    def first_shared():
        """Whether a and b, at their places in one bucket, can reach the similarity.

        Judged at the first shingle they share: all others come after it in both.
        """
        rest = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
        return rest * (1 + similarity) >= (F.col("a.n") + F.col("b.n")) * similarity - 1e-6

    def alike():
        """Whether the sketches of a and b differ in no more bits than the sets may in members."""
        bits = sum(F.bit_count(F.col("a.sketch")[i].bitwiseXOR(F.col("b.sketch")[i])) for i in range(SKETCH))
        return bits * (1 + similarity) <= (F.col("a.n") + F.col("b.n")) * (1 - similarity) + 1e-6

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs whose shingles overlap enough; texts travel once per document."""
        pairs = scratch.save(pairs.distinct())
        needed = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()

        def sets(batches):
            for b in batches:
                blobs = [shingle_set(x, size).tobytes() for x in encoded(b.column(1))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(blobs, pa.binary())], names=["node", "s"])

        s = scratch.save(texts.join(needed, "node", "left_semi").dropDuplicates(["node"]).mapInArrow(tidy(sets), "node binary, s binary"))

        def judge(batches):
            for b in batches:
                keep = []
                for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                    x, y = np.frombuffer(x, dtype=U), np.frombuffer(y, dtype=U)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both > 0 and both >= similarity * (len(x) + len(y) - both) - 1e-9)
                yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        met = pairs.join(s.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(s.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
        out = scratch.save(met.select("a", "b", "sa", "sb").mapInArrow(tidy(judge), "a binary, b binary"))
        scratch.drop(s, pairs)
        return out

    links = verified(fingerprint_pairs(scratch, texts, size))
    owner = scratch.save(components(scratch, links).filter("node != root").select("node", F.col("root").alias("comp")))
    sweep(spark)  # the shuffles of this step are not needed beside those of the next

    # shingles that bring the same texts together are one bucket, that of the first of them
    found = scratch.save(shared_prefixes(texts, size, similarity).distinct())
    lists = found.groupBy("h").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("node").alias("least"), F.min("often").alias("often"))
    kept = lists.filter("m > 1").groupBy("m", "x", "least").agg(F.min(F.struct("often", "h")).alias("first")).select(F.col("first.h").alias("h"), "m")
    buckets = scratch.save(found.select("h", "node", "n", "pos").join(kept, "h"))
    sketches = scratch.save(found.filter("sketch is not null").select("node", "sketch"))
    scratch.drop(found)

    def owned(owner: DataFrame) -> DataFrame:
        """The buckets with the component of each member."""
        return buckets.join(owner, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    for turn in range(rounds):
        big = owned(owner).filter(F.col("m") > crowded)
        if not big.limit(1).count():
            break
        # first the member with the fewest rarer shingles, which is nearest to what the others share
        first = [] if turn else ["pos"]
        lead = big.groupBy("h").agg(F.min_by(F.struct("node", "n", "pos", "comp"), F.struct(*first, F.xxhash64("node", F.lit(turn)))).alias("b"))
        met = big.alias("a").join(lead, "h").filter((F.col("a.comp") != F.col("b.comp")) & first_shared())
        ok = verified(met.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")))
        links = links.union(ok)
        owner = scratch.save(components(scratch, links).filter("node != root").select("node", F.col("root").alias("comp")))

    # a crowded bucket is dealt into parts, and each two of its parts meet in one task
    members = owned(owner)
    mixed = members.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("h")
    members = scratch.save(members.join(mixed, "h", "left_semi").join(sketches, "node"))
    scratch.drop(buckets, sketches)
    n_parts = F.ceil(F.col("m") / F.lit(part_rows)).cast("int")
    left = members.withColumn("part", F.pmod(F.xxhash64("node"), n_parts).cast("int"))
    right = members.withColumn("part", F.explode(F.sequence(F.lit(0), n_parts - 1)))
    met = left.alias("a").join(
        right.alias("b"),
        (F.col("a.h") == F.col("b.h")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.comp") != F.col("b.comp")) & first_shared() & alike(),
    )
    ok = verified(met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")))
    scratch.drop(members)
    links = links.union(ok)
    named = exact.join(components(scratch, links).withColumnRenamed("root", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    groups = named.groupBy("comp").agg(F.min(F.struct("id", "node")).alias("least"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    return named.join(groups, "comp").select("id", "node", F.col("least.id").alias("group"), (F.struct("id", "node") == F.col("least")).alias("first"))
