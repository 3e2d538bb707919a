"""What several training-data operators share: scratch tables, text arithmetic on
byte arrays, and the block exchange.

Scratch tables cut lineage.  They live where ``sources.scratch`` says, which all
executors and the driver can reach.

Texts are handled as UTF-8 bytes.  A *word* is a maximal run of bytes outside
``\\x20`` and ``\\x09``-``\\x0D``, which is what ``bytes.split()`` yields.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import math
import sys
import uuid
from typing import Any, ClassVar

import numpy as np
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_root

U = np.uint64

#: 1 for the six ASCII white-space bytes.
SPACE = np.zeros(256, dtype=np.int8)
SPACE[[9, 10, 11, 12, 13, 32]] = 1


# --------------------------------------------------------------- scratch tables
class Scratch:
    """Parquet tables in the shared folder, each readable by every executor.

    A table is deleted by ``drop``, or else by a later ``Scratch`` once no plan in
    the driver refers to it any more (its file index is then collected), or at
    the end of the process.
    """

    #: path -> weak reference to the file index that all plans over that table share
    watched: ClassVar[dict[str, Any]] = {}

    def __init__(self, spark: SparkSession):
        self.spark = spark
        sweep(spark)
        self.root = f"{scratch_root(spark)}/scratch-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame, files: int | None = None) -> DataFrame:
        """Write and reread; ``files`` bounds how many files a small table gets."""
        self.n += 1
        path = f"{self.root}-{self.n}"
        (df.coalesce(files) if files else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        index = out._jdf.queryExecution().analyzed().collectLeaves().head().relation().location()
        self.watched[path] = self.spark._jvm.java.lang.ref.WeakReference(index)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for t in tables:
            _delete(self.spark, t._scratch_path)


def _delete(spark: SparkSession, path: str) -> None:
    Scratch.watched.pop(path, None)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def sweep(spark: SparkSession) -> None:
    """Delete the scratch tables that no plan refers to."""
    if Scratch.watched:
        gc.collect()  # plans that Python holds no more
        trim()
        spark._jvm.System.gc()
        for path in [path for path, index in Scratch.watched.items() if index.get() is None]:
            _delete(spark, path)


@atexit.register
def _forget() -> None:
    context = SparkContext._active_spark_context
    if context is not None and context._jsc is not None:
        spark = SparkSession.getActiveSession()
        for path in list(Scratch.watched) if spark else ():
            _delete(spark, path)


# ------------------------------------------------------------ memory of workers
def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Texts are long: send fewer of them to Python at once than the 10,000 of the default.

    The setting is read when a result is computed, after an operator has returned, so
    it stays; a smaller one is left as it is.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > rows:
        spark.conf.set(name, rows)


def trim() -> None:
    """Give freed memory back to the system: worker processes outlive their tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidy(run):
    """A function over Arrow batches that gives freed memory back at its end."""

    def over_batches(batches):
        yield from run(batches)
        trim()

    return over_batches


def tidy_group(run):
    """The same for a function over the table of a group, after each group."""

    def over_group(key, table):
        out = run(key, table)
        trim()
        return out

    return over_group


def tidy_cogroup(run):
    """The same for a function over both tables of a group."""

    def over_cogroup(key, left, right):
        out = run(key, left, right)
        trim()
        return out

    return over_cogroup


# ------------------------------------------------------------------- text bytes
def encoded(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null becomes the empty text."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, extended on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", self.base), ("down", self.inverse)):
                a = np.full(size, base, dtype=U)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


BYTE_POWERS = Powers(0x9E3779B97F4A7C15 | 1)
WORD_POWERS = Powers(0xD6E8FEB86659FD93 | 1)
#: For a second, independent hash.
OTHER_BYTE_POWERS = Powers(0xA0761D6478BD642F | 1)
OTHER_WORD_POWERS = Powers(0xE7037ED1A0B428DB | 1)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Rabin-Karp polynomial hash of values[start:end] for each span, from one prefix sum."""
    up, down = powers.get(len(values) + 1)
    prefix = np.zeros(len(values) + 1, dtype=U)
    np.cumsum((values.astype(U) + U(1)) * up[:-1], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * down[starts]
    return mix(h + (ends - starts).astype(U) * U(0xA24BAED4963EE407))


class Words:
    """Word boundaries and 64-bit word hashes of a list of texts."""

    def __init__(self, texts: list[bytes]):
        self.buffer = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", dtype=np.uint8)
        edge = np.diff(SPACE[self.buffer])
        self.starts, self.ends = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum(lengths + 1, out=offsets[1:])
        #: words of text i are first[i]:first[i + 1]
        self.first = np.searchsorted(self.starts, offsets + 1)

    def hashes(self, powers: Powers = BYTE_POWERS) -> np.ndarray:
        return span_hashes(self.buffer, self.starts, self.ends, powers)


def gathered(batches, limit: int):
    """Arrow batches put together until they hold ``limit`` bytes."""
    import pyarrow as pa

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def portions(texts: list[bytes], limit: int = 1_000_000):
    """Slices of the list holding about ``limit`` bytes each, so arrays stay small."""
    at, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= limit:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


# --------------------------------------------------------------- block exchange
# Looking something up for every word or window of a corpus by a plain join would
# shuffle one row for each of them.  Instead documents are dealt into blocks; each
# block sends its *distinct* keys, packed as one binary per bucket, to the buckets
# that own them, gets the answers back in the order it asked, and applies them to
# its own texts.  Keys arrive in a bucket at most once per block, however hot.


def in_blocks(docs: DataFrame, text: str, block_bytes: int = 8_000_000) -> tuple[DataFrame, int]:
    """(block INT, row STRUCT of all columns, body STRING) and the number of blocks.

    The block of a row depends on its content and its input partition, so equal
    rows in great number still spread.  The row rides along whole: extra columns,
    whatever their names, cannot clash with ours.
    """
    small_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`"))).alias("n")).first()["n"] or 0
    n = max(1, math.ceil(total / block_bytes))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    block = F.pmod(F.xxhash64(F.col(f"`{text}`"), F.spark_partition_id()), F.lit(n)).cast("int")
    return docs.select(block.alias("block"), row.alias("row")), n


def bucket_bits(n_blocks: int, keys_per_block: int, keys_per_bucket: int = 1_000_000) -> int:
    """Buckets are a power of two; the top bits of a key's hash name its bucket."""
    return max(0, math.ceil(math.log2(max(1.0, n_blocks * keys_per_block / keys_per_bucket))))


def bucket_edges(sorted_keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket begins in sorted 64-bit keys, and the end."""
    if bits == 0:
        return np.array([0, len(sorted_keys)])
    marks = np.arange(1, 1 << bits, dtype=U) << U(64 - bits)
    return np.concatenate(([0], np.searchsorted(sorted_keys, marks), [len(sorted_keys)]))


def group_sizes(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and the place where each begins."""
    if not len(sorted_keys):
        return sorted_keys, np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return sorted_keys[at], at


# --------------------------------------------------------- connected components
#: Edges that one task contracts at once.
CONTRACTED = 200_000


def _contract(batches):
    """The edges of one partition as stars around the smallest node of each component."""
    import pyarrow as pa

    parent: dict = {}

    def find(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    kind = None
    for b in batches:
        kind = b.column(0).type
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    if kind is not None:
        nodes = [x for x in parent if find(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], names=["a", "b"])


def components(scratch: Scratch, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that can be reached, for all nodes of ``edges(a, b)``.

    Each partition first contracts the edges it holds, a bounded number.  Then
    large-star and small-star steps alternate (each a grouped minimum and a join on
    the node, no group is gathered) until the edge set stays as it is; edges that
    came as one partition are done before.  Nodes may be of any orderable type;
    loops and repeated edges are harmless.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        # large-star looks at a node from both ends, small-star only at smaller neighbours
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        if large:
            out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
                least.select(F.col("u").alias("a"), F.col("m").alias("b"))
            )
        return out.filter(F.col("a") != F.col("b")).distinct()

    def digest(e: DataFrame):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    raw = scratch.save(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    parts = -(-raw.count() // CONTRACTED)
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in raw.schema)
    e = scratch.save(raw.coalesce(max(1, parts)).mapInArrow(_contract, shape))
    scratch.drop(raw)
    seen = digest(e) if parts > 1 else None
    for _ in range(max_rounds if parts > 1 else 0):
        new = scratch.save(star(star(e, True), False), files=1 + seen[0] // CONTRACTED)
        scratch.drop(e)
        e, before = new, seen
        seen = digest(e)
        if seen == before:
            break
    else:
        if parts > 1:
            raise RuntimeError("connected components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
