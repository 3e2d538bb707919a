"""Token ids as binary shards in training order.

Texts become token ids, ids become sequences of fixed length, and a keyed Feistel
permutation gives every sequence a slot of its own among all of them.  Slots are
dealt by range: a shard holds ``per_shard`` consecutive slots as records of equal
stride, so slot k stands at byte ``(k % per_shard) * stride`` of shard
``k // per_shard``.  A reader goes through the slots in order, can start at any
slot, and another epoch is another key.

A record is: document id (int64), number of the sequence in its document (int32),
tokens in use (int32), then ``length`` ids, zero beyond those in use; all
little-endian.  Ids have the 2 or 4 bytes that the vocabulary needs.

``training_order`` returns the shards as binary rows; ``write_shards`` makes one
file of each, under a name that appears only when the file is whole, so a writer
that is lost or started again repeats only what is missing.  ``read_slots`` reads
any range of slots from rows, ``ShardFiles`` from files, by seeking.

Every document ends with the end-of-text id.  Null texts are
empty and give one sequence that holds that id alone.  A null id is written as the
least int64.  Repeated rows give repeated sequences with slots of their own.  Extra
columns are not looked at.  An empty table gives no shard.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, U, encoded, mix, portions, small_batches

HEAD = np.dtype([("id", "<i8"), ("part", "<i4"), ("used", "<i4")])
NO_ID = -(2**63)


# ------------------------------------------------------------------- permutation
class Feistel:
    """A keyed permutation of 0 .. n - 1.

    Four rounds over an even number of bits permute the least power of four that
    holds n numbers; a value that falls outside walks on along its cycle until it
    comes back in, which on average takes less than four steps.
    """

    def __init__(self, n: int, key: bytes, rounds: int = 4):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        digest = hashlib.blake2b(key, digest_size=8 * rounds).digest()
        self.keys = np.frombuffer(digest, dtype="<u8")

    def _once(self, x: np.ndarray, keys) -> np.ndarray:
        mask = U((1 << self.half) - 1)
        left, right = x >> U(self.half), x & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        return left << U(self.half) | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        mask = U((1 << self.half) - 1)
        left, right = x >> U(self.half), x & mask
        for k in self.keys[::-1]:
            left, right = right ^ (mix(left + k) & mask), left
        return left << U(self.half) | right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        x = step(np.asarray(x).astype(U))
        out = np.flatnonzero(x >= U(self.n))
        while len(out):
            x[out] = step(x[out])
            out = out[x[out] >= U(self.n)]
        return x.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, lambda x: self._once(x, self.keys))

    def index(self, slot: np.ndarray) -> np.ndarray:
        """The inverse of ``slot``."""
        return self._walk(slot, self._back)


# --------------------------------------------------------------------- tokenizer
@lru_cache(maxsize=2)
def byte_pairs(ranks: bytes, pattern: str):
    """A byte-level merge tokenizer from a rank file; the id after the last ends a text."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


# ----------------------------------------------------------------------- shards
def id_bytes(ranks: bytes, end: int) -> int:
    """Bytes of an id, by the largest of a rank file and the one that ends a text."""
    most = max((int(x.rsplit(None, 1)[1]) for x in ranks.splitlines() if x.strip()), default=0)
    return 2 if max(most, end) < 1 << 16 else 4


def stride(length: int, width: int = 2) -> int:
    return HEAD.itemsize + width * length


def records(doc_id: int, ids: np.ndarray, end: int, length: int, width: int = 2) -> list[bytes]:
    """Fixed-stride records of one document; an id that needs more bytes is an error."""
    if max(end, int(ids.max(initial=0))) >> (8 * width):
        raise ValueError(f"a token id needs more than {width} bytes")
    used = len(ids) + 1
    n = -(-used // length)
    body = np.zeros((n, length), dtype=f"<u{width}")
    body.ravel()[: used - 1], body.ravel()[used - 1] = ids, end
    head = np.zeros(n, dtype=HEAD)
    head["id"], head["part"] = doc_id, np.arange(n)
    head["used"] = np.minimum(length, used - np.arange(n) * length)
    return [h.tobytes() + b.tobytes() for h, b in zip(head, body)]


def read_record(blob: bytes, width: int = 2):
    """(document id, number of the sequence, ids in use) of one record."""
    head = np.frombuffer(blob[: HEAD.itemsize], dtype=HEAD)[0]
    return int(head["id"]), int(head["part"]), np.frombuffer(blob[HEAD.itemsize :], dtype=f"<u{width}")[: head["used"]]


def training_order(
    docs: DataFrame,
    ranks: bytes,
    pattern: str,
    end: int,
    key: bytes = b"epoch-0",
    length: int = 512,
    per_shard: int = 2_048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(shard LONG, first_slot LONG, n_sequences LONG, n_tokens LONG, payload BINARY).

    Sequences are first written with the number of their input task and their place
    in it.  The tasks' counts, one number each, turn that into an index without a
    sort; the permutation turns the index into a slot.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    width = id_bytes(ranks, end)
    shared = spark.sparkContext.broadcast((ranks, pattern))  # the size of the vocabulary

    def write(batches):
        task, at = TaskContext.get().partitionId(), 0
        encoding = byte_pairs(*shared.value)
        for b in batches:
            names = b.column(0).to_pylist()
            texts = encoded(b.column(1))
            for lo, hi in portions(texts):
                out = []
                for i, t in zip(names[lo:hi], texts[lo:hi]):
                    out += records(NO_ID if i is None else int(i), encoding.encode_to_numpy(t.decode(), disallowed_special=()), end, length, width)
                place = np.arange(at, at + len(out), dtype=np.int64)
                at += len(out)
                yield pa.RecordBatch.from_arrays([pa.array([task] * len(out), pa.int32()), pa.array(place), pa.array(out, pa.binary())], names=["task", "place", "record"])

    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    written = scratch.save(plain.mapInArrow(write, "task int, place bigint, record binary"))
    # one number for each input task
    counts = {r["task"]: r["count"] for r in written.groupBy("task").count().collect()}
    total = sum(counts.values())
    first, at = np.zeros(max(counts, default=-1) + 1, dtype=np.int64), 0
    for task in sorted(counts):
        first[task] = at
        at += counts[task]
    order = Feistel(max(1, total), key)
    offsets = spark.sparkContext.broadcast(first)

    def place(batches):
        for b in batches:
            index = offsets.value[b.column(0).to_numpy()] + b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(order.slot(index)), b.column(2)], names=["slot", "record"])

    shards = -(-total // per_shard)
    tasks = max(1, min(shards, -(-total * stride(length, width) // 64_000_000), 100_000))
    per_task = -(-max(1, shards) // tasks) * per_shard  # whole shards
    slots = written.mapInArrow(place, "slot bigint, record binary")
    ranged = slots.repartitionById(tasks, (F.col("slot") / F.lit(per_task)).cast("int")).sortWithinPartitions("slot")

    def pack(batches):
        """Consecutive slots of a shard as one binary; at most a shard is held."""
        held, first_slot, used = [], None, 0

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((first_slot // per_shard, pa.int64()), (first_slot, pa.int64()), (len(held), pa.int64()), (used, pa.int64()), (b"".join(held), pa.binary()))],
                names=["shard", "first_slot", "n_sequences", "n_tokens", "payload"],
            )

        for b in batches:
            for slot, record in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if held and slot // per_shard != first_slot // per_shard:
                    yield flush()
                    held, used = [], 0
                if not held:
                    first_slot = slot
                held.append(record)
                used += int.from_bytes(record[12:16], "little")
        if held:
            yield flush()

    return ranged.mapInArrow(pack, "shard bigint, first_slot bigint, n_sequences bigint, n_tokens bigint, payload binary")


def read_slots(shards: DataFrame, first: int, last: int, length: int = 512, per_shard: int = 2_048, width: int = 2) -> DataFrame:
    """(slot, record) for the slots first .. last - 1; only their shards are read."""
    size = stride(length, width)
    near = shards.filter((F.col("shard") >= first // per_shard) & (F.col("shard") <= (last - 1) // per_shard))
    each = near.select("first_slot", "payload", F.explode(F.sequence(F.lit(0), (F.col("n_sequences") - 1).cast("int"))).alias("k"))
    found = each.select((F.col("first_slot") + F.col("k")).alias("slot"), F.substring("payload", F.col("k") * size + 1, F.lit(size)).alias("record"))
    return found.filter((F.col("slot") >= first) & (F.col("slot") < last))


# ------------------------------------------------------------------------ files
def shard_name(shard: int) -> str:
    return f"shard-{shard:010d}.bin"


def write_shards(shards: DataFrame, folder: str) -> DataFrame:
    """Write each shard as a file of ``folder`` and return (shard, first_slot, n_sequences, n_tokens, n_bytes, written).

    ``folder`` is a URI of a file system that all executors reach.  A file gets its
    name when it is whole; one that is there with its full length is left alone
    (``written`` is false), so the same call finishes what an earlier one began.
    The returned manifest is a table in ``folder``.  Nothing is written for an empty
    table but the empty manifest.
    """
    shape = "shard bigint, first_slot bigint, n_sequences bigint, n_tokens bigint, n_bytes bigint, written boolean"

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            size, fresh = [], []
            for shard, payload in zip(b.column(0).to_pylist(), b.column(4).to_pylist()):
                name = f"{root}/{shard_name(shard)}"
                size.append(len(payload))
                fresh.append(store.get_file_info(name).size != len(payload))
                if fresh[-1]:
                    own = f"{name}.{uuid.uuid4().hex}.part"
                    with store.open_output_stream(own) as out:
                        out.write(payload)
                    store.move(own, name)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(size, pa.int64()), pa.array(fresh, pa.bool_())], schema=b.schema.remove(4).append(pa.field("n_bytes", pa.int64())).append(pa.field("written", pa.bool_())))

    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    manifest = f"{folder.rstrip('/')}/manifest"
    spark = shards.sparkSession
    # a shard is about a megabyte: few rows at once
    small_batches(spark, 16)
    shards.select("shard", "first_slot", "n_sequences", "n_tokens", "payload").mapInArrow(run, shape).write.mode("overwrite").parquet(manifest)
    return spark.read.schema(shape).parquet(manifest)


class ShardFiles:
    """Records of the shard files of a folder, from any slot on, without reading those before."""

    def __init__(self, folder: str, length: int = 512, per_shard: int = 2_048, width: int = 2):
        from pyarrow import fs

        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.size, self.per_shard = stride(length, width), per_shard

    def read(self, first: int = 0, last: int | None = None):
        """(slot, record) for the slots first .. last - 1, or up to the end."""
        slot = first
        while last is None or slot < last:
            name = f"{self.root}/{shard_name(slot // self.per_shard)}"
            if not self.store.get_file_info(name).is_file:
                return
            with self.store.open_input_file(name) as f:
                f.seek(slot % self.per_shard * self.size)
                while (last is None or slot < last) and len(blob := f.read(self.size)) == self.size:
                    yield slot, blob
                    slot += 1
            if slot % self.per_shard:
                return
