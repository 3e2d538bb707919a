"""Substring dedup: words covered by a window of words that occurs elsewhere.

Every window of ``width`` consecutive words gets a Rabin-Karp hash.  Blocks of
documents send their distinct window hashes to the buckets that own them, where
they are counted over the corpus.  A bucket is named by the leading bits, so five
more bytes of a hash are enough to tell which windows seem repeated.  Those are
counted once more by a second hash of other bases, and each block merges the
windows that are confirmed into maximal removal intervals.

Windows are judged on the input, within one document each, and both (all)
occurrences of a repeated window go.  Null and empty texts have no words; texts
shorter than a window lose nothing; repeated rows repeat each other's windows.
Extra columns of any name pass through.  An empty table gives an empty result.
Very long texts are handled as a whole.  A window that is not repeated is taken for
one only if its second hash equals that of a confirmed window of its own block: among
n windows, m of them confirmed in a block, that is expected n*m / 2**64 times.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import (
    BYTE_POWERS,
    OTHER_BYTE_POWERS,
    OTHER_WORD_POWERS,
    U,
    WORD_POWERS,
    Words,
    bucket_bits,
    bucket_edges,
    encoded,
    group_sizes,
    in_blocks,
    portions,
    span_hashes,
    tidy_cogroup,
    tidy_group,
)


def _shorten(hashes: np.ndarray, size: int) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _shortened(blob: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(blob) // size, 8), dtype=np.uint8)
    out[:, :size] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, size)
    return out.view("<u8").ravel()


def _windows(words: Words, width: int, other: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word of every window, and the window's hash or its ``other`` one."""
    count = np.diff(words.first)
    total = len(words.starts)
    if total < width:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)
    left = np.repeat(words.first[1:], count) - np.arange(total)  # words from here to the end of the text
    at = np.flatnonzero(left >= width)
    of_bytes, of_words = (OTHER_BYTE_POWERS, OTHER_WORD_POWERS) if other else (BYTE_POWERS, WORD_POWERS)
    return at, span_hashes(words.hashes(of_bytes), at, at + width, of_words)


def _block_keys(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct window hashes of a block and whether each occurs in it twice."""
    parts = []
    for lo, hi in portions(texts):
        parts.append(_windows(Words(texts[lo:hi]), width)[1])
    h = np.sort(np.concatenate(parts)) if parts else np.zeros(0, dtype=U)
    keys, at = group_sizes(h)
    return keys, np.diff(np.append(at, len(h))) > 1


def _pack(flags: np.ndarray) -> bytes:
    return np.packbits(flags, bitorder="little").tobytes()


def _unpack(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, dtype=np.uint8), count=n, bitorder="little").astype(bool)


def _member(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(wanted), dtype=bool)
    at = np.searchsorted(sorted_keys, wanted)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == wanted


def _intervals(covered: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of covered words as (first, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


ROW_OUT = "n_words bigint, n_removed bigint, intervals array<struct<first:bigint,end:bigint>>, kept string, kept_sha256 string"


def remove_repeated_windows(docs: DataFrame, text_col: str = "text", width: int = 35, with_text: bool = True, short: int = 5) -> DataFrame:
    """(row STRUCT of all columns, n_words, n_removed, intervals, kept, kept_sha256).

    ``intervals`` are the removed runs of words; ``kept`` joins the other words by
    one space (null unless ``with_text``) and ``kept_sha256`` is its digest.
    ``short``: how many bytes of a hash travel besides its bucket at first.
    """
    blocks, n_blocks = in_blocks(docs, text_col)
    bits = bucket_bits(n_blocks, 1_300_000)
    row_type = T.StructType([T.StructField("row", blocks.schema["row"].dataType)])

    def texts_of(table: pa.Table) -> list[bytes]:
        row = table.column("row").combine_chunks()
        return encoded(row.field(text_col)) if len(row) else []

    def ask(key, table):
        keys, twice = _block_keys(texts_of(table), width)
        edges = bucket_edges(keys, bits)
        used = np.flatnonzero(np.diff(edges))
        return pa.table(
            {
                "bucket": pa.array(used.astype(np.int32)),
                "block": pa.array([key[0].as_py()] * len(used), pa.int32()),
                "keys": pa.array([_shorten(keys[edges[b] : edges[b + 1]], short) for b in used], pa.binary()),
                "twice": pa.array([_pack(twice[edges[b] : edges[b + 1]]) for b in used], pa.binary()),
            }
        )

    def count(key, table):
        blobs = [_shortened(x, short) for x in table.column("keys").to_pylist()]
        twice = [_unpack(x, len(k)) for x, k in zip(table.column("twice").to_pylist(), blobs)]
        h = np.sort(np.concatenate(blobs))
        keys, at = group_sizes(h)
        again = keys[np.diff(np.append(at, len(h))) > 1]
        again = np.union1d(again, np.concatenate([k[t] for k, t in zip(blobs, twice)]))
        flags = [_member(again, k) for k in blobs]
        use = [i for i, f in enumerate(flags) if f.any()]
        return pa.table(
            {
                "bucket": pa.array([key[0].as_py()] * len(use), pa.int32()),
                "block": table.column("block").combine_chunks().take(pa.array(use, pa.int64())),
                "flags": pa.array([_pack(flags[i]) for i in use], pa.binary()),
            }
        )

    def ask_again(key, left, right):
        """The second hashes of the windows that seem repeated, and whether the block has them twice."""
        out = {"bucket": [], "block": [], "others": [], "twice": []}
        if right.num_rows:
            texts = texts_of(left)
            keys, _ = _block_keys(texts, width)
            edges = bucket_edges(keys, bits)
            hot = []
            for b, blob in sorted(zip(right.column("bucket").to_pylist(), right.column("flags").to_pylist())):
                own = keys[edges[b] : edges[b + 1]]
                hot.append(own[_unpack(blob, len(own))])
            del keys
            hot, found = np.concatenate(hot), []
            for lo, hi in portions(texts):
                w = Words(texts[lo:hi])
                some = _member(hot, _windows(w, width)[1])
                if some.any():
                    found.append(_windows(w, width, other=True)[1][some])
            found = np.sort(np.concatenate(found))
            others, at = group_sizes(found)
            twice = np.diff(np.append(at, len(found))) > 1
            edges = bucket_edges(others, bits)
            for b in np.flatnonzero(np.diff(edges)):
                out["bucket"].append(int(b))
                out["block"].append(key[0].as_py())
                out["others"].append(others[edges[b] : edges[b + 1]].tobytes())
                out["twice"].append(_pack(twice[edges[b] : edges[b + 1]]))
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))})

    def confirm(key, table):
        """For each block, those of its second hashes that are repeated."""
        blobs = [np.frombuffer(x, dtype=U) for x in table.column("others").to_pylist()]
        twice = [k[_unpack(x, len(k))] for x, k in zip(table.column("twice").to_pylist(), blobs)]
        h = np.sort(np.concatenate(blobs + twice))
        keys, at = group_sizes(h)
        again = keys[np.diff(np.append(at, len(h))) > 1]
        return pa.table({"block": table.column("block"), "others": pa.array([k[_member(again, k)].tobytes() for k in blobs], pa.binary())})

    def cut(key, left, right):
        texts = texts_of(left)
        hot = np.sort(np.frombuffer(b"".join(right.column("others").to_pylist()), dtype=U))
        out = {"n_words": [], "n_removed": [], "intervals": [], "kept": [], "kept_sha256": []}
        for lo, hi in portions(texts):
            w = Words(texts[lo:hi])
            covered = np.zeros(len(w.starts) + 1, dtype=np.int64)
            if len(hot):
                at, h = _windows(w, width, other=True)
                at = at[_member(hot, h)]
                covered[at] += 1
                np.subtract.at(covered, at + width, 1)
            covered = np.cumsum(covered[:-1]) > 0
            for i in range(hi - lo):
                mine = covered[w.first[i] : w.first[i + 1]]
                words = texts[lo + i].split()
                gone = int(mine.sum())
                if gone:
                    words = [x for x, c in zip(words, mine.tolist()) if not c]
                kept = b" ".join(words)
                out["n_words"].append(len(mine))
                out["n_removed"].append(gone)
                out["intervals"].append([{"first": a, "end": b} for a, b in _intervals(mine)] if gone else [])
                out["kept"].append(kept.decode() if with_text else None)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])), pa.string(), pa.string()]
        return pa.table({"row": left.column("row"), **{k: pa.array(v, t) for (k, v), t in zip(out.items(), types)}})

    asked = blocks.groupBy("block").applyInArrow(tidy_group(ask), "bucket int, block int, keys binary, twice binary")
    answers = asked.groupBy("bucket").applyInArrow(tidy_group(count), "bucket int, block int, flags binary")
    seeming = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tidy_cogroup(ask_again), "bucket int, block int, others binary, twice binary")
    repeated = seeming.groupBy("bucket").applyInArrow(tidy_group(confirm), "block int, others binary")
    schema = T.StructType(row_type.fields + T._parse_datatype_string(ROW_OUT).fields)
    return blocks.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(tidy_cogroup(cut), schema)
