"""Language-model scoring by context-tree weighting over bytes.

Each byte is eight binary decisions.  A decision is predicted in the context of
the ``depth`` bytes before it; every depth d from 0 to ``depth`` has a node for
(last d bytes, bits of this byte so far) with a Krichevsky-Trofimov estimate, and
the weighted probability of a node mixes its own estimate, half and half, with
the product of its children one byte deeper.  The weights that the training texts
leave at the nodes then give the predictive probability of any byte.

Counting and evaluation are exact and distributed: no node is pruned and no part
of the corpus is left out.  Blocks of documents send their distinct byte strings
of length depth + 1 with training counts to hash buckets; merged counts go to
branches by the last context byte and some bits of the one before (more bits for a
larger corpus, up to all eight), where subtrees are weighted; what lies
above depth 2 has at most 2**16 nodes of depth 1 and is finished once.  The log
probability of each distinct string returns to the blocks that asked for it.
Words are counted the same way for the unigram base score.

A text is preceded by ``depth`` zero bytes and ended by the byte 0xFF, which is
scored too, so probabilities of texts add up to 1.  Texts of any length are scored
whole.  Rows that repeat are learned from and scored once each; columns other than
id and text are not looked at, whatever their names; an empty table gives no rows.
Null texts are empty; rows
with a null id are training rows; an empty training set leaves all estimates at
one half.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Column
from pyspark.sql import functions as F

from .shared import U, Words, bucket_bits, bucket_edges, encoded, group_sizes, in_blocks, mix, portions

DEPTH = 5
#: Identity of the end token among word hashes.
END = np.array([0x5EED0E2D0F7EC57A], dtype=U)
LN2 = np.log(2.0)


# -------------------------------------------------------------------- arithmetic
def unmix(h: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``, which is a bijection."""
    h = h ^ (h >> U(31)) ^ (h >> U(62))
    h = h * U(pow(0x94D049BB133111EB, -1, 1 << 64))
    h = h ^ (h >> U(27)) ^ (h >> U(54))
    h = h * U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return h ^ (h >> U(30)) ^ (h >> U(60))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0: Stirling's series eight places up."""
    product = np.ones_like(x)
    for k in range(8):
        product = product * (x + k)
    z = x + 8
    r = 1 / (z * z)
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / z - np.log(product)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


# ------------------------------------------------------------------ byte strings
def byte_strings(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A key for every byte of every text and its end mark, and where each text begins.

    The key holds the context with the latest byte on top, then the byte itself,
    so strings that share their latest context bytes are neighbours when sorted.
    """
    pad = b"\0" * depth
    s = np.frombuffer(pad + (b"\xff" + pad).join(texts) + b"\xff", dtype=np.uint8)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    begin = np.zeros(len(texts), dtype=np.int64)
    np.cumsum(lengths[:-1], out=begin[1:])
    n = len(s) - depth
    key = np.zeros(n, dtype=U)
    for d in range(1, depth + 1):
        key <<= U(8)
        key |= s[depth - d : depth - d + n]
    key <<= U(8)
    key |= s[depth:]
    real = np.ones(n, dtype=bool)
    after = begin[1:] + depth * np.arange(len(texts) - 1)  # the pads between texts
    for d in range(depth):
        real[after + d] = False
    return key[real], begin


def tally(arrays: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum (keys, counts) pairs by key; keys come out sorted."""
    keys, counts = np.concatenate([k for k, _ in arrays]), np.concatenate([c for _, c in arrays])
    order = np.argsort(keys, kind="stable")
    distinct, at = group_sizes(keys[order])
    return distinct, np.add.reduceat(counts[order], at) if len(at) else counts


def counted(keys: np.ndarray, weight: int) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = group_sizes(np.sort(keys))
    return distinct, np.diff(np.append(at, len(keys))).astype(np.int64) * weight


class Places:
    """Exact position of hashed keys in a sorted array, by their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(len(keys) * 4).bit_length())
        slots = (keys >> U(64 - self.bits)).astype(np.int64)
        self.first = np.zeros((1 << self.bits) + 1, dtype=np.int32)
        np.cumsum(np.bincount(slots, minlength=1 << self.bits), out=self.first[1:])

    def of(self, wanted: np.ndarray) -> np.ndarray:
        """Every wanted key must be present."""
        at = self.first[(wanted >> U(64 - self.bits)).astype(np.int64)]
        off = np.flatnonzero(self.keys[at] != wanted)
        while len(off):
            at[off] += 1
            off = off[self.keys[at[off]] != wanted[off]]
        return at


# ------------------------------------------------------------------------- trees
def subtrees(keys: np.ndarray, counts: np.ndarray, depth: int, top: int):
    """Levels ``depth`` .. ``top`` over sorted distinct byte strings.

    Each level: (node keys, zeros, ones, ln weighted probability, weight of the own
    estimate, index of the node of each string and bit).
    """
    found = {}
    child = None
    for d in range(depth, top - 1, -1):
        if d == depth:
            strings, where, n = keys, np.arange(len(keys)), counts
        else:
            drop = U(8 * (depth - d) + 8)
            strings, where = np.unique((keys >> drop) << U(8) | keys & U(255), return_inverse=True)
            n = np.bincount(where, counts, len(strings))
        byte = (strings & U(255)).astype(np.int64)
        node = np.empty((len(strings), 8), dtype=U)
        for i in range(8):
            node[:, i] = (strings >> U(8) << U(8)) | ((1 << i) | (byte >> (8 - i))).astype(U)
        nodes, index = np.unique(node, return_inverse=True)
        index = index.reshape(node.shape)
        count = [np.zeros(len(nodes)), np.zeros(len(nodes))]
        for i in range(8):
            bit = byte >> (7 - i) & 1
            for b in (0, 1):
                count[b] += np.bincount(index[bit == b, i], n[bit == b], len(nodes))
        own = log_kt(*count)
        if child is None:
            weighted, weight = own, np.ones(len(nodes))
        else:
            parent = np.searchsorted(nodes, child[0] >> U(16) << U(8) | child[0] & U(255))
            below = np.bincount(parent, child[1], len(nodes))
            weighted = np.logaddexp(own, below) - LN2
            weight = np.exp(own - LN2 - weighted)
        child = (nodes, weighted)
        found[d] = (nodes, count[0], count[1], weighted, weight, index[where])
    return found


def node_summary(keys: np.ndarray, counts: np.ndarray, depth: int) -> dict[str, np.ndarray]:
    """Depth-2 nodes of a group summed by (last byte, bits so far)."""
    nodes, zeros, ones, weighted, _, _ = subtrees(keys, counts, depth, 2)[2]
    place = (nodes >> U(16) & U(255)).astype(np.int64) << 8 | (nodes & U(255)).astype(np.int64)
    used = np.unique(place)
    total = lambda x: np.bincount(place, x, 1 << 16)[used]
    return {"last": used >> 8, "prefix": used & 255, "zeros": total(zeros), "ones": total(ones), "below": total(weighted)}


def top_levels(last, prefix, zeros, ones, below):
    """Weight and estimate of a one at the nodes of depth 1 (256 x 256) and depth 0 (256)."""
    shape = (256, 256)
    n0, n1, s = (np.zeros(shape) for _ in range(3))
    np.add.at(n0, (last, prefix), zeros)
    np.add.at(n1, (last, prefix), ones)
    np.add.at(s, (last, prefix), below)
    out = []
    for _ in range(2):
        own = log_kt(n0, n1)
        weighted = np.logaddexp(own, s) - LN2
        out.append((np.exp(own - LN2 - weighted), (n1 + 0.5) / (n0 + n1 + 1)))
        n0, n1, s = n0.sum(axis=0), n1.sum(axis=0), weighted.sum(axis=0)
    return out


def string_scores(keys: np.ndarray, counts: np.ndarray, depth: int, upper) -> np.ndarray:
    """log10 of the predictive probability of the byte of each string in its context.

    ``upper(last)``: weight and estimate arrays of depth 1 for a last byte, and of depth 0.
    """
    levels = subtrees(keys, counts, depth, 2)
    byte = (keys & U(255)).astype(np.int64)
    last = (keys >> U(8 * depth) & U(255)).astype(np.int64)
    score = np.zeros(len(keys))
    for i in range(8):
        bit = byte >> (7 - i) & 1
        prefix = (1 << i) | (byte >> (8 - i))
        p = None
        for d in range(depth, 1, -1):
            _, zeros, ones, _, weight, index = levels[d]
            at = index[:, i]
            kt = (np.where(bit, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1)
            p = kt if p is None else weight[at] * kt + (1 - weight[at]) * p
        (w1, one1), (w0, one0) = upper
        for w, one in ((w1[last, prefix], one1[last, prefix]), (w0[prefix], one0[prefix])):
            p = w * np.where(bit, one, 1 - one) + (1 - w) * p
        score += np.log10(p)
    return score


# --------------------------------------------------------------------- operator
def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row.

    Rows where ``held_out`` is not true are learned from.  ``score`` is the log10
    probability of the lower-cased text; ``base_score`` that of its words and one
    end token under add-one unigram counts.  ``bits_per_byte`` is the code length of
    the text and its end mark for each of their bytes.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    blocks, n_blocks = in_blocks(plain, "text", 16_000_000)
    bits = bucket_bits(n_blocks, 600_000)
    split = min(8, 3 + max(0, (n_blocks // 64).bit_length()))
    strings_from = 1 << bits  # buckets of byte strings follow those of words

    def sides(table: pa.Table):
        """(texts, held out?) of a block, lower-cased."""
        row = table.column("row").combine_chunks()
        texts = [x.lower() for x in encoded(row.field("text"))] if len(row) else []
        return texts, np.array(row.field("held_out").to_pylist(), dtype=bool)

    def block_keys(texts, held):
        """Sorted distinct hashed keys with training counts, of words and of byte strings."""
        words = [(END, np.array([int((~held).sum())]))]
        strings = []
        for side, weight in ((~held, 1), (held, 0)):
            own = [t for t, s in zip(texts, side) if s]
            for lo, hi in portions(own):
                words.append(counted(Words(own[lo:hi]).hashes(), weight))
                strings.append(counted(byte_strings(own[lo:hi], depth)[0], weight))
        strings = tally(strings) if strings else (np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64))
        hashed = mix(strings[0])
        order = np.argsort(hashed)
        return tally(words), (hashed[order], strings[1][order])

    def ask(key, table):
        out = {"bucket": [], "block": [], "keys": [], "counts": []}
        for base, (keys, counts) in zip((0, strings_from), block_keys(*sides(table))):
            edges = bucket_edges(keys, bits)
            for b in np.flatnonzero(np.diff(edges)):
                out["bucket"].append(base + int(b))
                out["block"].append(key[0].as_py())
                out["keys"].append(keys[edges[b] : edges[b + 1]].tobytes())
                out["counts"].append(counts[edges[b] : edges[b + 1]].astype(np.uint32).tobytes())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))})

    def received(table: pa.Table):
        keys = [np.frombuffer(x, dtype=U) for x in table.column("keys").to_pylist()]
        counts = [np.frombuffer(x, dtype=np.uint32).astype(np.int64) for x in table.column("counts").to_pylist()]
        return keys, counts

    packed = pa.schema([("branch", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("tokens", pa.int64()), ("vocabulary", pa.int64())])

    def merge(key, table):
        """Corpus counts of a bucket: words as totals, byte strings by branch of the tree."""
        keys, counts = tally(list(zip(*received(table))))
        bucket = key[0].as_py()
        if bucket < strings_from:
            rows = [(-1, bucket, None, None, int(counts.sum()), int((counts > 0).sum()))]
        else:
            strings = unmix(keys)
            order = np.argsort(strings)
            strings, counts = strings[order], counts[order]
            branch = branch_of(strings)
            by = np.argsort(branch, kind="stable")
            names, at = group_sizes(branch[by])
            rows = [(int(n), bucket, strings[p].tobytes(), counts[p].tobytes(), None, None) for n, p in zip(names, np.split(by, at[1:]))]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), packed)], schema=packed)

    def branch_of(strings: np.ndarray) -> np.ndarray:
        """The last context byte and some bits of the one before."""
        before = (strings >> U(8 * depth - 8)).astype(np.int64) & ((1 << split) - 1)
        return (strings >> U(8 * depth) & U(255)).astype(np.int64) << split | before

    def branch_strings(table: pa.Table):
        return tally([(np.frombuffer(k, dtype=U), np.frombuffer(c, dtype=np.int64)) for k, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist())])

    summary_schema = "last int, prefix int, zeros double, ones double, below double, tokens bigint, vocabulary bigint"

    def summarise(key, table):
        if key[0].as_py() < 0:
            total = {c: [sum(table.column(c).to_pylist())] for c in ("tokens", "vocabulary")}
            found = {"last": [-1], "prefix": [0], "zeros": [0.0], "ones": [0.0], "below": [0.0]} | total
        else:
            found = node_summary(*branch_strings(table), depth)
            found |= {"tokens": [0] * len(found["last"]), "vocabulary": [0] * len(found["last"])}
        types = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(found.items(), types)})

    def finish(key, table):
        """At most 2**16 rows and the totals: depth 1 by last byte, and depth 0."""
        c = {x: table.column(x).to_numpy() for x in table.column_names}
        real = c["last"] >= 0
        (w1, one1), (w0, one0) = top_levels(*(c[x][real] for x in ("last", "prefix", "zeros", "ones", "below")))
        root = np.concatenate([w0, one0]).tobytes()
        return pa.table(
            {
                "last": pa.array(range(256), pa.int32()),
                "upper": pa.array([np.concatenate([w1[b], one1[b]]).tobytes() + root for b in range(256)], pa.binary()),
                "tokens": pa.array([int(c["tokens"].sum())] * 256, pa.int64()),
                "vocabulary": pa.array([int(c["vocabulary"].sum())] * 256, pa.int64()),
            }
        )

    def evaluate(key, left, right):
        branch = key[0].as_py()
        if branch < 0 or not left.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), "scores": pa.array([], pa.binary())})
        strings, counts = branch_strings(left)
        last = branch >> split
        u = np.frombuffer(right.column("upper")[0].as_py()).reshape(4, 256)
        w1, one1 = np.zeros((256, 256)), np.zeros((256, 256))
        w1[last], one1[last] = u[0], u[1]
        scores = string_scores(strings, counts, depth, ((w1, one1), (u[2], u[3])))
        hashed = mix(strings)
        order = np.argsort(hashed)
        hashed, scores = hashed[order], scores[order]
        edges = bucket_edges(hashed, bits)
        used = np.flatnonzero(np.diff(edges))
        cut = lambda x: pa.array([x[edges[b] : edges[b + 1]].tobytes() for b in used], pa.binary())
        return pa.table({"bucket": pa.array((used + strings_from).astype(np.int32)), "keys": cut(hashed), "scores": cut(scores)})

    def answer(key, left, right):
        """For each block, in the order of its keys: counts of words, scores of byte strings."""
        keys, counts = received(left)
        if key[0].as_py() < strings_from:
            known, values = tally(list(zip(keys, counts)))
        else:
            known = np.concatenate([np.frombuffer(x, dtype=U) for x in right.column("keys").to_pylist()])
            values = np.concatenate([np.frombuffer(x, dtype=np.float64) for x in right.column("scores").to_pylist()])
            order = np.argsort(known)
            known, values = known[order], values[order]
        found = [values[np.searchsorted(known, k)].tobytes() for k in keys]
        return pa.table({"block": left.column("block"), "bucket": left.column("bucket"), "values": pa.array(found, pa.binary())})

    def apply(key, left, right):
        texts, held = sides(left)
        (word_keys, _), (string_keys, _) = block_keys(texts, held)
        blobs = sorted(zip(right.column("bucket").to_pylist(), right.column("values").to_pylist()))
        counts = np.frombuffer(b"".join(v for b, v in blobs if b < strings_from), dtype=np.int64)
        scores = np.frombuffer(b"".join(v for b, v in blobs if b >= strings_from), dtype=np.float64)
        word_at, string_at = Places(word_keys), Places(string_keys)
        end = counts[word_at.of(END)][0]
        n_tokens, n_known, base, total = [], [], [], []
        for lo, hi in portions(texts):
            own = texts[lo:hi]
            w = Words(own)
            c = counts[word_at.of(w.hashes())]
            sums = lambda x: np.concatenate(([0], np.cumsum(x)))
            of_texts = lambda s: np.diff(s[w.first])
            n_tokens.append(np.diff(w.first) + 1)
            n_known.append(of_texts(sums(c > 0)) + (end > 0))
            base.append(of_texts(sums(np.log10(c + 1.0))) + np.log10(end + 1.0))
            strings, begin = byte_strings(own, depth)
            total.append(np.add.reduceat(scores[string_at.of(mix(strings))], begin))
        row = left.column("row").combine_chunks()
        together = lambda x: np.concatenate(x) if x else np.zeros(0)
        return pa.table(
            {
                "id": row.field("id"),
                "held_out": row.field("held_out"),
                "n_tokens": pa.array(together(n_tokens).astype(np.int64)),
                "n_known": pa.array(together(n_known).astype(np.int64)),
                "logs": pa.array(together(base).astype(np.float64)),
                "score": pa.array(together(total).astype(np.float64)),
                "n_bytes": pa.array([len(t) + 1 for t in texts], pa.int64()),
            }
        )

    asked = blocks.groupBy("block").applyInArrow(ask, "bucket int, block int, keys binary, counts binary")
    merged = asked.groupBy("bucket").applyInArrow(merge, "branch int, bucket int, keys binary, counts binary, tokens bigint, vocabulary bigint")
    summed = (
        merged.groupBy("branch")
        .applyInArrow(summarise, summary_schema)
        .groupBy("last", "prefix")
        .agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below", "tokens", "vocabulary")])
    )
    upper = summed.groupBy(F.lit(0).alias("all")).applyInArrow(finish, "last int, upper binary, tokens bigint, vocabulary bigint")
    per_branch = upper.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit((1 << split) - 1)), lambda k: F.col("last") * (1 << split) + k)).alias("branch"), "upper")
    evaluated = merged.groupBy("branch").cogroup(per_branch.groupBy("branch")).applyInArrow(evaluate, "bucket int, keys binary, scores binary")
    answers = asked.groupBy("bucket").cogroup(evaluated.groupBy("bucket")).applyInArrow(answer, "block int, bucket int, values binary")
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(apply, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, logs double, score double, n_bytes bigint")
    totals = upper.filter("last = 0").select(F.col("tokens").alias("train_tokens"), "vocabulary")  # one row
    each = F.log10(F.col("train_tokens") + F.col("vocabulary") + F.lit(1))
    return scored.crossJoin(F.broadcast(totals)).select(
        "id", "held_out", "n_tokens", "n_known", "train_tokens", (F.col("logs") - F.col("n_tokens") * each).alias("base_score"), "score", (F.col("score") / (F.lit(-math.log10(2)) * F.col("n_bytes"))).alias("bits_per_byte")
    )
