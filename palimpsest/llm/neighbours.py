"""Nearest-neighbour searches of stated queries against all rows.

``voronoi_top_k``      exact, largest inner product of integer vectors
``cross_polytope_top_k``  approximate, largest cosine

Rows whose vector is null, empty or holds null or non-finite components take no
part, nor do rows with a null id, nor rows whose vector has another length than
the most frequent one (the longer, at a tie).  For the cosine, zero vectors take
no part either.  A query's candidates are all rows with another id.  Repeated
candidate rows each count; of query rows that share an id, the least vector is
searched.  Fewer candidates than k: all of them.  Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

RESULT = "query_id {id}, vec_id {id}, score {score}"


def valid_vectors(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, v ARRAY<DOUBLE>) of the rows that take part, and their dimension (0: none)."""
    inf = F.lit(float("inf"))
    v = F.col(vec_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    found = rows.select(F.col(id_col).alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(good)
    top = found.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dim = top["n"] if top else 0
    return found.filter(F.size("v") == dim), dim


def matrix(column, dim: int) -> np.ndarray:
    """An Arrow list column of equal lengths as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def best(scores: np.ndarray, ids: np.ndarray, own, k: int, slack: float = 0.0) -> np.ndarray:
    """Positions that can be among the k best of one query; ids are sorted ascending."""
    ok = np.flatnonzero(ids != own)
    if len(ok) > k:
        s = scores[ok]
        ok = ok[s >= np.partition(s, len(s) - k)[len(s) - k] - slack]
    return ok


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k largest scores of each query, ties to the smaller id, numbered from 1."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(w).alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def as_queries(found: DataFrame, is_query: Column) -> DataFrame:
    return found.filter(is_query).groupBy("id").agg(F.min("v").alias("v"))


# -------------------------------------------------------------- exact: Voronoi
def voronoi_top_k(
    rows: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 5,
    scale: float = 256.0,
    pivots: int = 64,
    query_block: int = 2_048,
    data_block: int = 20_000,
) -> DataFrame:
    """(query_id, rank INT, vec_id, score LONG) by inner product of floor(scale * v).

    Largest inner product becomes nearest distance by one more component that
    lifts all data to a common norm.  Data and queries belong to the cell of their
    nearest pivot (``pivots`` rows, the first by a hash of the id).  From the k + 1
    smallest pivot distances of different ids in each data cell follows, for each
    query cell, a distance within which all its queries find k + 1 ids, so k rows
    besides their own however often an id repeats.  By the
    triangle inequality a data row is sent only to the query cells that it can
    reach within that distance.  Query cells travel in blocks, data in chunks, and
    each pair of them is solved by one matrix product.

    Products are exact while dimension * max|component|**2 < 2**53; beyond, integers
    of any size are used and scores are held within 64 bits.
    """
    found, dim = valid_vectors(rows, id_col, vec_col)
    kind = found.schema["id"].dataType.simpleString()
    schema = RESULT.format(id=kind, score="bigint")
    whole = found.select("id", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("double")).alias("v"))
    if not dim:
        return ranked(rows.sparkSession.createDataFrame([], schema), k)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    facts = whole.agg(F.max(square).alias("m"), F.max(F.array_max(F.transform("v", F.abs))).alias("c")).first()
    longest, exact = facts["m"], dim * facts["c"] ** 2 < 2**53

    def lifted(x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))
        return np.concatenate([x, rest[:, None]], axis=1)

    chosen = whole.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").collect()
    p = lifted(np.unique(np.array([r["v"] for r in chosen]), axis=0))
    between = np.sqrt(np.maximum(((p[:, None] - p[None]) ** 2).sum(axis=2), 0))

    def nearest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * x @ p.T, 0))
        cell = np.argmin(d, axis=1)
        return cell, np.sqrt(((x - p[cell]) ** 2).sum(axis=1))

    def assign(lift):
        def run(batches):
            for b in batches:
                x = matrix(b.column(1), dim)
                cell, far = nearest(lift(x))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(far)], names=["id", "v", "cell", "far"])

        return run

    shape = f"id {kind}, v array<double>, cell int, far double"
    data = whole.mapInArrow(assign(lifted), shape)
    flat = lambda x: np.concatenate([x, np.zeros((len(x), 1))], axis=1)
    queries = as_queries(whole, is_query).mapInArrow(assign(flat), shape)

    # summaries: a few numbers for each of the bounded number of cells
    near = Window.partitionBy("cell").orderBy("far")
    of_data = data.select("cell", "id", "far")
    size = {r["cell"]: r for r in of_data.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    first: dict[int, list[tuple]] = {}
    nearest_of = of_data.groupBy("cell", "id").agg(F.min("far").alias("far"))
    for r in nearest_of.withColumn("r", F.row_number().over(near)).filter(F.col("r") <= k + 1).collect():
        first.setdefault(r["cell"], []).append((r["id"], r["far"]))
    asked = {r["cell"]: r for r in queries.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}

    margin = 1e-9 * (1 + math.sqrt(longest)) + 1e-6
    reach, base, blocks, chunks = {}, {}, {}, {}
    at = 0
    for i, q in sorted(asked.items()):
        bound: dict = {}
        for j, ds in first.items():
            for x, d in ds:
                bound[x] = min(bound.get(x, math.inf), q["far"] + between[i, j] + d)
        upper = sorted(bound.values())
        limit = upper[k] if len(upper) > k else math.inf
        reach[i] = limit + q["far"] + margin  # a row is sent if |p_i p_j| - far <= reach
        base[i], blocks[i] = at, math.ceil(q["n"] / query_block)
        sent = sum(s["n"] for s in size.values())
        chunks[i] = max(1, math.ceil(sent / data_block))
        at += blocks[i]
    # small query cells share a block, so that data is not sent to each of them alone
    shared, room = 0, query_block
    for i, q in sorted(asked.items()):
        if blocks[i] == 1:
            if q["n"] > room:
                shared, room = shared + 1, query_block
            base[i] = at + shared
            room -= q["n"]
    parts = max(chunks.values(), default=1)
    cells = sorted(asked)
    limits = np.array([reach[i] for i in cells])

    def route(batches):
        """Each row once for every block that has a query cell within reach."""
        for b in batches:
            cell, far = b.column(2).to_numpy(), b.column(3).to_numpy()
            # |far - |p_i p_j|| - radius_i <= limit_i, both ends of the triangle inequality
            need = np.abs(between[cell][:, cells] - far[:, None]) <= limits
            taken: dict[int, np.ndarray] = {}
            for c, i in enumerate(cells):
                for g in range(base[i], base[i] + blocks[i]):
                    taken[g] = taken[g] | need[:, c] if g in taken else need[:, c]
            for g, mask in taken.items():
                some = b.select([0, 1]).filter(pa.array(mask))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.full(some.num_rows, g, dtype=np.int32))], names=["id", "v", "block"])

    chunk = F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int").alias("chunk")
    sent = data.mapInArrow(route, f"id {kind}, v array<double>, block int").select("id", "v", "block", chunk)
    if not cells:
        return ranked(rows.sparkSession.createDataFrame([], schema), k)
    table = F.create_map(*[x for i in cells for x in (F.lit(i), F.struct(F.lit(base[i]).alias("base"), F.lit(blocks[i]).alias("n")))])
    own = table[F.col("cell")]
    block = (own["base"] + F.pmod(F.xxhash64("id"), own["n"])).cast("int").alias("block")
    spread = queries.select("id", "v", block, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("chunk"))

    def solve(key, left, right):
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            q_ids, ids = left.column("id").to_numpy(), right.column("id").to_numpy()
            q, x = matrix(left.column("v"), dim), matrix(right.column("v"), dim)
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            if not exact:
                q, x = (np.array([[int(c) for c in r] for r in a], dtype=object) for a in (q, x))
            for lo in range(0, len(q), 256):
                s = q[lo : lo + 256] @ x.T
                for i, row in enumerate(s):
                    if not exact:
                        row = np.array([min(max(c, -(2**63)), 2**63 - 1) for c in row], dtype=np.int64)
                    hit = best(row, ids, q_ids[lo + i], k)
                    hit = hit[np.lexsort((hit, -row[hit]))][:k]
                    out[0].append(np.full(len(hit), q_ids[lo + i]))
                    out[1].append(ids[hit])
                    out[2].append(row[hit].astype(np.int64))
        types = (left.schema.field("id").type, right.schema.field("id").type, pa.int64())
        return pa.table([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, types)], names=["query_id", "vec_id", "score"])

    pairs = spread.groupBy("block", "chunk").cogroup(sent.groupBy("block", "chunk")).applyInArrow(solve, schema)
    return ranked(pairs, k)


# ---------------------------------------------------- approximate: cross-polytope
def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / math.sqrt(d)


def rotated(unit: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Pseudo-random rotation: three rounds of sign flips and a Hadamard transform."""
    x = np.zeros((len(unit), signs.shape[1]))
    x[:, : unit.shape[1]] = unit
    for s in signs:
        x = hadamard(x * s)
    return x


class Axes:
    """``tables`` hashes, each naming the nearest signed axis in ``depth`` pseudo-rotations."""

    #: Combinations of axes that are ranked in one table at most.
    RANKED = 4_096

    def __init__(self, dim: int, rows: int, tables: int, seed: int):
        self.dim, self.tables = dim, tables
        width = 1 << max(0, dim - 1).bit_length()
        self.sides = 2 * width
        # as many axes as give about one row a bucket; their numbers fit into 62 bits
        side_bits = math.log2(self.sides)
        self.depth = min(int(62 // side_bits), max(2, round(math.log2(max(2, rows)) / side_bits)))
        self.near = min(self.sides, max(1, int(self.RANKED ** (1 / self.depth) + 1e-9)))
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, self.depth, 3, width))

    def projections(self, v: np.ndarray):
        """For each table and rotation, the components along all signed axes."""
        v = v / np.abs(v).max(axis=1, keepdims=True)
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        for of_table in self.signs:
            found = []
            for s in of_table:
                x = rotated(unit, s)
                found.append(np.concatenate([x, -x], axis=1))
            yield found

    def codes(self, v: np.ndarray) -> np.ndarray:
        """The bucket of each row in each table."""
        out = np.zeros((len(v), self.tables), dtype=np.int64)
        for t, found in enumerate(self.projections(v)):
            for x in found:
                out[:, t] = out[:, t] * self.sides + np.argmax(x, axis=1)
        return out

    def ranked(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, scores), each by row, table and combination of axes near to it.

        The score of a bucket is the sum of the row's components along its axes.
        """
        all_codes, all_scores = [], []
        for found in self.projections(v):
            codes, scores = np.zeros((len(v), 1), dtype=np.int64), np.zeros((len(v), 1))
            for x in found:
                axes = np.argsort(-x, axis=1, kind="stable")[:, : self.near]
                parts = np.take_along_axis(x, axes, axis=1)
                codes = (codes[:, :, None] * self.sides + axes[:, None, :]).reshape(len(v), -1)
                scores = (scores[:, :, None] + parts[:, None, :]).reshape(len(v), -1)
            all_codes.append(codes)
            all_scores.append(scores)
        return np.stack(all_codes, axis=1), np.stack(all_scores, axis=1)


def probes_needed(axes: Axes, queries: np.ndarray, neighbours: list[np.ndarray], target: float) -> int:
    """How many buckets, best score first over all tables, hold ``target`` of the neighbours.

    ``neighbours``: for each query the codes of its true neighbours, one row each.
    """
    needed = []
    for q, codes in zip(queries, neighbours):
        own, score = (x[0] for x in axes.ranked(q[None]))
        order = np.sort(-score.ravel())
        for row in codes:
            best = score[own == row[:, None]].max(initial=-np.inf)
            needed.append(np.searchsorted(order, -best, side="right") if best > -np.inf else score.size)
    if not needed:
        return 1
    return int(np.sort(needed)[max(0, math.ceil(target * len(needed)) - 1)])


def exact_pairs(k: int):
    """A function of (key, queries, rows), both (id, v): the k rows of largest cosine for each query."""

    def solve(key, queries, mine):
        out: tuple[list, list, list] = ([], [], [])
        if queries.num_rows and mine.num_rows:
            dim = len(mine.column("v")[0])
            q_ids, ids = queries.column("id").to_numpy(), mine.column("id").to_numpy()
            q, x = matrix(queries.column("v"), dim), matrix(mine.column("v"), dim)
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            nq, nx = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
            for lo in range(0, len(q), 256):
                rough = (q[lo : lo + 256] / nq[lo : lo + 256, None]) @ (x / nx[:, None]).T
                for i, row in enumerate(rough):
                    hit = best(row, ids, q_ids[lo + i], k, 1e-9)
                    fine = (x[hit] * q[lo + i]).sum(axis=1) / (nx[hit] * nq[lo + i])
                    top = np.lexsort((hit, -fine))[:k]
                    out[0].append(np.full(len(top), q_ids[lo + i]))
                    out[1].append(ids[hit[top]])
                    out[2].append(fine[top])
        types = (queries.schema.field("id").type, mine.schema.field("id").type, pa.float64())
        return pa.table([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, types)], names=["query_id", "vec_id", "score"])

    return solve


def cross_polytope_candidates(
    scratch: Scratch, found: DataFrame, asked: DataFrame, dim: int, k: int, tables: int, sample: int, target: float, seed: int, blocks: int, part_rows: int, query_block: int
) -> tuple[DataFrame, DataFrame]:
    """(index, candidates): ``index(id, v, rid)`` numbers the rows, ``candidates(query_id,
    block, rids BINARY)`` lists the numbers that a query has to compare, by ``rid % blocks``.
    """
    n, n_asked = found.count(), asked.count()
    kind = found.schema["id"].dataType.simpleString()
    axes = Axes(dim, n, tables, seed)

    def hashed(batches):
        for b in batches:
            if b.num_rows:
                codes = axes.codes(matrix(b.column(1), dim))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, tables), pa.int32()), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], names=["id", "v", "codes"])

    coded = found.select("id", "v").mapInArrow(hashed, f"id {kind}, v array<double>, codes array<bigint>")
    index = scratch.save(coded.withColumn("rid", F.monotonically_increasing_id()))

    # a bounded number of queries is compared with all rows to learn how many buckets to look into
    tried = asked.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    tried_ids, tried_v = [r["id"] for r in tried], np.array([r["v"] for r in tried]).reshape(-1, dim)
    length = np.sqrt((tried_v * tried_v).sum(axis=1))

    def nearest(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(1), dim)
            cosine = (tried_v / length[:, None]) @ (x / np.sqrt((x * x).sum(axis=1))[:, None]).T
            for q, row in enumerate(cosine):
                hit = best(row, ids, tried_ids[q], k)
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(hit), pa.int32()), pa.array(row[hit]), b.column(2).take(pa.array(hit))], names=["q", "score", "codes"])

    w = Window.partitionBy("q").orderBy(F.desc("score"))
    near = index.select("id", "v", "codes").mapInArrow(nearest, "q int, score double, codes array<bigint>")
    true: list[list] = [[] for _ in tried]
    for r in near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).collect():  # at most sample * k rows
        true[r["q"]].append(r["codes"])
    n_probes = probes_needed(axes, tried_v, [np.array(x, dtype=np.int64).reshape(-1, tables) for x in true], target)
    parts = max(1, math.ceil(n / part_rows))

    def probed(batches):
        """For each query, table and part of its buckets: the buckets to look into."""
        for b in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            v = matrix(b.column(1), dim) if b.num_rows else ()
            for q, i in zip(v, b.column(0).to_pylist()):
                codes, scores = (x[0].ravel() for x in axes.ranked(q[None]))
                take = np.argpartition(-scores, n_probes - 1)[:n_probes] if n_probes < len(scores) else np.arange(len(scores))
                table, code = take // (len(scores) // tables), codes[take]
                place = table * parts + code % parts
                order = np.argsort(place, kind="stable")
                names, at = np.unique(place[order], return_index=True)
                for p, c in zip(names.tolist(), np.split(code[order], at[1:])):
                    for column, x in zip(out, (i, p // parts, p % parts, c.tobytes())):
                        column.append(x)
            types = (b.schema.field(0).type, pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["id", "t", "part", "codes"])

    # full parts are dealt into slices by the number of the row; a part has its share of the buckets
    entries = index.select("rid", "id", F.xxhash64("v").alias("same"), F.posexplode("codes").alias("t", "code")).withColumn("part", (F.col("code") % parts).cast("int"))
    counted = entries.groupBy("t", "part").agg(F.count("*").alias("n"))
    slices = F.broadcast(counted.select("t", "part", F.ceil(F.col("n") / part_rows).cast("int").alias("dn")))  # tables * parts numbers
    groups = F.lit(max(1, math.ceil(n_asked / query_block)))
    qp = F.pmod(F.xxhash64("id"), groups).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), c - 1))
    left = asked.select("id", "v").mapInArrow(probed, f"id {kind}, t int, part int, codes binary").join(slices, ["t", "part"])
    left = left.select("id", "t", "part", "codes", qp.alias("qp"), each(F.col("dn")).alias("dp"))
    right = entries.join(slices, ["t", "part"]).select("rid", "id", "same", "code", "t", "part", F.pmod(F.xxhash64("rid"), F.col("dn")).cast("int").alias("dp"), each(groups).alias("qp"))

    def collide(key, queries, mine):
        out: tuple[list, list, list] = ([], [], [])
        if queries.num_rows and mine.num_rows:
            code, rid, same, ids = (mine.column(c).to_numpy() for c in ("code", "rid", "same", "id"))
            order = np.lexsort((rid, ids, same, code))
            code, rid, same = code[order], rid[order], same[order]
            # of rows with one vector, k rows each of the k + 1 smallest ids are enough
            ids = ids[order]
            new = np.concatenate(([True], (code[1:] != code[:-1]) | (same[1:] != same[:-1])))
            fresh = new | np.concatenate(([True], ids[1:] != ids[:-1]))
            since = lambda flags: np.maximum.accumulate(np.where(flags, np.arange(len(flags)), 0))
            nth_id = np.cumsum(fresh) - np.cumsum(fresh)[since(new)]
            few = (nth_id <= k) & (np.arange(len(code)) - since(fresh) < k)
            code, rid = code[few], rid[few]
            for i, blob in zip(queries.column("id").to_pylist(), queries.column("codes").to_pylist()):
                wanted = np.frombuffer(blob, dtype=np.int64)
                lo, hi = np.searchsorted(code, wanted), np.searchsorted(code, wanted, side="right")
                size = hi - lo
                if not size.any():
                    continue
                hits = rid[np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())]
                block = hits % blocks
                by = np.argsort(block, kind="stable")
                names, at = np.unique(block[by], return_index=True)
                for b, x in zip(names.tolist(), np.split(hits[by], at[1:])):
                    out[0].append(i)
                    out[1].append(b)
                    out[2].append(x.tobytes())
        types = (queries.schema.field("id").type, pa.int32(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(out, types)], names=["query_id", "block", "rids"])

    by = ("t", "part", "qp", "dp")
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(collide, f"query_id {kind}, block int, rids binary")
    return index.select("id", "v", "rid"), scratch.save(met.groupBy("query_id", "block").agg(F.collect_list("rids").alias("rids")))


def cross_polytope_top_k(
    rows: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 5,
    tables: int = 24,
    sample: int = 64,
    target: float = 0.97,
    seed: int = 42,
    data_block: int = 20_000,
    part_rows: int = 1_000_000,
    query_block: int = 2_048,
) -> DataFrame:
    """(query_id, rank INT, vec_id, score DOUBLE) by cosine in double precision.

    In each of ``tables`` tables a unit vector falls into the bucket named by its
    nearest signed axis in several pseudo-rotations, the more of them the more rows
    there are.  Every row is indexed in every table.  A query looks into the buckets
    of highest score over all tables, as many as hold ``target`` of the true
    neighbours of ``sample`` queries (the first by a hash of their id).  Buckets
    give numbers of rows; these are made distinct, and each block of vectors is
    read once for all queries that name rows of it and ranked by the exact cosine
    of the original vectors.  Nothing is capped: full parts are dealt into slices
    that are all searched.  A query that finds fewer than k rows, all of its
    candidates if there are fewer, is then compared with the whole table.
    """
    found, dim = valid_vectors(rows, id_col, vec_col)
    found = found.filter(F.exists("v", lambda x: x != 0))
    kind = found.schema["id"].dataType.simpleString()
    schema = RESULT.format(id=kind, score="double")
    n = found.count() if dim else 0
    if not n:
        return ranked(rows.sparkSession.createDataFrame([], schema), k)
    scratch = Scratch(rows.sparkSession)
    asked = scratch.save(as_queries(found, is_query))
    blocks = math.ceil(n / data_block)
    index, met = cross_polytope_candidates(scratch, found, asked, dim, k, tables, sample, target, seed, blocks, part_rows, query_block)

    # as many queries at once as share a block of vectors in memory
    turns = F.broadcast(met.groupBy("block").agg(F.ceil(F.count("*") / query_block).cast("int").alias("turns")))  # one number a block
    vectors = asked.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    left = met.join(vectors, "query_id").join(turns, "block").withColumn("turn", F.pmod(F.xxhash64("query_id"), F.col("turns")).cast("int")).drop("turns")
    right = index.withColumn("block", (F.col("rid") % blocks).cast("int")).join(turns, "block")
    right = right.select("id", "v", "rid", "block", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"))

    def rerank(key, queries, mine):
        out: tuple[list, list, list] = ([], [], [])
        if queries.num_rows and mine.num_rows:
            rid = mine.column("rid").to_numpy()
            order = np.argsort(rid)
            rid, ids, x = rid[order], mine.column("id").to_numpy()[order], matrix(mine.column("v"), dim)[order]
            nx = np.sqrt((x * x).sum(axis=1))
            unit = x / nx[:, None]
            for i, q, blobs in zip(queries.column("query_id").to_pylist(), matrix(queries.column("q"), dim), queries.column("rids").to_pylist()):
                at = np.searchsorted(rid, np.unique(np.frombuffer(b"".join(blobs), dtype=np.int64)))
                at = at[np.argsort(ids[at], kind="stable")]
                nq = math.sqrt((q * q).sum())
                hit = at[best(unit[at] @ (q / nq), ids[at], i, k, 1e-9)]
                fine = (x[hit] * q).sum(axis=1) / (nx[hit] * nq)
                top = np.lexsort((np.arange(len(hit)), -fine))[:k]
                out[0].append(np.full(len(top), i))
                out[1].append(ids[hit[top]])
                out[2].append(fine[top])
        types = (queries.schema.field("query_id").type, mine.schema.field("id").type, pa.float64())
        return pa.table([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, types)], names=["query_id", "vec_id", "score"])

    pairs = left.groupBy("block", "turn").cogroup(right.groupBy("block", "turn")).applyInArrow(rerank, schema)
    top = scratch.save(ranked(pairs, k))

    # queries short of k rows: those of the whole table are sent to all of its blocks
    enough = top.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias("id"))
    short = scratch.save(asked.join(enough, "id", "left_anti"))
    n_short = short.count()
    if not n_short:
        return top
    groups = F.lit(math.ceil(n_short / query_block))
    # the block of a row also depends on its input partition, so equal rows spread
    rest = found.withColumn("dp", F.pmod(F.xxhash64("id", "v", F.spark_partition_id()), F.lit(blocks)).cast("int"))
    rest = rest.withColumn("qp", F.explode(F.sequence(F.lit(0), groups - 1)))
    asking = short.withColumn("qp", F.pmod(F.xxhash64("id", "v"), groups).cast("int")).withColumn("dp", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    filled = asking.groupBy("qp", "dp").cogroup(rest.groupBy("qp", "dp")).applyInArrow(exact_pairs(k), schema)
    return top.join(enough.withColumnRenamed("id", "query_id"), "query_id", "left_semi").select(*top.columns).union(ranked(filled, k))
