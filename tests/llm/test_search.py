"""Neighbour searches against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import neighbours, queries
from palimpsest.llm.shared import Scratch

SHAPE = "vec_id bigint, embedding array<float>, label int"


def vectors(seed, n, dim=8, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[:copies] = x[0]
    return [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]


def brute_inner(rows, k=5, every=50):
    w = {i: [math.floor(256 * c) for c in v] for i, v, _ in rows}
    out = set()
    for q in w:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(w[q], w[c])), c) for c in w if c != q)[:k]
            out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(best)}
    return out


@pytest.mark.parametrize("seed,n,copies", [(1, 130, 0), (2, 130, 60), (3, 4, 0), (4, 1, 0)])
def test_voronoi_is_exact(spark, seed, n, copies):
    rows = vectors(seed, n, copies=copies)
    got = neighbours.voronoi_top_k(spark.createDataFrame(rows, SHAPE), F.col("id") % 50 == 0, pivots=7, query_block=2, data_block=20)
    assert {tuple(r) for r in got.collect()} == brute_inner(rows)


def test_voronoi_prunes_far_cells(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(100, 4)) * 0.05 + c for c in np.eye(4) * 4])
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    got = neighbours.voronoi_top_k(spark.createDataFrame(rows, SHAPE), F.col("id") % 50 == 0, pivots=12, query_block=1)
    assert {tuple(r) for r in got.collect()} == brute_inner(rows)


def test_voronoi_with_a_repeated_id(spark):
    """Ten rows of the query's own id lie nearest to it; none of them counts."""
    rng = np.random.default_rng(3)
    own = [float(c) for c in np.eye(4)[0] * 4]
    others = np.concatenate([rng.normal(size=(20, 4)) * 0.05 + c for c in np.eye(4)[1:] * 4])
    rows = [(0, own, 0)] * 10 + [(i + 51 if i >= 49 else i + 1, [float(np.float32(c)) for c in v], 0) for i, v in enumerate(others)]
    got = neighbours.voronoi_top_k(spark.createDataFrame(rows, SHAPE), F.col("id") == 0, query_block=1)
    assert {tuple(r) for r in got.collect()} == {r for r in brute_inner(rows) if r[0] == 0}


def test_rows_that_take_no_part(spark):
    rows = vectors(5, 60) + [(100, None, 0), (150, [float("nan")] * 8, 0), (200, [1.0, None] * 4, 0), (250, [float("inf")] * 8, 0), (300, [1.0], 0), (350, [], 0), (None, [1.0] * 8, 0)]
    df = spark.createDataFrame(rows, SHAPE)
    want = brute_inner(rows[:60])
    assert {tuple(r) for r in neighbours.voronoi_top_k(df, F.col("id") % 50 == 0).collect()} == want
    assert {r["query_id"] for r in neighbours.cross_polytope_top_k(df, F.col("id") % 50 == 0).collect()} == {0, 50}


def test_huge_components_stay_exact(spark):
    rows = [(i, [float(3e12 + i), float(-1e12 * i), 7.0], 0) for i in range(7)]
    rows = [(i, [float(np.float32(c)) for c in v], 0) for i, v, _ in rows]
    got = {tuple(r)[:3] for r in neighbours.voronoi_top_k(spark.createDataFrame(rows, SHAPE), F.col("id") == 0).collect()}
    assert got == {r[:3] for r in brute_inner(rows) if r[0] == 0}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SHAPE)
    assert neighbours.voronoi_top_k(none, F.col("id") % 50 == 0).count() == 0
    assert neighbours.cross_polytope_top_k(none, F.col("id") % 50 == 0).count() == 0


def brute_cosine(rows, k=5, every=50):
    ids = np.array([i for i, _, _ in rows])
    x = np.array([v for _, v, _ in rows], dtype=np.float64)
    n = np.sqrt((x * x).sum(axis=1))
    out = {}
    for p, q in enumerate(ids):
        if q % every == 0:
            s = (x * x[p]).sum(axis=1) / (n * n[p])
            order = [c for c in np.lexsort((ids, -s)) if c != p][:k]
            out[int(q)] = [(int(ids[c]), float(s[c])) for c in order]
    return out


@pytest.mark.parametrize("name,least", [("sf0.001", 0.9), ("sf0.01", 0.9), ("sf0.1", 0.9)])
def test_recall(spark, name, least):
    d = f"/root/testdata/{name}"
    rows = [(r[0], list(r[1]), 0) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute_cosine(rows)
    got: dict = {}
    for r in queries.op4_cross_polytope(spark, d).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got.get(q, [])}) for q in want)
    assert hits >= least * sum(map(len, want.values()))
    exact = {q: dict(w) for q, w in want.items()}
    assert all(abs(exact[q][i] - s) < 1e-12 for q, found in got.items() for i, s in found if i in exact[q])
    assert all([s for _, s in f] == sorted((s for _, s in f), reverse=True) for f in got.values())


def test_equal_vectors_tie_to_smaller_id(spark):
    rows = [(i, [1.0, 2.0, 2.0], 0) for i in range(80)]
    got = neighbours.cross_polytope_top_k(spark.createDataFrame(rows, SHAPE), F.col("id") == 50, query_block=1, data_block=10)
    assert [r["vec_id"] for r in got.orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def clustered(n, dim=64):
    """One tight cluster, and every fiftieth vector at cosine -0.3 to it."""
    rng = np.random.default_rng(8)
    centre = np.zeros(dim)
    centre[0] = 1.0
    x = centre + rng.normal(size=(n, dim)) * 0.01
    away = rng.normal(size=(n, dim))
    away[:, 0] = 0
    away *= math.sqrt(1 - 0.09) / np.linalg.norm(away, axis=1, keepdims=True)
    away[:, 0] = -0.3
    x[::50] = away[::50]
    return [(i, [float(np.float32(c)) for c in v], 0) for i, v in enumerate(x)]


@pytest.mark.parametrize("rows,parts", [(vectors(6, 6, 64), {}), (vectors(7, 3, 64), {}), (clustered(600), {"data_block": 100, "query_block": 3}), (clustered(40), {})])
def test_every_query_finds_k_or_all(spark, rows, parts):
    asked = F.col("id") % 50 == 0
    got: dict = {}
    for r in neighbours.cross_polytope_top_k(spark.createDataFrame(rows, SHAPE), asked, **parts).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = {q: [i for i, _ in w] for q, w in brute_cosine(rows).items()}
    assert {q: len(f) for q, f in got.items()} == {q: len(w) for q, w in want.items()}
    if len(rows) <= 6:
        assert got == want


def test_repeated_candidates_each_count_when_filled(spark):
    rows = [(0, [1.0, 0.0, 0.0, 0.0], 0)] + [(1, [-1.0, 0.5, 0.0, 0.0], 0)] * 3 + [(2, [-1.0, 0.0, 0.5, 0.0], 0)]
    got = neighbours.cross_polytope_top_k(spark.createDataFrame(rows, SHAPE), F.col("id") == 0, tables=1, target=0.01)
    assert [r["vec_id"] for r in got.orderBy("rank").collect()] == [1, 1, 1, 2]


def test_cosine_with_a_repeated_query_id(spark):
    """Rows that share the query's id and vector do not crowd out its candidates."""
    rows = [(50, [1.0, 0.0, 0.0], 0)] * 12 + [(i, [1.0, 0.01 * i, 0.0], 0) for i in range(1, 9)] + [(9, [1.0, 0.0, 0.0], 0)] * 7
    got = neighbours.cross_polytope_top_k(spark.createDataFrame(rows, SHAPE), F.col("id") == 50)
    assert [r["vec_id"] for r in got.orderBy("rank").collect()] == [9] * 5
    rows = [r for r in rows if r[0] != 9]
    got = neighbours.cross_polytope_top_k(spark.createDataFrame(rows, SHAPE), F.col("id") == 50)
    assert [r["vec_id"] for r in got.orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_extra_columns_and_null_ids_in_searches(spark):
    """Other columns, whatever their names, and rows without an id change nothing."""
    rows = vectors(9, 120, 8)
    plain = spark.createDataFrame(rows, SHAPE)
    more = plain.union(spark.createDataFrame([(None, [9.0] * 8, 0)], SHAPE)).withColumnRenamed("label", "id").withColumn("rid", F.lit("x")).withColumn("v", F.lit(1)).withColumn("score", F.lit(2))
    for search in (neighbours.voronoi_top_k, neighbours.cross_polytope_top_k):
        of = [sorted(map(tuple, search(t, F.col("id") % 50 == 0).collect())) for t in (plain, more)]
        assert of[0] == of[1]


def test_comparisons_fall_as_a_share_of_the_rows(spark):
    """Recall stays, while the share of rows that a query is compared with falls."""
    shares = []
    for n in (1_000, 10_000):
        rows = vectors(n, n, 64)
        table = spark.createDataFrame(rows, SHAPE)
        found, dim = neighbours.valid_vectors(table, "vec_id", "embedding")
        asked = neighbours.as_queries(found, F.col("id") % 50 == 0)
        _, met = neighbours.cross_polytope_candidates(Scratch(spark), found, asked, dim, 5, 24, 64, 0.97, 42, 1, 10**6, 2_048)
        each = [len(set(np.frombuffer(b"".join(r["rids"]), dtype=np.int64).tolist())) for r in met.collect()]
        shares.append(sum(each) / len(each) / n)
    assert shares[1] < shares[0] and shares[1] < 0.2, shares
    want = brute_cosine(rows)
    got: dict = {}
    for r in neighbours.cross_polytope_top_k(table, F.col("id") % 50 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len({i for i, _ in w} & got[q]) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))
