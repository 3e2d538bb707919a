"""Every registered versioned-record query against its SQL."""

from __future__ import annotations

import random

import duckdb
import pytest

from palimpsest.plans import registry
from tests.compare import connect, same


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_matches_sql(spark, sf_dir, duck, name):
    same(registry.QUERIES[name](spark, sf_dir), duck, registry.SQL[name])


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns == ["key", "value", "seq"]


def test_every_query_has_sql_or_is_an_operator():
    import __spark_entry__

    missing = set(__spark_entry__.queries()) - set(__spark_entry__.oracle_sql())
    assert all(n.startswith("op") or n == "pipeline" for n in missing)


@pytest.fixture(scope="module", params=["long", "apart", "short", "below zero"])
def wide_dir(request, tmp_path_factory):
    """Events in 131 runs, whose keys lie anywhere in a long range or near a key of each run's own."""
    rng, kind = random.Random(request.param), request.param
    low, high = {"long": (0, 1 << 50), "apart": (0, 40), "short": (0, 300), "below zero": (-(1 << 50), 1)}[kind]
    home = [rng.randrange(1 << 40) if kind == "apart" else rng.randrange(4000) if kind == "short" else 0 for _ in range(130)]
    rows = [(i, home[i // 100] + rng.randrange(low, high), float(i)) for i in range(13_000) if kind != "short" or i % 100 < 3]
    d = tmp_path_factory.mktemp("wide")
    c = duckdb.connect()
    c.execute("CREATE TABLE e (event_id BIGINT, user_id BIGINT, value DOUBLE)")
    c.executemany("INSERT INTO e VALUES (?, ?, ?)", rows)
    c.execute("INSERT INTO e VALUES (13000, NULL, 0.0)")  # a run without keys
    c.execute(f"COPY e TO '{d}/events.parquet' (FORMAT parquet)")
    return str(d)


@pytest.mark.parametrize("name", ["run_overlap_pairs", "trivial_move_candidates"])
def test_key_ranges_of_any_length(spark, wide_dir, name):
    """Buckets of 64 keys could not be listed for a range of 2**50 keys."""
    same(registry.QUERIES[name](spark, wide_dir), connect(wide_dir), registry.SQL[name])


@pytest.mark.parametrize("n", [1, 102, 103, 10_404, 10_405, 25_000])
def test_roots_over_any_number_of_documents(spark, tmp_path, n):
    """The root's SQL has two levels at any size, the other one as many as it takes to one node."""
    c = duckdb.connect()
    c.execute(f"COPY (SELECT range AS doc_id, CASE WHEN range % 7 <> 3 THEN 'text ' || range END AS text FROM range({n})) TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    for name in ("merkle_root", "merkle_root_any_height"):
        same(registry.QUERIES[name](spark, str(tmp_path)), connect(str(tmp_path)), registry.SQL[name])
    assert registry.QUERIES["merkle_root_any_height"](spark, str(tmp_path)).count() == 1
