"""Exact search by cells against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import cells, nearest


def unit(x):
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n == 0, x, x / np.where(n == 0, 1, n))


def brute(queries, store, k, same=False):
    out = []
    for qi, q in queries:
        d = sorted((float(np.sqrt(((q - v) ** 2).sum())), i) for i, v in store if same or i != qi)
        out += [(qi, r + 1, i, pytest.approx(x, abs=1e-9)) for r, (x, i) in enumerate(d[:k])]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(8)
    centres = unit(rng.standard_normal((20, 16)))
    x = unit(centres[rng.integers(0, 20, 1500)] + 0.06 * rng.standard_normal((1500, 16)))
    x[200:700] = x[199]  # a third of all rows are copies
    return list(enumerate(x))


@pytest.mark.parametrize(("k", "same"), [(1, False), (7, True)])
def test_equals_all_pairs_and_visits_few(spark, clustered, k, same):
    queries = clustered[::25]
    got, visited = cells.search(frame(spark, queries), frame(spark, clustered), k, same=same, piece=40, part=16)
    rows = sorted((r.query_id, r["rank"], r.neighbour_id, r.distance) for r in got.collect())
    assert rows == brute(queries, clustered, k, same)
    assert all(r.similarity == pytest.approx(1 / (1 + r.distance)) for r in got.collect())
    assert cells.share_visited(visited) < 0.45 and visited.count() == len(queries)
    assert visited.agg(F.max("of")).first()[0] >= 1500 // 40


def test_vectors_in_all_directions(spark):
    """Where bounds spare nothing the result is still exact."""
    rng = np.random.default_rng(3)
    rows = list(enumerate(unit(rng.standard_normal((400, 32)))))
    got, _ = cells.search(frame(spark, rows[::20]), frame(spark, rows), 5, piece=32)
    assert sorted((r.query_id, r["rank"], r.neighbour_id, r.distance) for r in got.collect()) == brute(rows[::20], rows, 5)


def test_nulls_zeros_few_rows_and_nothing(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [0.6, 0.8]), (3, None), (4, [float("nan"), 1.0]), (5, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(c) for c in ("i", "v", "cell", "piece", "t")})
    got = sorted((r.query_id, r["rank"], r.neighbour_id) for r in cells.search(df, df, 10)[0].collect())
    assert got == [(0, 1, 5), (0, 2, 2), (0, 3, 1), (1, 1, 0), (1, 2, 2), (1, 3, 5), (2, 1, 0), (2, 2, 5), (2, 3, 1), (5, 1, 0), (5, 2, 2), (5, 3, 1)]
    for q, s in ((df.limit(0), df), (df, df.limit(0))):
        found, visited = cells.search(q, s, 3)
        assert found.count() == visited.count() == 0


def test_a_store_too_large_to_send_is_searched_by_cells(spark, clustered, monkeypatch):
    df, some = frame(spark, clustered), frame(spark, clustered[::100])
    want = sorted(map(str, nearest.knn(some, df, 3).select("query_id", "rank", "neighbour_id", F.round("distance", 9)).collect()))
    monkeypatch.setattr(nearest, "SMALL_STORE_BYTES", 0)
    assert sorted(map(str, nearest.knn(some, df, 3).select("query_id", "rank", "neighbour_id", F.round("distance", 9)).collect())) == want


def test_pivots_are_bounded_and_different(spark, clustered):
    rows = cells.unit_rows(frame(spark, clustered), "vec_id", "embedding")
    found = cells.choose_pivots(rows, 1500, most=30)
    assert 5 < len(found) <= 30 and len(np.unique(found, axis=0)) == len(found)
