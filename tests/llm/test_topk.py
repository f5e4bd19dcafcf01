import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import packing, topk


def every_fifth():
    return F.col("vec_id") % 5 == 0


def plain(rows, is_query, k):
    """All products in Python's whole numbers."""
    ok = [(i, [math.floor(1024 * x) if abs(x) < 1e300 else int(x) * 1024 for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(ok):
        if q is None or not is_query(q):
            continue
        scored = sorted((-sum(m * n for m, n in zip(x, y, strict=True)), s is None, s or 0) for b, (s, y) in enumerate(ok) if b != a and len(x) == len(y))
        out += [(q, r + 1, None if no else s, max(min(-score, 2**63 - 1), -(2**63))) for r, (score, no, s) in enumerate(scored[:k])]
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_equals_all_products_with_ties_and_many_blocks(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((6, 24)) * 0.3
    rows = [(i, (centres[i % 6] + 0.1 * rng.standard_normal(24)).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # a very common vector
    rows += [(7, rows[7][1]), (5, rows[5][1]), (5, rows[9][1])]  # repeated rows and ids
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = sorted(plain(rows, lambda q: q % 5 == 0, 10))
    for store, group in ((64, 16), (1024, 512)):
        got = topk.top_k(df, every_fifth(), store_rows=store, group_rows=group)
        assert sorted(map(tuple, got.collect())) == want


def test_every_kind_of_row(spark):
    rows = [(0, [0.5, 0.25]), (5, [0.5, -0.25]), (None, [0.9, 0.9]), (None, [0.9, 0.9]), (3, None), (10, [float("nan"), 1.0]), (15, [float("inf"), 1.0]), (20, [None, 1.0]), (25, []), (26, []), (30, [1.0, 2.0, 3.0]), (35, [0.0, 0.0]), (40, [-0.0001, 1e-9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for c in ("row", "d", "block", "v", "share", "g", "n", "data", "score", "rank"):
        df = df.withColumn(c, F.lit(c))
    got = sorted(map(tuple, topk.top_k(df, every_fifth(), k=3).collect()), key=key)
    assert got == sorted(plain(rows, lambda q: q % 5 == 0, 3), key=key)
    assert topk.top_k(df.limit(0), every_fifth()).count() == 0
    assert topk.top_k(df, F.col("vec_id") < 0).count() == 0


@pytest.mark.parametrize("large", [1e6, 1e14, 1e300, 1.7e308])
def test_values_beyond_the_exact_range_of_doubles(spark, large):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) * large if i % 3 else float(x) for x in rng.uniform(-1, 1, 4)]) for i in range(40)]
    rows += [(40, [large, 1.0, 0.3, 0.0]), (45, [large, 1.0, 0.3, 1 / 1024])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, every_fifth(), store_rows=8).collect())) == sorted(plain(rows, lambda q: q % 5 == 0, 10))


def block(x, first=0):
    n, d = x.shape
    return topk.Block(packing.pack(np.arange(first, first + n), np.ones(n, np.int8), np.arange(first, first + n), np.ascontiguousarray(x.T)), n, d)


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_bounds_drop_candidates_and_never_an_answer(spread):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 64))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = centres[rng.integers(0, 40, 4000)] + spread * rng.standard_normal((4000, 64)) / 8
    s, q = block(x), block(x[:100])
    best = topk.Best(100, 10)
    made = topk.search(q, s, best)
    whole = np.floor(1024 * x)
    scores = whole[:100] @ whole.T
    scores[np.arange(100), np.arange(100)] = -np.inf
    for i in range(100):
        order = sorted(range(4000), key=lambda j: (-scores[i, j], j))[:10]
        assert [(-a, c) for a, _, c in best.rows[i]] == [(scores[i, j], j) for j in order]
    assert made < (0.6 if spread < 1 else 0.95) * 100 * 4000 * 64


def test_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    df = topk.query(spark, sf)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({topk.SQL})").fetchall())
