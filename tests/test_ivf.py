"""The inverted file: recall against all pairs, appended batches, the saved model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import cells, ivf, nearest


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(12)
    centres = unit(rng.standard_normal((30, 24)))
    return unit(centres[rng.integers(0, 30, 2400)] + 0.25 * rng.standard_normal((2400, 24)))


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    return ivf.InvertedFile.build(frame(spark, vectors[:2000]), str(tmp_path_factory.mktemp("ivf")), k=10, sample=1200)


def recall(spark, index, vectors, n, **options):
    store, asked = frame(spark, vectors[:n]), frame(spark, vectors[:n:25])
    return ivf.measured_recall(index.search(asked, 10, **options), nearest.knn(asked, store, 10)).first()


def test_recall_is_reached_with_few_probes(spark, index, vectors):
    got = recall(spark, index, vectors, 2000)
    assert (got.queries, got.neighbours) == (80, 800) and got.recall >= 0.95
    assert index.model.probes < len(index.model.centres) / 2 and index.model.depth <= 500
    assert recall(spark, index, vectors, 2000, probes=1, depth=10).recall < got.recall


def test_distances_are_exact_and_ranked(spark, index, vectors):
    rows = index.search(frame(spark, vectors[:3]), 5).collect()
    for r in rows:
        assert r.distance == pytest.approx(np.linalg.norm(vectors[r.query_id] - vectors[r.neighbour_id]), abs=1e-9) and r.neighbour_id != r.query_id
        assert r.similarity == pytest.approx(1 / (1 + r.distance))
    assert [r["rank"] for r in sorted(rows, key=lambda r: (r.query_id, r["rank"]))] == [1, 2, 3, 4, 5] * 3


def test_batches_are_appended_once_and_a_saved_index_opens(spark, index, vectors):
    again = ivf.InvertedFile.open(spark, index.folder)
    assert (again.model.probes, again.model.depth) == (index.model.probes, index.model.depth)
    more = frame(spark, vectors[2000:], 2000)
    for _ in range(2):  # the second time replaces the first
        again.append(more, "late")
    assert spark.read.parquet(f"{index.folder}/cells").agg(F.sum(F.size("ids"))).first()[0] == 2400
    got = recall(spark, again, vectors, 2400)
    assert got.recall >= 0.93 and got.neighbours == 960
    with pytest.raises(ValueError, match="first"):
        again.append(more, "first")


def test_few_rows_nulls_and_nothing(spark, tmp_path):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.8, 0.6]), (3, None), (4, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(c) for c in ("i", "v", "cell", "code", "piece", "rank", "h")})
    few = ivf.InvertedFile.build(df, str(tmp_path / "few"))
    assert sorted((r.query_id, r["rank"], r.neighbour_id) for r in few.search(df, 5).collect()) == [(0, 1, 2), (0, 2, 1), (1, 1, 2), (1, 2, 0), (2, 1, 0), (2, 2, 1)]
    assert ivf.InvertedFile.build(df.limit(0), str(tmp_path / "none")).search(df, 5).count() == 0


def test_the_backend_is_chosen_by_name(spark, vectors, tmp_path):
    store, asked = frame(spark, vectors[:300]), frame(spark, vectors[:300:50])
    want = sorted((r.query_id, r["rank"], r.neighbour_id) for r in nearest.search(asked, store, k=2).collect())
    assert sorted((r.query_id, r["rank"], r.neighbour_id) for r in nearest.search(asked, store, "cells", k=2).collect()) == want
    folder = str(tmp_path / "kept")
    first = nearest.search(asked, store, "ivf", k=2, folder=folder).collect()
    assert sorted(map(str, nearest.search(asked, store, "ivf", k=2, folder=folder).collect())) == sorted(map(str, first))
    with pytest.raises(ValueError, match="unknown backend"):
        nearest.search(asked, store, "faiss")


def test_k_means_fills_every_centre():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.01, (50, 2)) for c in (0, 5, 9)] + [np.zeros((200, 2))])
    centres = ivf.k_means(x, 8, rng)
    assert len(np.unique(cells.distances(x, centres).argmin(axis=1))) == 8
