"""Nearest neighbours by L2 distance.

The exact search works on blocks: vectors are packed into rows of ``BLOCK``,
each pair of a query block and a store block is one matrix product, and only
the k best of a block leave it. A store whose size is known to be small is
sent to every task; a larger one is dealt into cells, of which a query visits
those that can hold a neighbour (``cells``). The approximate searches use an
inverted file (``ivf``) or locality-sensitive hashing, and rank exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.columns import normalised, similarity
from quern.operators import cells, ivf, lsh
from quern.operators.shared import exists, scratch

BLOCK = 2048
#: A store of fewer bytes is sent to all tasks.
SMALL_STORE_BYTES = 32 << 20


def _packed(df: DataFrame, ident: str, vector: str, block: int, rows: int) -> DataFrame:
    blocks = max(1, -(-rows // block))
    dealt = df.select(F.col(ident).cast("long").alias("i"), normalised(F.col(vector)).alias("v"))
    return dealt.groupBy(F.pmod(F.xxhash64("i"), F.lit(blocks)).alias("b")).agg(F.collect_list(F.struct("i", "v")).alias("rows"))


def _matrix(rows: pa.StructScalar) -> tuple[np.ndarray, np.ndarray]:
    flat = rows.values
    ids = flat.field("i").to_numpy()
    vectors = flat.field("v")
    return ids, vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def _top(q: np.ndarray, n: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each query, ties by the lesser id."""
    order = np.lexsort((n, d, q))
    q, n, d = q[order], n[order], d[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], n[keep], d[keep]


def _best(batches: Iterator[pa.RecordBatch], k: int, same: bool) -> Iterator[pa.RecordBatch]:
    """Store blocks that follow each other for one query block are merged before they leave."""
    block, held = None, None
    names = ["query_id", "neighbour_id", "distance"]
    for b in batches:
        for number, queries, stored in zip(b.column("b").to_pylist(), b.column("q"), b.column("s"), strict=True):
            qi, qv = _matrix(queries)
            si, sv = _matrix(stored)
            squares = (qv**2).sum(1)[:, None] + (sv**2).sum(1)[None, :] - 2 * (qv @ sv.T)
            if not same:
                squares[qi[:, None] == si[None, :]] = np.inf
            # A product's rounding is far below this slack; what it leaves is measured again directly.
            near = min(k, squares.shape[1])
            limit = np.partition(squares, near - 1, axis=1)[:, near - 1] + 1e-9
            a, c = np.nonzero((squares <= limit[:, None]) & np.isfinite(squares))
            found = (qi[a], si[c], np.sqrt(((qv[a] - sv[c]) ** 2).sum(1)))
            if number != block:
                if held is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=names)
                block, held = number, _top(*found, k)
            else:
                held = _top(*(np.concatenate([x, y]) for x, y in zip(held, found, strict=True)), k)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=names)


def knn(queries: DataFrame, store: DataFrame, k: int = 1, ident: str = "vec_id", vector: str = "embedding", same: bool = False, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, neighbour_id, distance, similarity)``: the min(k, size) nearest of each query.

    Ties go to the lesser id. With ``same`` false a row is not its own
    neighbour. An empty store gives no rows.
    """
    n_store, width = store.agg(F.count("*"), F.coalesce(F.max(F.size(vector)), F.lit(0))).first()
    if n_store * (8 * width + 16) > SMALL_STORE_BYTES:
        return cells.search(queries, store, k, ident, vector, same)[0]
    n_queries = queries.count()
    s = _packed(store, ident, vector, block, n_store).select(F.col("rows").alias("s"))
    q = _packed(queries, ident, vector, block, n_queries).select("b", F.col("rows").alias("q"))
    # One row a block: the product below has (queries / block) x (store / block) rows.
    met = q.crossJoin(F.broadcast(s))
    parts = met.mapInArrow(lambda it: _best(it, k, same), "query_id long, neighbour_id long, distance double")
    best = parts.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "neighbour_id"))), 1, k).alias("best"))
    one = best.select("query_id", F.posexplode("best").alias("rank", "b"))
    return one.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("b.neighbour_id").alias("neighbour_id"), F.col("b.distance").alias("distance"), similarity(F.col("b.distance")).alias("similarity"))


def semantic_decisions(queries: DataFrame, store: DataFrame, thresholds: list[float], **options) -> DataFrame:
    """Nearest entry of each query against a fixed store, decided for each threshold."""
    best = knn(queries, store, 1, **options)
    t = F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("threshold")
    hit = ~(F.col("similarity") < F.col("threshold"))
    return best.select("query_id", "neighbour_id", "similarity", t).select("query_id", "threshold", hit.alias("hit"), F.when(hit, F.col("neighbour_id")).alias("matched_id"), "similarity")


#: Neighbours within a radius, as far as hashing finds them.
lsh_neighbours = lsh.neighbours

BACKENDS = ("auto", "exact", "cells", "ivf", "lsh")


def search(queries: DataFrame, store: DataFrame, backend: str = "auto", radius: float | None = None, k: int = 1, recall: float = 0.95, folder: str | None = None, ident: str = "vec_id", vector: str = "embedding", **options) -> DataFrame:
    """The ``k`` nearest by the backend of that name.

    ``exact`` (and ``auto``, at every size) and ``cells`` lose nothing. ``ivf``
    builds an inverted file in ``folder`` (by default one of its own in the
    shared folder) or opens the one that is there; ``lsh`` gives neighbours
    within ``radius``. Both may lose some and are used only by name.
    """
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend {backend!r}")
    if backend == "lsh":
        if radius is None:
            raise ValueError("the lsh backend needs a radius")
        return lsh_neighbours(queries, store, radius, ident, vector, **options)
    if backend == "cells":
        return cells.search(queries, store, k, ident, vector, **options)[0]
    if backend == "ivf":
        if folder is not None and exists(store.sparkSession, f"{folder}/model"):
            index = ivf.InvertedFile.open(store.sparkSession, folder)
        else:
            index = ivf.InvertedFile.build(store, folder or scratch(store.sparkSession, "ivf"), ident, vector, k, recall)
        return index.search(queries, k, ident, vector, **options)
    return knn(queries, store, k, ident, vector, **options)


def max_distance(threshold: float) -> float:
    """The distance at which similarity meets the threshold."""
    return 1.0 / threshold - 1.0

