"""Exact nearest neighbours without all pairs: cells around pivots and the triangle inequality.

The store is dealt to its nearest pivot and, within a cell, cut along the
distance to it, so that a piece of a cell is a shell around its pivot. A
query knows its distance to every pivot. It first looks at the pieces of the cells
nearest to it, which gives its k-th distance an upper bound, and then visits
only pieces that can hold something nearer:

* by the shell: a piece whose members lie between ``low`` and ``high`` from the
  pivot holds nothing nearer than ``max(d - high, low - d)``;
* by the half-space: members of a cell are nearer to its pivot than to the
  query's own, so they lie beyond the plane between the two pivots.

Both bounds are exact, so is the result, and what the bounds spare depends on how
the data lie: ``visits`` reports it. Pieces and parts of the queries that
visit one are of bounded size, and meet as one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.columns import normalised, similarity
from quern.operators.shared import durable, few, numbered

#: Rows of a piece, queries that meet it at a time, and pivots, at most.
PIECE, PART, PIVOTS = 1024, 1024, 2048
#: Above any rounding of distances between unit vectors.
SLACK = 1e-7


def unit_rows(df: DataFrame, ident: str, vector: str) -> DataFrame:
    """``(i, v)`` of the rows that have a vector of finite numbers, scaled to length one."""
    rows = df.select(F.col(ident).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    return rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).withColumn("v", normalised(F.col("v")))


def _matrix(lists: pa.Array, n: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(squares, 0.0))


def choose_pivots(rows: DataFrame, n: int, most: int = PIVOTS, seed: int = 42) -> np.ndarray:
    """Some sqrt(n) different vectors of the store, chosen by hash: at most ``most``, whatever the store's size."""
    want = int(min(most, max(1, round(np.sqrt(n)))))
    some = rows.select("v", F.xxhash64(F.lit(seed), "v").alias("h")).where(F.pmod("h", F.lit(max(1, n // (8 * want)))) == 0)
    # Copies have one hash: however many there are, they are one choice.
    drawn = some.groupBy("h").agg(F.first("v").alias("v")).orderBy("h").limit(want).collect()
    if not drawn:  # all rows are copies of a few that the hash left out
        drawn = rows.select("v").limit(1).collect()
    return np.array([r.v for r in drawn], np.float64).reshape(len(drawn), -1)


def _assign(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``(cell, r, i, v)``: the nearest pivot and the distance to it."""
    for b in batches:
        if not b.num_rows:
            continue
        d = distances(_matrix(b.column("v"), b.num_rows), pivots)
        cell = d.argmin(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell]), b.column("i"), b.column("v")], names=["cell", "r", "i", "v"])


class Cells:
    """What tasks know of the store: pivots, and each cell's size, least and greatest distance to its pivot. Bounded by PIVOTS."""

    def __init__(self, pivots: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.pivots, self.size, self.low, self.high = pivots, size, low, high
        self.between = distances(pivots, pivots)

    def sure(self, d: np.ndarray, k: int) -> np.ndarray:
        """A distance within which each query has k rows for certain: whole cells, farthest member first."""
        far = np.where(self.size > 0, d + self.high, np.inf)
        order = np.argsort(far, axis=1)
        enough = np.cumsum(self.size[order], axis=1) >= k
        at = np.where(enough.any(axis=1), enough.argmax(axis=1), -1)
        return np.where(at >= 0, np.take_along_axis(far, order[np.arange(len(d)), at][:, None], axis=1)[:, 0], np.inf) + SLACK

    def first(self, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) of the nearest cells that have k rows together."""
        order = np.argsort(np.where(self.size > 0, d, np.inf), axis=1)
        sums = np.cumsum(self.size[order], axis=1)
        q, place = np.nonzero((sums - self.size[order] < k) & (self.size[order] > 0))
        return q, order[q, place]

    def may(self, d: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) of the cells that can hold a row within the query's distance."""
        home = d.argmin(axis=1)
        between = self.between[home]
        plane = np.where(between > 1e-4, (d**2 - d[np.arange(len(d)), home][:, None] ** 2) / (2 * np.maximum(between, 1e-4)), 0.0)
        least = np.maximum(np.maximum(d - self.high, self.low - d), plane)
        return np.nonzero((least <= within[:, None] + SLACK) & (self.size > 0))


def _route(batches: Iterator[pa.RecordBatch], cells: Cells, k: int, last: bool) -> Iterator[pa.RecordBatch]:
    """``(i, cell, d, t)``: the cells that a query visits first, or last (all that its bound ``t`` allows)."""
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            some = b.slice(at, 1024)
            d = distances(_matrix(some.column("v"), some.num_rows), cells.pivots)
            t = cells.sure(d, k)
            if last:
                t = np.minimum(t, some.column("t").fill_null(np.inf).to_numpy())
            q, c = cells.may(d, t) if last else cells.first(d, k)
            yield pa.RecordBatch.from_arrays([some.column("i").take(pa.array(q)), pa.array(c.astype(np.int32)), pa.array(d[q, c]), pa.array(t[q])], names=["i", "cell", "d", "t"])


def _nearest(batches: Iterator[pa.RecordBatch], k: int, same: bool) -> Iterator[pa.RecordBatch]:
    """``(query_id, neighbour_id, distance)``: the k nearest of a piece within each query's bound."""
    for b in batches:
        for queries, stored in zip(b.column("q"), b.column("s"), strict=True):
            flat, other = queries.values, stored.values
            qi, si, t = flat.field("i").to_numpy(), other.field("i").to_numpy(), flat.field("t").to_numpy()
            qv, sv = _matrix(flat.field("v"), len(qi)), _matrix(other.field("v"), len(si))
            squares = (qv**2).sum(1)[:, None] + (sv**2).sum(1)[None, :] - 2 * (qv @ sv.T)
            if not same:
                squares[qi[:, None] == si[None, :]] = np.inf
            limit = np.minimum(np.square(np.minimum(t, 1e3) + SLACK), np.partition(squares, min(k, len(si)) - 1, axis=1)[:, min(k, len(si)) - 1]) + 1e-9
            a, c = np.nonzero((squares <= limit[:, None]) & np.isfinite(squares))
            d = np.sqrt(((qv[a] - sv[c]) ** 2).sum(1))
            q, n = qi[a], si[c]
            order = np.lexsort((n, d, q))
            q, n, d = q[order], n[order], d[order]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < k
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (q, n, d)], names=["query_id", "neighbour_id", "distance"])


def best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, with their rank; ties by the lesser id."""
    order = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scan(batches: Iterator[pa.RecordBatch], ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        other = b.column("i").to_numpy()
        d = distances(x, _matrix(b.column("v"), b.num_rows))
        d[ids[:, None] == other[None, :]] = np.inf
        near = min(k, len(other))
        q, n = np.nonzero((d <= np.partition(d, near - 1, axis=1)[:, near - 1][:, None]) & np.isfinite(d))
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(other[n]), pa.array(d[q, n])], names=["query_id", "neighbour_id", "distance"])


def scan(ids: list[int], x: np.ndarray, rows: DataFrame, k: int) -> DataFrame:
    """``(query_id, neighbour_id, distance, rank)``: the k nearest of a few queries that every task is given, in one pass over ``rows(i, v)``."""
    given = np.array(ids, np.int64)
    return best(rows.mapInArrow(lambda it: _scan(it, given, x, k), "query_id long, neighbour_id long, distance double"), k)


def search(queries: DataFrame, store: DataFrame, k: int = 1, ident: str = "vec_id", vector: str = "embedding", same: bool = False, pivots: int = PIVOTS, piece: int = PIECE, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """(the min(k, size) nearest of each query, the pieces that each visited).

    The first is ``(query_id, rank, neighbour_id, distance, similarity)``, the
    second ``(query_id, pieces, of)``. Ties go to the lesser id. With ``same``
    false a row is not a neighbour of its own id. Vectors are of one length;
    null ones and those with null or non-finite components take no part. Query
    ids are unique. An empty side gives no rows.
    """
    rows = durable(unit_rows(store, ident, vector))
    asked = durable(unit_rows(queries, ident, vector))
    n, n_asked = rows.count(), asked.count()
    schema = "query_id long, rank int, neighbour_id long, distance double, similarity double"
    if not n or not n_asked:
        return rows.sparkSession.createDataFrame([], schema), rows.sparkSession.createDataFrame([], "query_id long, pieces long, of long")
    at = choose_pivots(rows, n, pivots)
    dealt = numbered_pieces(rows.mapInArrow(lambda it: _assign(it, at), "cell int, r double, i long, v array<double>"), piece)
    shells = durable(dealt.groupBy("cell", "piece").agg(F.count("*").alias("size"), F.min("r").alias("low"), F.max("r").alias("high")))
    total = shells.count()
    size, low, high = np.zeros(len(at), np.int64), np.zeros(len(at)), np.zeros(len(at))
    for r in shells.groupBy("cell").agg(F.sum("size").alias("size"), F.min("low").alias("low"), F.max("high").alias("high")).collect():
        size[r.cell], low[r.cell], high[r.cell] = r["size"], r.low, r.high
    cells = Cells(at, size, low, high)
    wanted = k if same else k + 1  # the query's own row may be among them
    packed = durable(dealt.groupBy("cell", "piece").agg(F.collect_list(F.struct("i", "v")).alias("s")))
    parts = max(1, -(-n_asked // part))
    route = "i long, cell int, d double, t double"

    def meet(visits: DataFrame) -> DataFrame:
        """``visits(i, cell, piece, t)``: queries that visit a piece meet it in parts of bounded size."""
        with_vectors = visits.join(asked, "i").withColumn("part", F.pmod(F.xxhash64("i"), F.lit(parts)))
        grouped = with_vectors.groupBy("cell", "piece", "part").agg(F.collect_list(F.struct("i", "v", "t")).alias("q"))
        return grouped.join(packed, ["cell", "piece"]).select("q", "s").mapInArrow(lambda it: _nearest(it, k, same), "query_id long, neighbour_id long, distance double")

    # First the piece of each nearby cell whose shell the query is in, or is nearest to.
    near = asked.mapInArrow(lambda it: _route(it, cells, wanted, False), route).join(few(shells, total), "cell")
    gap = F.greatest(F.col("low") - F.col("d"), F.col("d") - F.col("high"), F.lit(0.0))
    first = durable(near.groupBy("i", "cell").agg(F.min_by(F.struct("piece", "t"), F.struct(gap, -F.col("size"), "piece")).alias("p")).select("i", "cell", "p.piece", "p.t"))
    found = durable(best(meet(first), k).drop("rank"))
    bound = found.groupBy(F.col("query_id").alias("i")).agg(F.when(F.count("*") >= k, F.max("distance")).alias("t"))
    # Then every other piece that can hold something as near as the k-th.
    bounded = asked.join(bound, "i", "left")
    may = bounded.mapInArrow(lambda it: _route(it, cells, wanted, True), route).join(few(shells, total), "cell")
    may = may.where((F.col("d") - F.col("high") <= F.col("t") + SLACK) & (F.col("low") - F.col("d") <= F.col("t") + SLACK))
    rest = durable(may.select("i", "cell", "piece", "t").join(first.select("i", "cell", "piece"), ["i", "cell", "piece"], "left_anti"))
    result = best(found.unionByName(meet(rest)), k).select("query_id", "rank", "neighbour_id", "distance", similarity(F.col("distance")).alias("similarity"))
    visited = first.select("i").unionByName(rest.select("i")).groupBy(F.col("i").alias("query_id")).agg(F.count("*").alias("pieces")).withColumn("of", F.lit(total).cast("long"))
    return result, visited


def numbered_pieces(rows: DataFrame, piece: int) -> DataFrame:
    """``rows(cell, r, i, v)`` with ``piece``: cells cut along ``r`` into pieces of at most so many rows."""
    placed = numbered(durable(rows), "cell", "r", "i")
    return durable(placed.withColumn("piece", F.floor(F.col("pos") / piece)).drop("pos"))


def share_visited(visited: DataFrame) -> float:
    """The mean share of pieces that a query visits."""
    return float(visited.agg(F.avg(F.col("pieces") / F.col("of"))).first()[0] or 0.0)
