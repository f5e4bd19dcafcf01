"""Exact top-k by inner product: branch and bound over columns.

Vectors are whole numbers and are stored in blocks with one row of numbers a
dimension (vertically). A query's scores against a block are summed up over some
dimensions at a time, those in which the queries weigh most first. After each
such step the rest of a score is bounded by the mass that query and candidate
have left (Cauchy-Schwarz), so candidates whose best case lies below a score that
k others reach for certain go, and the sums go on over the survivors alone, packed
together. That score is the k-th best worst case, or the least whole score of the k
that lead after the first steps. What a block leaves is exact; no candidate is left out by chance.

Queries and store meet in blocks: the store is dealt into blocks once, the
queries (a stated part of the rows) into groups, and each group walks over the
blocks of a share with its k best so far, which prune the next block from the
first step on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import common as C
from quern.llm import packing

K, SCALE, EVERY = 10, 1024, 100
#: Rows of a block of the store and of a group of queries, dimensions of a step.
STORE, GROUP, STEP = 1024, 512, 8
#: Numbers of a block or a group at most, for long vectors.
NUMBERS = 1 << 21
#: Sums of all candidates side by side, until fewer than this part of them is left.
DENSE = 0.25
#: Queries whose sums are held at a time.
CHUNK = 64
#: Whole numbers below this are exact as doubles, and so are their sums.
EXACT = float(1 << 53)
_LONG = (-(1 << 63), (1 << 63) - 1)


def usable(v: Column) -> Column:
    """A vector, of any length, without null or non-finite components."""
    return F.coalesce(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as doubles, or as Python's whole numbers where a double is no longer exact for sums."""
    with np.errstate(over="ignore"):
        v = np.floor(x * scale)
    if np.isfinite(v).all():
        return v
    # What overflows is so large that it is whole already.
    return np.array([[int(c) * scale if np.isinf(f) else int(f) for c, f in zip(*rows, strict=True)] for rows in zip(x, v, strict=True)], dtype=object)


def _pack(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """One row a block: lengths, rows' numbers, ids, whether an id is there, and the values, a dimension after the other."""
    for t, starts in C.whole_groups(batches, ["d", "block"]):
        vectors = t.column("v").combine_chunks()
        out: dict[str, list] = {"d": [], "block": [], "n": [], "data": []}
        for s, e in zip(starts, [*starts[1:], t.num_rows], strict=True):
            d = t.column("d")[int(s)].as_py()
            ids = t.column("vec_id").slice(s, e - s).combine_chunks()
            known = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int8)
            x = vectors.slice(s, e - s).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(e - s, d)
            raw = np.ascontiguousarray(x.T)
            out["d"].append(d)
            out["block"].append(t.column("block")[int(s)].as_py())
            out["n"].append(int(e - s))
            out["data"].append(packing.pack(ids.fill_null(0).to_numpy(), known, t.column("row").slice(s, e - s).to_numpy(), raw))
        yield pa.RecordBatch.from_arrays([pa.array(out["d"], pa.int32()), pa.array(out["block"], pa.int64()), pa.array(out["n"], pa.int32()), pa.array(out["data"], pa.binary())], names=["d", "block", "n", "data"])


class Block:
    """A block or a group: ids, row numbers and values, dimension by dimension."""

    def __init__(self, data: bytes, n: int, d: int, scale: int = SCALE):
        self.ids, self.known, self.rows, flat = packing.unpack(data, np.int64, np.int8, np.int64, np.float64)
        self.x = whole(flat.reshape(d, n), scale)


class Best:
    """The k best of each query of a group so far, best first: score, whether without id, id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.rows: list[list[tuple]] = [[] for _ in range(queries)]

    def floor(self, q: int):
        """The score that a candidate must reach, None if any will do."""
        return -self.rows[q][-1][0] if len(self.rows[q]) == self.k else None

    def add(self, q: int, scores: np.ndarray, known: np.ndarray, ids: np.ndarray) -> None:
        order = np.lexsort((ids, 1 - known, -scores))[: self.k] if scores.dtype != object else sorted(range(len(scores)), key=lambda i: (-scores[i], 1 - known[i], ids[i]))[: self.k]
        self.rows[q] = sorted([*self.rows[q], *((-scores[i], 1 - int(known[i]), int(ids[i])) for i in order)])[: self.k]


def _large(q: Block, s: Block) -> bool:
    """Whether a sum may leave the range in which doubles are exact."""
    if q.x.dtype == object or s.x.dtype == object:
        return True
    norms = [float(np.sqrt((b.x * b.x).sum(axis=0).max(initial=0.0))) for b in (q, s)]
    return not max(norms[0] * norms[1], norms[0] ** 2, norms[1] ** 2) < EXACT / 4


def _plain(q: Block, s: Block, best: Best) -> None:
    """All sums in Python's whole numbers, for values beyond the doubles' exact range."""
    exact = lambda x: x if x.dtype == object else np.array([[int(c) for c in row] for row in x], dtype=object).reshape(x.shape)
    a, b = exact(q.x), exact(s.x)
    for i in range(a.shape[1]):
        scores = sum((a[j, i] * b[j] for j in range(len(a))), np.array([0] * b.shape[1], dtype=object))
        other = s.rows != q.rows[i]
        best.add(i, scores[other], s.known[other], s.ids[other])


def _seeds(x: np.ndarray, y: np.ndarray, sums: np.ndarray, k: int) -> np.ndarray:
    """A score that k candidates of each query reach for certain: the least whole score of those that lead so far."""
    lead = np.argpartition(sums, sums.shape[1] - k, axis=1)[:, sums.shape[1] - k :]
    whole = np.einsum("dq,dqk->qk", x, y[:, lead])
    return np.where(np.isfinite(np.take_along_axis(sums, lead, axis=1)), whole, -np.inf).min(axis=1)


def search(q: Block, s: Block, best: Best, step: int = STEP, dense: float = DENSE) -> int:
    """Brings a block's rows into the best of a group; the number of products that were made."""
    if not s.x.shape[1]:
        return 0
    if _large(q, s):
        _plain(q, s, best)
        return q.x.size * s.x.shape[1]
    d, n = s.x.shape
    order = np.argsort(-(q.x * q.x).sum(axis=1), kind="stable")
    mass_q, mass_s = (q.x * q.x).sum(axis=0), (s.x * s.x).sum(axis=0)
    made = 0
    for at in range(0, q.x.shape[1], CHUNK):
        who = np.arange(at, min(at + CHUNK, q.x.shape[1]))
        floors = np.array([-np.inf if (f := best.floor(int(i))) is None else f for i in who])
        left_q, left_s = mass_q[who].copy(), mass_s.copy()
        own = s.rows[None, :] == q.rows[who][:, None]
        sums = np.zeros((len(who), n))
        done = 0
        # Side by side, as matrix products, while many candidates are left.
        alive = ~own
        while done < d:
            dims = order[done : done + step]
            sums += q.x[np.ix_(dims, who)].T @ s.x[dims]
            made += len(dims) * len(who) * n
            done += len(dims)
            left_q -= (q.x[np.ix_(dims, who)] ** 2).sum(axis=0)
            left_s -= (s.x[dims] ** 2).sum(axis=0)
            rest = np.sqrt(np.maximum(left_q, 0))[:, None] * np.sqrt(np.maximum(left_s, 0))[None, :]
            rest = rest * (1 + 1e-12) + (0.5 if done < d else 0.0)  # above any rounding; scores are whole
            if n > best.k:
                low = np.where(alive, sums - rest, -np.inf)
                floors = np.maximum(floors, np.partition(low, n - best.k, axis=1)[:, n - best.k])
                if done <= 2 * step:
                    floors = np.maximum(floors, _seeds(q.x[:, who], s.x, np.where(alive, sums, -np.inf), best.k))
            alive &= sums + rest >= floors[:, None]
            if alive.mean() < dense:
                break
        row, col = np.nonzero(alive)
        part = sums[row, col]
        # Survivors alone, packed together, dimension by dimension.
        while done < d:
            dims = order[done : done + step]
            for j in dims:
                part += q.x[j][who[row]] * s.x[j][col]
            made += len(dims) * len(row)
            done += len(dims)
            left_q -= (q.x[np.ix_(dims, who)] ** 2).sum(axis=0)
            left_s -= (s.x[dims] ** 2).sum(axis=0)
            rest = np.sqrt(np.maximum(left_q, 0))[row] * np.sqrt(np.maximum(left_s, 0))[col] * (1 + 1e-12) + (0.5 if done < d else 0.0)
            cuts = np.searchsorted(row, np.arange(len(who) + 1))
            for i, (b, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if e - b > best.k:
                    floors[i] = max(floors[i], np.partition(part[b:e] - rest[b:e], e - b - best.k)[e - b - best.k])
            keep = part + rest >= floors[row]
            row, col, part = row[keep], col[keep], part[keep]
        cuts = np.searchsorted(row, np.arange(len(who) + 1))
        for i, (b, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if e > b:
                c = col[b:e]
                best.add(int(who[i]), part[b:e].astype(np.int64), s.known[c], s.ids[c])
    return made


def _shown(score: int) -> tuple[int, int, bytes]:
    """The score as far as a long shows it, and what orders scores beyond: the side, and bytes that sort as they do."""
    if _LONG[0] <= score <= _LONG[1]:
        return score, 0, b""
    size = abs(score)
    data = ((size.bit_length() + 7) // 8).to_bytes(4) + size.to_bytes((size.bit_length() + 7) // 8)
    return (_LONG[1], 1, data) if score > 0 else (_LONG[0], -1, bytes(255 - b for b in data))


def _walk(batches: Iterator[pa.RecordBatch], k: int, scale: int) -> Iterator[pa.RecordBatch]:
    """The best of each group and share: first the group's row (block -1), then the share's blocks."""
    now, group, best = None, None, None

    def found() -> pa.RecordBatch:
        out = [(int(group.rows[i]), int(group.ids[i]), None if unknown else ident, *_shown(-int(score))) for i, rows in enumerate(best.rows) for score, unknown, ident in rows]
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        kinds = {"query_row": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64(), "side": pa.int32(), "beyond": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    for b in batches:
        for d, g, share, block, n, data in zip(*(b.column(c) for c in ("d", "g", "share", "block", "n", "data")), strict=True):
            key, block = (d.as_py(), g.as_py(), share.as_py()), block.as_py()
            if key != now:
                if now is not None:
                    yield found()
                now = None
                if block != -1:
                    continue  # a group number that no query has
                now, group, best = key, Block(data.as_py(), n.as_py(), key[0], scale), Best(n.as_py(), k)
            else:
                search(group, Block(data.as_py(), n.as_py(), key[0], scale), best)
    if now is not None:
        yield found()


def _dealt(rows: DataFrame, most: int, scale: int) -> DataFrame:
    """Rows in blocks of some ``most`` rows of one length, packed one row a block.

    Rows are dealt by a hash of their number; a block's rows are a matter of
    chance but not of any value, so no value fills a block.
    """
    numbers = rows.groupBy("d").agg(F.count("*").alias("n_d"))
    cap = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(NUMBERS) / F.greatest("d", F.lit(1)))))
    counted = numbers.select(C.apart(F.xxhash64("d")).alias("_k"), F.ceil(F.col("n_d") / cap).cast("long").alias("blocks"))
    dealt = rows.withColumn("_k", C.apart(F.xxhash64("d"))).join(F.broadcast(counted) if counted.count() <= 10_000 else counted, "_k")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks"))).select("d", "block", "vec_id", "row", "v")
    return dealt.repartition("d", "block").sortWithinPartitions("d", "block", "row").mapInArrow(lambda it: C.lean(_pack(it, scale)), "d int, block long, n int, data binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", store_rows: int = STORE, group_rows: int = GROUP) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k candidates of highest score for every query row.

    Each component x becomes floor(scale * x); the score is the inner product
    of these. ``is_query`` is a condition on ``vec_id`` (null: no query); the
    candidates of a query are all rows but itself, also those that repeat its id
    or its vector. Ties go to the smaller id, rows without an id come last. Null
    vectors and those with null or non-finite components take no part; vectors
    of different length do not meet, and empty ones score 0 with each other.
    Scores beyond the range of a long rank by their value and show its limit.
    Fewer candidates than k give fewer rows; an empty table, or one without
    queries, gives none. Columns other than the two named are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v")))
    rows = C.durable(rows.select("vec_id", "v", F.size("v").alias("d"), F.monotonically_increasing_id().alias("row")))
    store = C.durable(_dealt(rows, store_rows, scale))
    asked = C.durable(_dealt(rows.where(F.coalesce(is_query, F.lit(False))), group_rows, scale).withColumnRenamed("block", "g"))
    groups = asked.groupBy("d").agg((F.max("g") + 1).alias("groups"))
    lengths, most = groups.agg(F.count("*"), F.coalesce(F.max("groups"), F.lit(1))).first()
    # As many shares as keep the tasks busy: the fewer, the better a block is pruned by those before it.
    shares = max(1, -(-4 * rows.sparkSession.sparkContext.defaultParallelism // most))
    every = F.explode(F.sequence(F.lit(0), F.lit(shares - 1)).cast("array<long>")).alias("share")
    heads = asked.select("d", "g", every, F.lit(-1).cast("long").alias("block"), "n", "data")
    met = store.join(F.broadcast(groups) if lengths <= 10_000 else groups, "d")
    met = met.select("d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("g"), F.pmod("block", F.lit(shares)).cast("long").alias("share"), "block", "n", "data")
    dealt = heads.unionByName(met).repartition("d", "g", "share").sortWithinPartitions("d", "g", "share", "block")
    walked = dealt.mapInArrow(lambda it: C.lean(_walk(it, k, scale)), "query_row long, query_id long, vec_id long, score long, side int, beyond binary")
    order = Window.partitionBy("query_row").orderBy(F.desc("side"), F.desc("score"), F.desc("beyond"), F.asc_nulls_last("vec_id"))
    return walked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the ten highest scores of every hundredth vector against all others."""
    return top_k(C.table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, s.vec_id, CAST(list_sum(list_transform(list_zip(q.x, s.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v s ON s.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
