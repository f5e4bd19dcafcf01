"""An inverted file: approximate nearest neighbours with a measured recall.

Cells are learned (k-means on a bounded sample); every row goes to its nearest
cell with a code of what is left, the residual, by product quantisation: its parts
are replaced by the nearest of 256 learned parts each. A query probes the
cells nearest to it, sums up table entries instead of components over their codes,
and the best candidates are ranked again by their original vectors.

How many cells are probed and how many candidates are ranked again is not
guessed: rows held out of the fit are searched exactly, and both numbers are the
least that keep ``recall`` of their neighbours. The index is a folder: a model,
the packed cells and the vectors. Batches are appended by name, so one that is
written again after a failure replaces itself.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.columns import l2_distance, similarity
from quern.operators import cells as C
from quern.operators.shared import durable, few

#: Rows that the fit sees at most, rows held out to measure recall, cells and candidates a query, at most.
SAMPLE, HELD, CELLS, DEPTH = 16384, 256, 4096, 2000
ROUNDS, WORDS, BOOK_ROWS = 12, 256, 8192
RECALL = 0.95


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """k centres at most; a centre that loses all its rows moves to the row that is worst served."""
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        d = C.distances(x, centres)
        own = d.argmin(axis=1)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        full = n > 0
        centres[full] = sums[full] / n[full][:, None]
        if not full.all():
            worst = np.argsort(-d[np.arange(len(x)), own])[: int((~full).sum())]
            centres[np.flatnonzero(~full)[: len(worst)]] = x[worst]
    return centres


class Model:
    """``centres`` of cells; ``books[m]`` the parts that part m of a residual is replaced by; ``cuts`` the parts' bounds."""

    def __init__(self, centres: np.ndarray, books: list[np.ndarray], cuts: np.ndarray, probes: int = 1, depth: int = 1):
        self.centres, self.books, self.cuts, self.probes, self.depth = centres, books, cuts, probes, depth

    @classmethod
    def fit(cls, x: np.ndarray, n: int, seed: int = 42) -> Model:
        rng = np.random.default_rng(seed)
        d = x.shape[1]
        centres = k_means(x, int(min(CELLS, max(1, round(np.sqrt(n)), 1), max(1, len(x) // 8))), rng)
        rest = x - centres[C.distances(x, centres).argmin(axis=1)]
        rest = rest[:BOOK_ROWS]
        cuts = np.linspace(0, d, min(d, max(1, -(-d // 4))) + 1).astype(int)
        return cls(centres, [k_means(rest[:, a:b], WORDS, rng, 6) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], cuts)

    def order(self, x: np.ndarray) -> np.ndarray:
        """Each row's cells, nearest first."""
        return np.argsort(C.distances(x, self.centres), axis=1, kind="stable")

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = C.distances(x, self.centres).argmin(axis=1)
        rest = x - self.centres[cell]
        code = [C.distances(rest[:, a:b], book).argmin(axis=1) for book, a, b in zip(self.books, self.cuts[:-1], self.cuts[1:], strict=True)]
        return cell, np.stack(code, axis=1).astype(np.uint8)

    def rough(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to a cell's rows, by their codes."""
        rest = q - self.centres[cell]
        out = np.zeros((len(q), len(codes)))
        for m, (book, a, b) in enumerate(zip(self.books, self.cuts[:-1], self.cuts[1:], strict=True)):
            out += (C.distances(rest[:, a:b], book) ** 2)[:, codes[:, m]]
        return out

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, centres=self.centres, cuts=self.cuts, numbers=np.array([self.probes, self.depth]), **{f"book{m}": b for m, b in enumerate(self.books)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Model:
        z = np.load(io.BytesIO(data))
        return cls(z["centres"], [z[f"book{m}"] for m in range(len(z["cuts"]) - 1)], z["cuts"], *map(int, z["numbers"]))


def _encode(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 2048):
            some = b.slice(at, 2048)
            cell, code = model.encode(C._matrix(some.column("v"), some.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), some.column("i"), pa.array([c.tobytes() for c in code], pa.binary())], names=["cell", "i", "code"])


def _pack(t: pa.Table) -> pa.Table:
    """A piece of a cell as one row."""
    t = t.sort_by("i")
    ids, codes = t.column("i").to_pylist(), b"".join(t.column("code").to_pylist())
    return pa.table([t.column("cell").slice(0, 1), t.column("piece").slice(0, 1), pa.array([ids], pa.list_(pa.int64())), pa.array([codes], pa.binary())], names=["cell", "piece", "ids", "codes"])


def _probe(batches: Iterator[pa.RecordBatch], model: Model, probes: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 2048):
            some = b.slice(at, 2048)
            near = model.order(C._matrix(some.column("v"), some.num_rows))[:, :probes]
            cells = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1]).astype(np.int32)), pa.array(near.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([some.column("i"), some.column("v"), cells], names=["i", "v", "cells"])


class Nearest:
    """The ``depth`` nearest of each of some queries, from what pieces bring one after the other."""

    def __init__(self, queries: np.ndarray, depth: int):
        self.ids, self.depth = np.sort(queries), depth
        self.bound = np.full(len(queries), np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, q: np.ndarray, n: np.ndarray, d: np.ndarray) -> None:
        near = d <= self.bound[np.searchsorted(self.ids, q)]
        self.found.append((q[near], n[near], d[near]))
        self.rows += int(near.sum())
        if self.rows > 4 * self.depth * len(self.ids) + (1 << 16):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, n, d = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((n, d, q))
        q, n, d = q[order], n[order], d[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.depth - 1
        self.bound[np.searchsorted(self.ids, q[last])] = d[last]
        keep = place < self.depth
        self.found, self.rows = [(q[keep], n[keep], d[keep])], int(keep.sum())
        return self.found[0]


def _candidates(batches: Iterator[pa.RecordBatch], model: Model, depth: int, same: bool) -> Iterator[pa.RecordBatch]:
    """``(query_id, neighbour_id, distance)`` by code: first the queries of a part and share, then the pieces that they probe."""
    now, best, at, x, probed = None, None, None, None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(z) for z in best.cut()], names=["query_id", "neighbour_id", "distance"])

    for b in batches:
        for part, share, cell, queries, ids, codes in zip(*(b.column(c) for c in ("part", "share", "cell", "q", "ids", "codes")), strict=True):
            key = (part.as_py(), share.as_py())
            if key != now:
                if best is not None and best.found:
                    yield done()
                now, best = key, None
            if queries.is_valid:  # the part's row, which sorts first
                flat = queries.values
                at, x, probed = flat.field("i").to_numpy(), C._matrix(flat.field("v"), len(flat)), C._matrix(flat.field("cells"), len(flat))
                best = Nearest(at, depth)
                continue
            who = np.flatnonzero((probed == cell.as_py()).any(axis=1))
            if best is None or not len(who):
                continue
            si = ids.values.to_numpy()
            d = model.rough(x[who], cell.as_py(), np.frombuffer(codes.as_py(), np.uint8).reshape(len(si), -1))
            if not same:
                d[at[who][:, None] == si[None, :]] = np.inf
            near = min(depth, d.shape[1])
            a, c = np.nonzero((d <= np.partition(d, near - 1, axis=1)[:, near - 1][:, None]) & np.isfinite(d))
            best.add(at[who][a], si[c], np.sqrt(d[a, c]))
    if best is not None and best.found:
        yield done()


class InvertedFile:
    """An index in ``folder``; made by ``build`` or found by ``open``."""

    def __init__(self, spark: SparkSession, folder: str, model: Model):
        self.spark, self.folder, self.model = spark, folder, model

    @classmethod
    def build(cls, store: DataFrame, folder: str, ident: str = "vec_id", vector: str = "embedding", k: int = 10, recall: float = RECALL, sample: int = SAMPLE, seed: int = 42) -> InvertedFile:
        """Learns on ``sample`` rows at most, indexes every row, and measures on rows left out what keeps ``recall`` of ``k`` neighbours.

        Null vectors and those with null or non-finite components are not
        indexed. Ids are unique. An empty store makes an index that finds nothing.
        """
        spark = store.sparkSession
        rows = durable(C.unit_rows(store, ident, vector))
        n = rows.count()
        h = F.xxhash64(F.lit(seed), "i")
        drawn = rows.where(F.pmod(h, F.lit(max(1, n // (2 * (sample + HELD))))) == 0).select("i", "v", h.alias("h")).orderBy("h", "i").limit(min(sample + HELD, n)).collect()
        out = max(1, min(HELD, len(drawn) // 4))
        held, seen = drawn[:out], drawn[out:] or drawn
        if seen:
            index = cls(spark, folder, Model.fit(np.array([r.v for r in seen], np.float64).reshape(len(seen), -1), n, seed))
            index._write(rows, "first")
            index._calibrate(held, rows, k, recall)
        else:
            index = cls(spark, folder, Model(np.zeros((0, 0)), [], np.zeros(1, int)))
        spark.createDataFrame([(bytearray(index.model.dump()),)], "model binary").coalesce(1).write.mode("overwrite").parquet(f"{folder}/model")
        return index

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> InvertedFile:
        return cls(spark, folder, Model.load(bytes(spark.read.parquet(f"{folder}/model").first().model)))

    def append(self, store: DataFrame, batch: str, ident: str = "vec_id", vector: str = "embedding") -> None:
        """More rows under a name of their own; the same name again replaces that batch."""
        if not len(self.model.centres):
            raise ValueError("an index that was built of no rows has no cells to append to")
        if batch == "first":
            raise ValueError("the batch 'first' is the one that the index was built with")
        self._write(durable(C.unit_rows(store, ident, vector)), batch)

    def _write(self, rows: DataFrame, batch: str) -> None:
        model = self.model
        coded = rows.mapInArrow(lambda it: _encode(it, model), "cell int, i long, code binary")
        placed = C.numbered(durable(coded), "cell", "i").withColumn("piece", F.floor(F.col("pos") / (4 * C.PIECE)))
        packed = placed.select("cell", "piece", "i", "code").groupBy("cell", "piece").applyInArrow(_pack, "cell int, piece long, ids array<long>, codes binary")
        packed.write.mode("overwrite").parquet(f"{self.folder}/cells/batch={batch}")
        rows.write.mode("overwrite").parquet(f"{self.folder}/vectors/batch={batch}")

    def _read(self, what: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{what}")

    def candidates(self, asked: DataFrame, probes: int, depth: int, same: bool = False) -> DataFrame:
        """``(query_id, neighbour_id, distance, rank)``: the ``depth`` best by code for ``asked(i, v)``."""
        model = self.model
        near = asked.mapInArrow(lambda it: _probe(it, model, probes), "i long, v array<double>, cells array<int>")
        parts = max(1, -(-asked.count() // C.PART))
        grouped = durable(near.withColumn("part", F.pmod(F.xxhash64("i"), F.lit(parts))).groupBy("part").agg(F.collect_list(F.struct("i", "v", "cells")).alias("q")))
        # As many shares of the cells as keep the tasks busy; a share's pieces follow each other, so only its best leave it.
        shares = max(1, -(-4 * self.spark.sparkContext.defaultParallelism // parts))
        of_cell = F.pmod(F.xxhash64("cell"), F.lit(shares)).cast("int")
        wanted = durable(grouped.select("part", F.explode(F.array_distinct(F.flatten("q.cells"))).alias("cell")))
        pieces = wanted.join(self._read("cells").select("cell", "ids", "codes"), "cell").select("part", of_cell.alias("share"), "cell", F.lit(1).alias("kind"), "ids", "codes")
        heads = grouped.select("part", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("kind"), "q")
        met = heads.unionByName(pieces, allowMissingColumns=True).repartition("part", "share").sortWithinPartitions("part", "share", "kind")
        return C.best(met.mapInArrow(lambda it: _candidates(it, model, depth, same), "query_id long, neighbour_id long, distance double"), depth)

    def _exact(self, found: DataFrame, asked: DataFrame) -> DataFrame:
        """The candidates' distances by their vectors."""
        held = durable(found.select("query_id", "neighbour_id"))
        n = held.count()
        with_q = held.join(few(asked.select(F.col("i").alias("query_id"), F.col("v").alias("_q")), asked.count(), 20_000), "query_id")
        vectors = self._read("vectors").select(F.col("i").alias("neighbour_id"), "v")
        ids = durable(held.select("neighbour_id").distinct())
        wanted = vectors.join(few(ids, n, 1_000_000), "neighbour_id", "left_semi")
        return with_q.join(wanted, "neighbour_id").select("query_id", "neighbour_id", l2_distance(F.col("_q"), F.col("v")).alias("distance"))

    def search(self, queries: DataFrame, k: int = 10, ident: str = "vec_id", vector: str = "embedding", same: bool = False, probes: int | None = None, depth: int | None = None) -> DataFrame:
        """``(query_id, rank, neighbour_id, distance, similarity)``, distances exact; ties by the lesser id."""
        if not len(self.model.centres):
            return self.spark.createDataFrame([], "query_id long, rank int, neighbour_id long, distance double, similarity double")
        asked = durable(C.unit_rows(queries, ident, vector))
        found = self.candidates(asked, probes or self.model.probes, max(k, depth or self.model.depth), same)
        return C.best(self._exact(found, asked), k).select("query_id", "rank", "neighbour_id", "distance", similarity(F.col("distance")).alias("similarity"))

    def _calibrate(self, held: list, rows: DataFrame, k: int, recall: float) -> None:
        """Sets probes and depth: each step may lose a third of what may be lost."""
        keep = 1 - (1 - recall) / 3
        at = {r.i: r.v for r in held}
        x = np.array(list(at.values()), np.float64).reshape(len(at), -1)
        true = durable(C.scan(list(at), x, rows, k).select("query_id", "neighbour_id"))
        where = self._read("cells").select(F.explode("ids").alias("neighbour_id"), "cell").join(few(true, len(at) * k), "neighbour_id").select("query_id", "neighbour_id", "cell").collect()
        if not where:
            return
        order = dict(zip(at, self.model.order(x), strict=True))
        ranks = np.sort([int(np.flatnonzero(order[r.query_id] == r.cell)[0]) for r in where])
        self.model.probes = int(ranks[min(len(ranks) - 1, int(np.ceil(keep * len(ranks))) - 1)]) + 1
        asked = rows.sparkSession.createDataFrame(list(at.items()), "i long, v array<double>")
        found = self.candidates(asked, self.model.probes, DEPTH).select("query_id", "neighbour_id", "rank")
        seen = np.sort([r["rank"] for r in found.join(few(true, len(at) * k), ["query_id", "neighbour_id"]).collect()])
        if len(seen):
            self.model.depth = int(min(DEPTH, max(k, 1.5 * seen[min(len(seen) - 1, int(np.ceil(keep * len(seen))) - 1)])))


def measured_recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``(queries, neighbours, recall)``: the share of the exact neighbours that were found."""
    hits = exact.select("query_id", "neighbour_id").join(found.select("query_id", "neighbour_id", F.lit(1).alias("hit")), ["query_id", "neighbour_id"], "left")
    return hits.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("neighbours"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
