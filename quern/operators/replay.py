"""Order-dependent replay of requests against a cache that they fill.

Whether a request is stored depends on every decision before it, so a
configuration is replayed in order by one task and configurations run in
parallel. A task streams its sorted partition and holds only what the cache
itself holds, never the whole group. Large configurations are settled in
parallel rounds instead (``rounds``), with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.columns import config_id, normalised, prompt_key
from quern.operators import rounds
from quern.operators.shared import few

LLM, EXACT, SEMANTIC = "llm", "exact_cache", "semantic_cache"
OUT = "config string, seq long, source string, similarity double, matched_seq long, stored boolean"


class Cache:
    """An exact store that drops its first-in entry when full, and an unbounded semantic index."""

    def __init__(self, max_size: int | None = None, ttl: float | None = None, exact: bool = True, semantic: bool = True):
        self.max_size, self.ttl, self.exact, self.semantic = max_size, ttl, exact, semantic
        self.store: dict[str, tuple[int, float | None]] = {}
        self.seqs: list[int] = []
        self.size = 0
        self.vectors = np.zeros((0, 0))
        self.squares = np.zeros(0)

    def nearest(self, q: np.ndarray) -> tuple[int, float] | None:
        if not self.size:
            return None
        m = self.vectors[: self.size]
        rough = self.squares[: self.size] - 2 * (m @ q)
        near = np.flatnonzero(rough <= rough.min() + 1e-9)
        d = np.sqrt(((m[near] - q) ** 2).sum(axis=1))
        best = int(near[np.argmin(d)])  # the first of equals: the least id
        return best, float(d.min())

    def submit(self, seq: int, key: str, vector: np.ndarray | None, threshold: float, now: float | None, failed: bool = False) -> tuple[str, float | None, int | None, bool]:
        """(source, similarity, the request that was matched, whether this one was stored); a failed call stores nothing."""
        if self.exact and (found := self.store.get(key)):
            if found[1] is not None and now is not None and now > found[1]:
                del self.store[key]
            else:
                return EXACT, 1.0, found[0], False
        if self.semantic and vector is not None and (hit := self.nearest(vector)):
            sim = 1.0 / (1.0 + hit[1])
            if not sim < threshold:
                return SEMANTIC, sim, self.seqs[hit[0]], False
        if failed:
            return LLM, None, None, False
        if self.max_size is not None and self.store and len(self.store) >= self.max_size:
            del self.store[next(iter(self.store))]
        self.store[key] = (seq, None if self.ttl is None or now is None else now + self.ttl)
        if self.semantic and vector is not None:
            self._add(seq, vector)
        return LLM, None, None, True

    def _add(self, seq: int, v: np.ndarray) -> None:
        if self.size == len(self.squares):
            room = max(256, 2 * self.size)
            grown = np.zeros((room, len(v)))
            grown[: self.size] = self.vectors[: self.size] if self.size else 0
            self.vectors, self.squares = grown, np.resize(self.squares, room) if self.size else np.zeros(room)
        self.vectors[self.size], self.squares[self.size] = v, v @ v
        self.seqs.append(seq)
        self.size += 1


def _kernel(batches: Iterator[pa.RecordBatch], options: dict, carry: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    config, cache = None, None
    kinds = (pa.string(), pa.float64(), pa.int64(), pa.bool_())
    for b in batches:
        if not b.num_rows:
            continue
        configs, seqs, keys, thresholds, nows, failed = (b.column(n).to_pylist() for n in ("config", "seq", "key", "threshold", "now", "failed"))
        vectors = b.column("vector") if "vector" in b.schema.names else None
        out = []
        for i, c in enumerate(configs):
            if cache is None or c != config:
                config, cache = c, Cache(**options)
            v = vectors[i].values if vectors is not None else None
            v = None if v is None else v.to_numpy(zero_copy_only=False)
            out.append(cache.submit(seqs[i], keys[i], v, thresholds[i], nows[i], failed[i]))
        decided = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column("config"), b.column("seq"), *decided, *[b.column(f"carry_{n}") for n in carry]], names=["config", "seq", "source", "similarity", "matched_seq", "stored", *carry]
        )


def replay(
    requests: DataFrame, max_size: int | None = None, ttl: float | None = None, exact: bool = True, semantic: bool = True, carry: tuple[str, ...] = (), hot: int | None = None, **sizes: int
) -> DataFrame:
    """Decisions ``(config, seq, source, similarity, matched_seq, stored, *carry)``.

    ``requests``: config, seq (unique within it), prompt or key, and where used
    vector (array), threshold, now (seconds) and failed (whether a call for the
    request would fail: it then stores nothing). Vectors are normalised here.
    Columns named in ``carry`` pass through, so a result need not be joined.

    Configurations of more than ``hot`` requests are settled in rounds, those of
    up to ``hot`` by a task each (None: all). That takes an index that never
    forgets, so with a lifetime or without vectors every one has its task.
    ``sizes``: the rounds' ``block`` and ``front``.
    """
    has = set(requests.columns)
    rows = requests.select(
        F.col("config").cast("string").alias("config"),
        F.col("seq").cast("long").alias("seq"),
        (F.col("key") if "key" in has else prompt_key(F.col("prompt"))).alias("key"),
        *([normalised(F.col("vector")).alias("vector")] if "vector" in has else []),
        (F.col("threshold").cast("double") if "threshold" in has else F.lit(None).cast("double")).alias("threshold"),
        (F.col("now").cast("double") if "now" in has else F.lit(None).cast("double")).alias("now"),
        (F.coalesce(F.col("failed"), F.lit(False)) if "failed" in has else F.lit(False)).alias("failed"),
        *[F.col(c).alias(f"carry_{c}") for c in carry],
    )
    options = {"max_size": max_size, "ttl": ttl, "exact": exact, "semantic": semantic and "vector" in has}
    schema = ", ".join([OUT, *[f"`{c}` {requests.schema[c].dataType.simpleString()}" for c in carry]])

    def by_task(some: DataFrame) -> DataFrame:
        return some.repartition("config").sortWithinPartitions("config", "seq").mapInArrow(lambda it: _kernel(it, options, carry), schema)

    if hot is None or ttl is not None or not options["semantic"]:
        return by_task(rows)

    def in_rounds(some: DataFrame) -> DataFrame:
        got = rounds.settled(some.drop("now"), max_size, exact, **sizes)
        return got.select("config", "seq", "source", "similarity", "matched_seq", "stored", *[F.col(f"carry_{c}").alias(c) for c in carry])

    if hot <= 0:
        return in_rounds(rows)
    large = rows.groupBy("config").count().where(F.col("count") > hot).select("config")
    n = large.count()
    if not n:
        return by_task(rows)
    return in_rounds(rows.join(few(large, n), "config", "left_semi")).unionByName(by_task(rows.join(few(large, n), "config", "left_anti")))


def outcome(hit, label):
    """TP, FP, TN or FN of a decision against a 0/1 label."""
    return F.when(hit & (label == 1), "TP").when(hit, "FP").when(label == 1, "FN").otherwise("TN")


def pair_requests(pairs: DataFrame, grid: DataFrame) -> DataFrame:
    """Two requests a pair and configuration, the second right after the first.

    ``pairs``: pair_id, workload, seq, model, key_1, key_2, vector_1, vector_2,
    label; ``grid``: model, workload, threshold. Each configuration starts with
    an empty cache.
    """
    met = pairs.join(F.broadcast(grid), ["model", "workload"])
    twice = F.posexplode(F.array(F.struct(F.col("key_1").alias("key"), F.col("vector_1").alias("vector")), F.struct(F.col("key_2").alias("key"), F.col("vector_2").alias("vector")))).alias("place", "q")
    rows = met.select(config_id(F.col("model"), F.col("workload"), F.col("threshold")).alias("config"), "model", "workload", "threshold", "pair_id", "label", F.col("seq").alias("pair_seq"), twice)
    return rows.select("config", "model", "workload", "threshold", "pair_id", "label", "place", (F.col("pair_seq") * 2 + F.col("place")).alias("seq"), F.col("q.key").alias("key"), F.col("q.vector").alias("vector"))


def sweep(pairs: DataFrame, grid: DataFrame, **options) -> DataFrame:
    """The decision on each pair's second query in every configuration of the grid."""
    decided = replay(pair_requests(pairs, grid), carry=("model", "workload", "threshold", "pair_id", "label", "place"), **options)
    hit = F.col("source").isin(EXACT, SEMANTIC)
    return decided.where("place = 1").select(
        F.col("config").alias("config_id"), "model", "workload", "threshold", "pair_id", F.when(hit, "hit").otherwise("miss").alias("decision"), "source", "similarity", "label", outcome(hit, F.col("label")).alias("outcome"), "seq",
    )
