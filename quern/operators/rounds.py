"""Replay of large configurations in parallel rounds.

With a semantic index that never forgets, a request is stored if no stored
request before it is similar enough (or has its key in the exact store). Of the
graph that links similar requests, the stored ones are the lexicographically
first maximal independent set, and that set can be found without walking through
the requests one by one:

* a request is out as soon as any stored one before it is similar;
* the first requests that are not out, a *front* of bounded size, are settled
  among themselves, because everything before them has been;
* the front's new entries are then compared with all later requests at once, in
  blocks, which rules most of them out for good and gives each its nearest
  entry so far.

So a task holds a front or a block of requests and never a configuration, and
the rounds are as many as the stored entries fill fronts. What is compared is
requests with entries, as in any replay. Whether a hit was exact needs no order
at all: an entry is in the exact store until as many were stored after it as the
store holds, so a join on the key with the entries' ranks tells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.columns import similarity
from quern.operators.shared import durable, few, numbered

#: Requests of a block, and undecided ones of a front: a front is of whole blocks.
BLOCK, FRONT = 2048, 4096
#: A product's rounding is far below this; what is so near a limit is measured directly.
SLACK = 1e-9
#: Rounds after which their results are written as one table.
_MERGE = 20
_ROWS = 512


def _matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a vector, their vectors)."""
    has = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
    if not len(has):
        return has, np.zeros((0, 0))
    some = vectors.take(pa.array(has))
    return has, some.flatten().to_numpy(zero_copy_only=False).reshape(len(has), -1)


def _hits(x: np.ndarray, squares: np.ndarray, at: int, upto: int, threshold: np.ndarray) -> np.ndarray:
    """Whether rows ``at`` to ``upto`` are similar enough to each row before ``upto``, as direct distances decide."""
    rough = squares[at:upto, None] + squares[None, :upto] - 2 * (x[at:upto] @ x[:upto].T)
    with np.errstate(divide="ignore"):
        limit = np.square(1.0 / threshold[at:upto] - 1.0)[:, None]
    hit = rough <= limit
    i, j = np.nonzero(np.abs(rough - limit) <= SLACK)
    for s in range(0, len(i), 1 << 16):
        a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
        d = np.sqrt(((x[b] - x[a + at]) ** 2).sum(axis=1))
        hit[a, b] = ~(1.0 / (1.0 + d) < threshold[a + at])
    return hit


def _settle(t: pa.Table, cap: int | None, exact: bool) -> pa.Table:
    """The entries that a configuration's front stores, in order, each with its rank among all stored."""
    t = t.sort_by("seq").combine_chunks()
    n = t.num_rows
    keys, held = t.column("key").to_pylist(), t.column("held").to_pylist()
    has, x = _matrix(t.column("vector").combine_chunks())
    row = np.full(n, -1)
    row[has] = np.arange(len(has))
    threshold = t.column("threshold").to_numpy().astype(np.float64)[has]
    squares = (x * x).sum(axis=1)
    entry = np.zeros(len(has), dtype=bool)
    stored: list[int] = []
    own: dict[str, int] = {}
    rank = base = t.column("base")[0].as_py()
    at, near = 0, np.zeros((0, 0), dtype=bool)
    for i in range(n):
        r = row[i]
        if r >= at + len(near):
            at = int(r)
            near = _hits(x, squares, at, min(at + _ROWS, len(has)), threshold)
        if exact:
            last = own.get(keys[i], held[i])
            if last is not None and (cap is None or last >= rank - cap):
                continue
        if r >= 0:
            if (near[r - at, :r] & entry[:r]).any():
                continue
            entry[r] = True
        own[keys[i]] = rank
        stored.append(i)
        rank += 1
    out = t.take(pa.array(stored, pa.int64())).select(["config", "seq", "key", "vector"])
    return out.append_column("rank", pa.array(np.arange(base, rank), pa.int64()))


def _apply(t: pa.Table, forever: bool, state: list[str]) -> pa.Table:
    """A block's requests with their nearest entry so far, after the front's new entries (rows of kind 0)."""
    t = t.combine_chunks()
    kind = t.column("kind").to_numpy()
    e = t.filter(pa.array(kind == 0)).sort_by("seq").combine_chunks()
    q = t.filter(pa.array(kind == 1)).combine_chunks()
    seqs, entry_seqs = q.column("seq").to_numpy(), e.column("seq").to_numpy()
    before = np.searchsorted(entry_seqs, seqs)
    stored = np.isin(seqs, entry_seqs)
    best_d = q.column("best_d").fill_null(np.inf).to_numpy().copy()
    best_seq = q.column("best_seq").fill_null(-1).to_numpy().copy()
    (qh, qx), (eh, ex) = _matrix(q.column("vector").combine_chunks()), _matrix(e.column("vector").combine_chunks())
    if len(qh) and len(eh):
        squares = (ex * ex).sum(axis=1)
        entries = entry_seqs[eh]
        for at in range(0, len(qh), _ROWS):
            rows = qh[at : at + _ROWS]
            x = qx[at : at + _ROWS]
            rough = squares[None, :] - 2 * (x @ ex.T)
            rough[entries[None, :] >= seqs[rows][:, None]] = np.inf
            a, b = np.nonzero((rough <= rough.min(axis=1)[:, None] + SLACK) & np.isfinite(rough))
            d = np.sqrt(((ex[b] - x[a]) ** 2).sum(axis=1))
            order = np.lexsort((entries[b], d, a))
            a, b, d = a[order], b[order], d[order]
            first = np.r_[True, a[1:] != a[:-1]] if len(a) else np.zeros(0, bool)
            a, b, d = a[first], b[first], d[first]
            nearer = d < best_d[rows[a]]  # of equals the earlier entry stays
            best_d[rows[a][nearer]], best_seq[rows[a][nearer]] = d[nearer], entries[b[nearer]]
    known = q.column("known").to_numpy(zero_copy_only=False)
    if forever:
        first = dict(zip(reversed(e.column("key").to_pylist()), reversed(entry_seqs.tolist()), strict=True))
        known = known | np.array([first.get(k, s) < s for k, s in zip(q.column("key").to_pylist(), seqs.tolist(), strict=True)], dtype=bool)
    none = best_seq < 0
    new = {
        "best_d": pa.array(best_d, pa.float64(), mask=none), "best_seq": pa.array(best_seq, pa.int64(), mask=none), "known": pa.array(known, pa.bool_()), "stored": pa.array(stored, pa.bool_()), "before": pa.array(before, pa.int64()),
    }
    return pa.Table.from_arrays([new[c] if c in new else q.column(c) for c in state], names=state)


def _kept(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _exact(rows: DataFrame, entries: DataFrame, cap: int | None) -> DataFrame:
    """``rows`` with ``exact_seq``: the entry of their key that was in the exact store when they came."""
    e = entries.select(F.col("config").alias("_c"), F.col("key").alias("_k"), F.col("seq").alias("exact_seq"), F.col("rank").alias("_r"))
    same = (F.col("config") == F.col("_c")) & (F.col("key") == F.col("_k")) & (F.col("exact_seq") < F.col("seq"))
    if cap is None:  # a key is stored once
        met = rows.join(e, same, "left")
    else:
        # An entry of rank r answers while r < stored <= r + cap: two spans of cap ranks, each of which a key fills twice at most.
        spans = F.array_distinct(F.array(F.floor(F.col("_r") / cap), F.floor((F.col("_r") + cap) / cap)))
        e = e.withColumn("_span", F.explode(spans))
        met = rows.withColumn("_at", F.floor(F.col("before") / cap)).join(e, same & (F.col("_at") == F.col("_span")) & (F.col("before") > F.col("_r")) & (F.col("before") <= F.col("_r") + cap), "left").drop("_at", "_span")
    return met.drop("_c", "_k", "_r")


def settled(rows: DataFrame, max_size: int | None = None, exact: bool = True, block: int = BLOCK, front: int = FRONT) -> DataFrame:
    """``rows(config, seq, key, vector, threshold, failed, ...)`` with ``source, similarity, matched_seq, stored``.

    Equal, row for row, to a replay in order. ``vector`` is of unit length or
    null; a null one is only stored in the exact store. ``failed`` requests
    store nothing. ``seq`` is unique within a configuration; columns named like
    those made here are not allowed. An empty table gives no rows.
    """
    cap = None if max_size is None else max(1, max_size)
    given = rows.columns
    # Joins on the configuration must keep a null one apart from the others and in the result.
    rows = rows.withColumn("config", F.when(F.col("config").isNotNull(), F.concat(F.lit("c"), "config")).otherwise(""))
    state = [*given, "block", "best_d", "best_seq", "known", "stored", "before"]
    now = numbered(durable(rows), "config", "seq").withColumn("block", F.floor(F.col("pos") / block)).drop("pos")
    now = durable(now.withColumns({"best_d": F.lit(None).cast("double"), "best_seq": F.lit(None).cast("long"), "known": F.lit(False), "stored": F.lit(False), "before": F.lit(0).cast("long")}).select(*state))
    kinds = {f.name: f.dataType for f in now.schema.fields}
    out_schema = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in state)
    open_ = ~F.col("failed") & ~F.col("known") & F.coalesce(similarity(F.col("best_d")) < F.col("threshold"), F.lit(True))
    done: list[DataFrame] = []
    entries: list[DataFrame] = []
    base = None
    while True:
        counts = now.groupBy("config", "block").agg(F.count_if(open_).alias("open"))
        sums = Window.partitionBy("config").orderBy("block")
        ranked = counts.withColumn("upto", F.sum("open").over(sums.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(sums))
        fits = (F.col("upto") <= front) | (F.col("place") == 1)
        cuts = ranked.groupBy("config").agg(F.max(F.when(fits, F.col("block"))).alias("cut"), F.max("block").alias("last"), F.min("block").alias("least"))
        if base is None:
            cuts = cuts.withColumn("base", F.lit(0).cast("long"))
        else:
            cuts = cuts.join(base, "config", "left").withColumn("base", F.coalesce("base", F.lit(0).cast("long")))
        cuts = durable(cuts)
        n = cuts.count()
        if not n:
            break
        known = few(cuts, n)
        first = now.where(open_).join(known.select("config", "cut", "base"), "config").where("block <= cut").select("config", "seq", "key", "vector", "threshold", "base")
        if exact and entries:
            # Of the entries before, those of the front's keys.
            old = _kept(entries).select("config", "key", "rank").join(first.select("config", "key").distinct(), ["config", "key"], "left_semi")
            first = first.join(old.groupBy("config", "key").agg(F.max("rank").alias("held")), ["config", "key"], "left")
        else:
            first = first.withColumn("held", F.lit(None).cast("long"))
        new = durable(first.groupBy("config").applyInArrow(lambda t: _settle(t, cap, exact), f"config string, seq long, key {kinds['key'].simpleString()}, vector array<double>, rank long"))
        entries.append(new)
        base = durable(known.select("config", F.col("base").alias("b")).join(new.groupBy("config").agg(F.count("*").alias("n")), "config", "left").select("config", (F.col("b") + F.coalesce("n", F.lit(0))).alias("base")))
        # Each block that is left meets the new entries.
        spread = new.join(known.select("config", "least", "last"), "config").withColumn("block", F.explode(F.sequence("least", "last")))
        spread = spread.select("config", "block", "seq", "key", "vector", F.lit(0).alias("kind"))
        met = now.withColumn("kind", F.lit(1)).unionByName(spread, allowMissingColumns=True)
        after = met.groupBy("config", "block").applyInArrow(lambda t: _apply(t, exact and cap is None, state), out_schema)
        late = known.select("config", "cut", F.col("base").alias("_base"))
        after = durable(after.join(late, "config").withColumn("before", F.col("before") + F.col("_base")).withColumn("late", F.col("block") > F.col("cut")).drop("cut", "_base"))
        done.append(after.where("not late").drop("late"))
        now = after.where("late").drop("late")
        if len(done) >= _MERGE:
            done, entries = [durable(_kept(done))], [durable(_kept(entries))]
    if not done:
        return now.select(*given, F.lit("").alias("source"), F.col("best_d").alias("similarity"), F.col("best_seq").alias("matched_seq"), "stored")
    named = [F.when(F.col(c) != "", F.substr(F.col(c), F.lit(2))).alias(c) if c == "config" else F.col(c) for c in given]
    every = _kept(done)
    every = _exact(every, _kept(entries), cap) if exact else every.withColumn("exact_seq", F.lit(None).cast("long"))
    by_key, sim = F.col("exact_seq").isNotNull(), similarity(F.col("best_d"))
    by_vector = ~by_key & F.coalesce(~(sim < F.col("threshold")), F.lit(False))
    return every.select(
        *named,
        F.when(by_key, "exact_cache").when(by_vector, "semantic_cache").otherwise("llm").alias("source"),
        F.when(by_key, 1.0).when(by_vector, sim).alias("similarity"),
        F.when(by_key, F.col("exact_seq")).when(by_vector, F.col("best_seq")).alias("matched_seq"),
        "stored",
    )
