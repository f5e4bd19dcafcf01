"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation is learned so that the signs of the rotated vectors make balanced
codes (fitted on ``SAMPLE`` vectors at most, chosen by hash); more bits than
dimensions come from more rotations, each learned from a start of its own. The
code is cut into parts, a table each: vectors that agree in some part meet in
that part's table, and those whose whole codes differ in few bits become
candidates. Only codes travel to the tables.

How many tables, and how many bits may differ, is measured and not assumed,
because bits agree less often where vectors share a direction: pairs at exactly
the threshold are made from the sample (a vector moved along the difference of
two others, so they lie as the data do), and the tables and the distance are the
least that keep ``RECALL`` of them.

No candidate is joined with another one before their cosine has been taken:
with many vectors, chance candidates alone would join most of them into one
group. A pair is looked at once, in the first table in which it meets. Where a
bucket holds few candidates for its size they leave it as pairs, and the two
vectors are fetched; where it holds many, as copies with small differences do,
the vectors travel to the bucket, which is worked through in blocks of bounded
size as matrix products, and only sums and a star of links leave it. Cosines are of
the original vectors in double precision, so no link below the threshold is ever
reported. Equal vectors are one entry with a count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common as C

THRESHOLD = 0.9
RECALL = 0.96
SAMPLE = 8192
ITERATIONS = 40
BLOCK = 2048
#: Tables at most; parts get shorter, and buckets longer, before there are more.
MAX_TABLES = 96
#: Words of code that are compared.
CHECK_WORDS = 4
#: Candidates an entry, in the mean of a block, beyond which the block's vectors travel to it instead of pairs.
MANY = 4
_PROBES = 2048
_PAIRS = 1 << 18
_WORD = 64


@dataclass(frozen=True)
class Model:
    """``mean`` and ``projection`` make the code; ``count`` tables of ``bits``; candidates differ in ``reach`` bits at most."""

    mean: np.ndarray
    projection: np.ndarray
    count: int
    bits: int
    reach: int

    def ones(self, unit: np.ndarray) -> np.ndarray:
        return (unit - self.mean) @ self.projection >= 0


def part_bits(n: int) -> int:
    """The bits of a table's part for n distinct vectors: what a bucket holds by chance stays bounded."""
    return min(24, max(8, round(math.log2(max(n, 2))) - 8))


def probes(unit: np.ndarray, threshold: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors with a cosine of exactly ``threshold``, spread as the sample is."""
    rng = np.random.default_rng(seed)
    n, d = unit.shape
    x = unit[rng.integers(0, n, _PROBES)] if n else _unit(rng.standard_normal((_PROBES, d)))
    away = unit[rng.integers(0, n, _PROBES)] - unit[rng.integers(0, n, _PROBES)] if n > 2 else np.zeros_like(x)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    size = np.linalg.norm(away, axis=1, keepdims=True)
    if (size < 1e-9).any():  # nothing to go by: any direction
        other = rng.standard_normal(x.shape)
        other -= (other * x).sum(axis=1, keepdims=True) * x
        away = np.where(size < 1e-9, other, away)
        size = np.linalg.norm(away, axis=1, keepdims=True)
    return x, threshold * x + math.sqrt(1 - threshold**2) * away / np.maximum(size, 1e-300)


def learn(sample: np.ndarray, n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> Model:
    """The code, and the fewest tables that keep ``recall`` of pairs at the threshold."""
    # Vectors that the rotation was fitted to lie off its planes more than others: pairs are made from a quarter left out.
    fitted, held = (np.delete(sample, np.s_[::4], axis=0), sample[::4]) if len(sample) >= 16 else (sample, sample)
    x, y = probes(_unit(held) if len(held) else held, threshold)
    most = part_bits(n)
    mean, projection = fit(fitted, MAX_TABLES * most)
    differ = ((x - mean) @ projection >= 0) != ((y - mean) @ projection >= 0)
    by_tables = (1 + recall) / 2  # of what may be lost, half by tables, and less by distance
    for bits in range(most, 3, -1):
        met = np.logical_or.accumulate(~differ[:, : MAX_TABLES * bits].reshape(len(x), MAX_TABLES, bits).any(axis=2), axis=1).mean(axis=0)
        if met[-1] >= by_tables:
            break
    count = int(np.argmax(met >= by_tables)) + 1 if met[-1] >= by_tables else MAX_TABLES
    width = max(count * bits, _WORD)
    far = np.count_nonzero(differ[:, : min(width, CHECK_WORDS * _WORD)], axis=1)
    return Model(mean, projection[:, :width], count, bits, int(np.quantile(far, (3 + recall) / 4)))


def fit(sample: np.ndarray, bits: int = 64, iterations: int = ITERATIONS, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection d x bits) whose signs are the code.

    The leading principal directions are rotated so that the quantisation
    error is least, again from other random starts until there are bits
    enough. A sample too small to learn from gives seeded random rotations.
    """
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    unit = _unit(sample) if len(sample) else sample
    k = min(bits, d)
    learned = len(unit) >= 2 * k
    mean = unit.mean(axis=0) if learned else np.zeros(d)
    if learned:
        centred = unit - mean
        _, vectors = np.linalg.eigh(centred.T @ centred)
        lead = vectors[:, ::-1][:, :k]
        v = centred @ lead
    parts: list[np.ndarray] = []
    while len(parts) * k < bits:
        r = np.linalg.qr(rng.standard_normal((k, k)))[0]
        if not learned:
            parts.append(np.linalg.qr(rng.standard_normal((d, k)))[0])
            continue
        for _ in range(iterations):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        parts.append(lead @ r)
    return mean, np.hstack(parts)[:, :bits]


def codes(unit: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's part of every table as whole numbers, and its code (``CHECK_WORDS`` at most) as 64-bit words."""
    part, code = whole_codes(unit, model)
    return part, np.ascontiguousarray(code[:, :CHECK_WORDS])


def whole_codes(unit: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Parts, and all words of the code, from which ``parts_of`` gets them again."""
    ones = model.ones(unit)
    packed = np.packbits(np.pad(ones, ((0, 0), (0, -ones.shape[1] % _WORD))), axis=1)
    return _parts(ones, model), packed.view(np.int64).reshape(len(unit), -1)


def _parts(ones: np.ndarray, model: Model) -> np.ndarray:
    return ones[:, : model.count * model.bits].reshape(len(ones), model.count, model.bits) @ (1 << np.arange(model.bits, dtype=np.int64))


def parts_of(code: np.ndarray, model: Model) -> np.ndarray:
    """The parts that a code was packed of."""
    return _parts(np.unpackbits(np.ascontiguousarray(code).view(np.uint8), axis=1), model)


def _first_here(part: np.ndarray, i: np.ndarray, j: np.ndarray, table: int) -> np.ndarray:
    """Whether rows i and j meet in no table before this one."""
    met = np.zeros(len(i), bool)
    for t in range(table):
        met |= part[i, t] == part[j, t]
    return ~met


def _matrix(lists: pa.Array, d: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array((np.arange(len(values) + 1) * values.shape[1]).astype(np.int32)), pa.array(values.ravel()))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64, copy=False)
    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # else squares may overflow or vanish
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _postings(batches: Iterator[pa.RecordBatch], models: dict[int, Model]) -> Iterator[pa.RecordBatch]:
    """``(k, cid, code)``, a row for each table; k: length, table and part."""
    for b in batches:
        sizes = np.asarray(b.column("v").value_lengths())
        for d in map(int, np.unique(sizes)):
            every = b.filter(pa.array(sizes == d)) if (sizes != d).any() else b
            model = models[d]
            for at in range(0, every.num_rows, 1024):
                some = every.slice(at, 1024)
                part, code = whole_codes(_unit(_matrix(some.column("v"), d)), model)
                key = (d << 40) | (np.arange(model.count) << 32) | part
                flat = np.repeat(np.arange(len(part)), model.count)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), some.column("cid").take(pa.array(flat)), _lists(code[flat])], names=["k", "cid", "code"])


def _spread(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least label reached over the links (i, j)."""
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


_FOUND = "dense boolean, a long, b long, k long, lo int, hi int, part int"


def _table_of(key: int) -> tuple[int, int]:
    """(length of the vectors, table) of a bucket's key."""
    return key >> 40, key >> 32 & 0xFF


def _own(p: np.ndarray, i: np.ndarray, j: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Whether a pair of a block's rows is this block's to look at."""
    return i < j if lo == hi else (p[i] == lo) & (p[j] == hi)


def _candidates(batches: Iterator[pa.RecordBatch], models: dict[int, Model]) -> Iterator[pa.RecordBatch]:
    """Pairs ``(a, b)`` whose codes are within reach, or, of a block that has many, its entries ``a`` alone."""
    for t, starts in C.whole_groups(batches, ["k", "lo", "hi"]):
        key, lo, hi, place, cid = (t.column(c).to_numpy() for c in ("k", "lo", "hi", "part", "cid"))
        code = t.column("code").combine_chunks()
        out: list[tuple] = []
        for s, e in zip(starts, [*starts[1:], t.num_rows], strict=True):
            if e - s < 2:
                continue
            d, table = _table_of(int(key[s]))
            model = models[d]
            own = _matrix(code.slice(s, e - s), len(code[int(s)]))
            words = np.ascontiguousarray(own[:, :CHECK_WORDS].T).view(np.uint64)  # of signed ones the absolute value's bits would count
            p, part, m = place[s:e], parts_of(own, model), int(e - s)
            step = max(1, _PAIRS // m)
            pairs: list[tuple[np.ndarray, np.ndarray]] = []
            busy, found = np.zeros(m, bool), 0
            for at in range(0, m, step):
                far = np.zeros((min(step, m - at), m), np.uint16)
                for w in words:
                    far += np.bitwise_count(w[at : at + step, None] ^ w[None, :])
                i, j = np.nonzero(far <= model.reach)
                i += at
                mine = _own(p, i, j, lo[s], hi[s])
                i, j = i[mine], j[mine]
                new = _first_here(part, i, j, table)
                i, j = i[new], j[new]
                busy[i] = busy[j] = True
                found += len(i)
                if found <= MANY * m:
                    pairs.append((i, j))
                else:
                    pairs.clear()
            own_cid = cid[s:e]
            if found > MANY * m:
                some = np.flatnonzero(busy)
                same = [np.full(len(some), x[s]) for x in (key, lo, hi)]
                out.append((np.ones(len(some), bool), own_cid[some], np.zeros(len(some), np.int64), *same, p[some]))
            elif found:
                i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
                none = np.zeros(len(i), np.int64)
                out.append((np.zeros(len(i), bool), own_cid[i], own_cid[j], none, none, none, none))
        if out:
            kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["dense", "a", "b", "k", "lo", "hi", "part"])


def _check(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """``(cid, links, root)`` of the pairs that are links, a row for either side; root is the pair's first."""
    for batch in batches:
        for b in (batch.slice(at, 4096) for at in range(0, batch.num_rows, 4096)):
            size = np.asarray(b.column("va").value_lengths())
            for d in map(int, np.unique(size)):
                one = b.filter(pa.array(size == d)) if (size != d).any() else b
                x, y = (_unit(_matrix(one.column(c), d)) for c in ("va", "vb"))
                hit = np.einsum("ij,ij->i", x, y) >= threshold
                p, q, np_, nq = (one.column(c).to_numpy()[hit] for c in ("a", "b", "na", "nb"))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in ((p, q), (nq, np_), (p, p))], names=["cid", "links", "root"])


def _rank(batches: Iterator[pa.RecordBatch], models: dict[int, Model], threshold: float) -> Iterator[pa.RecordBatch]:
    """``(cid, links, root)`` of each block of a dense bucket: exact links, counted with copies, and a star of them."""
    for t, starts in C.whole_groups(batches, ["k", "lo", "hi"]):
        key, lo, hi, place, cid, copies = (t.column(c).to_numpy() for c in ("k", "lo", "hi", "part", "cid", "copies"))
        vectors = t.column("v").combine_chunks()
        sizes = np.asarray(vectors.value_lengths())
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for s, e in zip(starts, [*starts[1:], t.num_rows], strict=True):
            if e - s < 2:
                continue
            d, table = _table_of(int(key[s]))
            x = _unit(_matrix(vectors.slice(s, e - s), int(sizes[s])))
            part = codes(x, models[d])[0]
            p, n, m = place[s:e], copies[s:e], int(e - s)
            links, label = np.zeros(m, np.int64), np.arange(m)
            step = max(1, _PAIRS // m)
            for at in range(0, m, step):
                i, j = np.nonzero(x[at : at + step] @ x.T >= threshold)
                i += at
                mine = _own(p, i, j, lo[s], hi[s])
                i, j = i[mine], j[mine]
                new = _first_here(part, i, j, table)
                i, j = i[new], j[new]
                label = _spread(label, i, j)
                np.add.at(links, i, n[j])
                np.add.at(links, j, n[i])
            hit = links > 0
            if hit.any():
                own = cid[s:e]
                out.append((own[hit], links[hit], own[label[hit]]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["cid", "links", "root"])


def usable(v: Column) -> Column:
    """Whether a vector has a direction: some component, none null or non-finite, not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of vectors.

    Vectors of different lengths do not link. Equal rows link with each other.
    Rows with a null id link like others; a component of such rows alone has a
    null id, and its rows are kept. Unusable vectors (null, empty, zero, null or
    non-finite components) have no links. A cosine of exactly the threshold
    links; of ties in a component the least id names it. An empty table gives
    no rows, and columns other than the two named are not read. A vector's
    length is not bounded; what tasks hold grows with it.
    """
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    ok = usable(F.col("v"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v")).withColumn("v", F.when(ok, F.col("v")))
    rows = rows.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    # Equal vectors are known by 128 bits of hash, so that only classes carry theirs.
    classes = C.durable(
        rows.where("v is not null").groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id"), F.first("v").alias("v")).withColumn("cid", F.monotonically_increasing_id())
    )
    by_size = {r.d: r.n for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    chosen: dict[int, list] = {d: [] for d in by_size}
    for r in classes.select("h1", "h2", "v").orderBy("h1", "h2").limit(sample).collect():
        chosen[len(r.v)].append(r.v)
    models = {d: learn(np.array(x, np.float64).reshape(-1, d), by_size[d], threshold) for d, x in chosen.items()}
    posted = classes.select("cid", "v").mapInArrow(lambda it: C.lean(_postings(it, models)), "k long, cid long, code array<long>")
    dealt = C.blocked(posted, F.col("cid"), BLOCK).select("k", "lo", "hi", "part", "cid", "code")
    found = C.durable(dealt.mapInArrow(lambda it: C.lean(_candidates(it, models)), _FOUND))
    # A pair's vectors are fetched by its two ids, those of a dense bucket once a block.
    a = classes.select(F.col("cid").alias("a"), F.col("copies").alias("na"), F.col("v").alias("va"))
    b = classes.select(F.col("cid").alias("b"), F.col("copies").alias("nb"), F.col("v").alias("vb"))
    links = "cid long, links long, root long"
    pairs = found.where("not dense").select("a", "b").join(a, "a").join(b, "b").mapInArrow(lambda it: C.lean(_check(it, threshold)), links)
    members = found.where("dense").select("k", "lo", "hi", "part", F.col("a").alias("cid")).join(classes.select("cid", "copies", "v"), "cid")
    met = members.repartition("k", "lo", "hi").sortWithinPartitions("k", "lo", "hi").select("k", "lo", "hi", "part", "cid", "copies", "v")
    ranked = C.durable(pairs.unionByName(met.mapInArrow(lambda it: C.lean(_rank(it, models, threshold)), links)))
    counted = ranked.groupBy("cid").agg(F.sum("links").alias("links"))
    rooted = C.components(ranked.select(F.col("cid").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("cid"), "root")
    full = classes.drop("v").join(counted, "cid", "left").join(rooted, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = full.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = named.select(C.apart(F.col("root")).alias("k"), "component_id")
    done = full.withColumn("k", C.apart(F.col("root"))).join(named, "k").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    own = rows.where("v is not null").select("vec_id", "h1", "h2")
    joined = own.join(done, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: links and component of every vector."""
    return near_duplicates(C.table(spark, sf_dir, "embeddings"))
