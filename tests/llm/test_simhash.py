import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from quern.llm import common, simhash


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) > 3 else [" ".join(w)] if w else []
    h = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))


def components(values):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    v = np.array(values, np.uint64)
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= 4):
            root[find(int(j))] = find(i)
    return [find(i) for i in range(len(v))]


def test_every_four_positions_hold_a_triple():
    assert len(simhash.TRIPLES) == 20 and len(simhash.FOURS) == 70
    assert all(any(set(t) <= set(four) for t in sets) for sets in (simhash.TRIPLES, simhash.FOURS) for four in combinations(range(8), 4))


def test_result_is_that_of_plain_code(spark, docs, dirty):
    rows = docs.select("doc_id", "text").unionByName(dirty.select("doc_id", "text").where("doc_id is null or doc_id <> 1"))
    given = [(r.doc_id, r.text) for r in rows.collect()]
    roots = components([fingerprint(t) for _, t in given])
    least = {}
    for (d, _), r in zip(given, roots, strict=True):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    want = sorted(str((d, f"{fingerprint(t):016x}", least.get(r))) for (d, t), r in zip(given, roots, strict=True))
    got = simhash.near_duplicates(rows).select("doc_id", simhash.hex_digits(common.F.col("fp")).alias("f"), "component_id").collect()
    assert sorted(str((r.doc_id, r.f, r.component_id)) for r in got) == want


@pytest.mark.parametrize("sets", [simhash.TRIPLES, simhash.FOURS])
def test_links_in_small_blocks_join_all_within_reach(spark, sets):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    values = set()
    for b in base:
        for _ in range(150):
            x = int(b)
            for bit in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(bit)
            values.add(x)
    values = sorted(values)
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    got = {r.node: r.root for r in common.components(simhash.links(df, sets, block=16)).collect()}
    want = components(values)
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    groups = lambda key: sorted(sorted(s for s, k in zip(signed, key, strict=True) if k == g) for g in set(key))
    assert groups([got.get(s, s) for s in signed]) == groups(want)


def five_words(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} - {""}


def test_stage_keeps_one_of_each(spark, docs, dirty, nothing, sf001):
    kept = simhash.keep_one(spark, docs, sf001)
    sets = {r.doc_id: five_words(r.text) for r in docs.collect()}
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                first, second = sorted((top(a), top(b)))
                root[second] = first
    assert sorted(r.doc_id for r in kept.collect()) == sorted({top(d) for d in ids}) and kept.columns == docs.columns
    assert simhash.keep_one(spark, nothing, sf001).count() == 0
    left = simhash.keep_one(spark, dirty, sf001)
    assert left.columns == dirty.columns
    # Of the empty texts (ids 2, 3, 4 and none) one stays, of the equal rows one.
    assert sorted(str(r.doc_id) for r in left.select("doc_id").collect()) == ["1", "1", "2", "5", "6", "7", "8", "None"]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in common.components(edges).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}


def plain_kept(given):
    """The ids that stay by plain code: components of pairs whose sets of five words have a Jaccard similarity of 0.8 or more."""
    sets = []
    for _, text in given:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(sets)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(given):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


def test_stage_finds_near_copies_at_eight_tenths(spark, docs, sf001):
    rng = np.random.default_rng(6)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for i in range(60):
        w, n = words(200), len(rows)
        rows.append((10_000 + n, " ".join(w)))
        # Each word replaced apart from others takes five shingles: 196 shared at first, 4 words leave 176 of 216, 5 words 171 of 221.
        for at in range(20, 20 + 30 * (2 + i % 4), 30):
            w[at] = f"other{i}"
        rows.append((10_001 + n, " ".join(w)))
    kept = simhash.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf001)
    assert sorted(r.doc_id for r in kept.collect()) == plain_kept(rows)


@pytest.mark.parametrize("block", [simhash.BLOCK_SHINGLES, 4000])
def test_a_chain_of_near_copies_is_one_in_small_blocks(spark, block):
    w = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(40):
        texts.append(" ".join(w))
        w[7 * i + 3] = f"new{i}"
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len({r.root for r in simhash.alike(df, block=block).collect()}) == 1


def test_bands_find_pairs_at_eight_tenths():
    rng = np.random.default_rng(7)
    sets = []
    for _ in range(2000):
        x = rng.integers(0, 2**63, 200, dtype=np.uint64)
        sets += [np.unique(x[:180]), np.unique(x[20:])]  # 160 of 200
    keys = simhash._bands(sets)
    assert (keys[::2] == keys[1::2]).any(axis=1).mean() > 0.998
    assert not (keys[:-1:2] == np.roll(keys[1::2], 1, axis=0)).any()


def test_stage_on_trouble_keeps_one_of_each(spark, dirty, nothing, sf001):
    assert simhash.keep_one(spark, nothing, sf001).count() == 0
    left = simhash.keep_one(spark, dirty, sf001)
    assert left.columns == dirty.columns
    assert sorted(str(r.doc_id) for r in left.select("doc_id").collect()) == ["1", "1", "2", "5", "6", "7", "8", "None"]


def test_stage_keeps_columns_named_as_internal_ones(spark, dirty):
    from pyspark.sql import functions as F

    names = ("__row", "__key", "__id", "row", "row_key", "own", "id", "root", "first", "cls", "bands", "hashes")
    extra = dirty.withColumns({c: F.lit(f"given {c}") for c in names})
    got = simhash.keep_one(spark, extra, "")
    assert got.columns == extra.columns and all(r[c] == f"given {c}" for r in got.collect() for c in names)
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r.doc_id) for r in simhash.keep_one(spark, dirty, "").collect())


def test_stage_gathers_candidates_by_its_fingerprints(spark):
    rng = np.random.default_rng(9)
    fps = [int(x) for x in rng.integers(0, 2**62, 40)]
    near = [(i, f ^ sum(1 << int(b) for b in rng.choice(62, 5 + i % 3, replace=False))) for i, f in enumerate(fps)]  # 5, 6 or 7 bits away
    none = iter(range(10**6))  # no band is shared
    bands = lambda: [next(none) for _ in range(simhash.BANDS)]
    rows = [(i, f, bands()) for i, f in enumerate(fps)] + [(100 + i, f, bands()) for i, f in near] + [(500, fps[0], bands()), (600, 0, None), (601, 0, None)]
    got = {r.node: r.root for r in common.components(simhash.candidates(spark.createDataFrame(rows, "cls long, fp long, bands array<long>"))).collect()}
    want = {100 + i: i for i in range(40) if 5 + i % 3 <= simhash.STAGE_BITS}
    assert got == want | {i: i for i in want.values()} | {500: 0}
    # Within a group too: sets alike by nine tenths whose bands all differ are linked if their fingerprints are near.
    sets = [np.arange(100, dtype=np.uint64), np.arange(5, 100, dtype=np.uint64), np.arange(6, 106, dtype=np.uint64)]
    apart = np.arange(3 * simhash.BANDS).reshape(3, -1)
    assert list(simhash._group(sets, np.array([7, 6, 2**64 - 1], np.uint64), apart)) == [(1, 0)]


@pytest.mark.parametrize("least", [2, 3, 4])
def test_every_positions_hold_a_listed_set(least):
    sets = {2: simhash.TWOS, 4: simhash.TRIPLES}.get(least, simhash.TWOS)
    assert all(any(set(t) <= set(p) for t in sets) for p in combinations(range(8), least))
