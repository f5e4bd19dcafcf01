import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.operators import replay
from quern.operators.replay import Cache


def unit(degrees):
    return np.array([math.cos(math.radians(degrees)), math.sin(math.radians(degrees))])


def run(pairs, threshold=0.7, **options):
    """(outcome, source, similarity) of each (key_1, angle_1, key_2, angle_2, label)."""
    cache, out = Cache(**options), []
    for i, (k1, a1, k2, a2, label) in enumerate(pairs):
        cache.submit(2 * i, k1, unit(a1), threshold, None)
        source, sim, _, _ = cache.submit(2 * i + 1, k2, unit(a2), threshold, None)
        hit = source != "llm"
        out.append(("TP" if hit and label else "FP" if hit else "FN" if label else "TN", source, sim))
    return out


@pytest.mark.parametrize(
    ("pair", "expected"),
    [(("a", 0, "b", 2, 1), ("TP", "semantic_cache")), (("a", 0, "b", 2, 0), ("FP", "semantic_cache")), (("a", 0, "b", 90, 0), ("TN", "llm")), (("a", 0, "b", 90, 1), ("FN", "llm")), (("a", 0, "a", 0, 1), ("TP", "exact_cache"))],
)
def test_single_pairs(pair, expected):
    assert run([pair])[0][:2] == expected


def test_cache_accumulates_over_pairs_but_not_over_runs():
    second = run([("a", 0, "b", 170, 0), ("c", 90, "d", 2, 1)])[1]
    assert second[1] == "semantic_cache" and second[2] > 0.9
    assert run([("c", 90, "d", 4, 1)])[0][:2] == ("FN", "llm")


def test_threshold_is_inclusive_and_zero_vectors_are_at_distance_one():
    cache = Cache()
    cache.submit(0, "a", unit(10), 1.0, None)
    assert cache.submit(1, "b", unit(10), 1.0, None)[:2] == ("semantic_cache", 1.0)
    zero = Cache()
    zero.submit(0, "a", np.zeros(2), 0.5, None)
    assert zero.submit(1, "b", unit(0), 0.5, None)[1] == pytest.approx(0.5)


def test_orthogonal_vectors_miss_at_a_half():
    cache = Cache()
    cache.submit(0, "a", unit(0), 0.5, None)
    assert cache.submit(1, "b", unit(90), 0.5, None)[0] == "llm"


def test_fifo_drops_the_first_in_and_hits_do_not_refresh():
    cache = Cache(max_size=2, semantic=False)
    for seq, key in enumerate("aba"):
        cache.submit(seq, key, None, 1.0, None)
    cache.submit(3, "c", None, 1.0, None)
    assert list(cache.store) == ["b", "c"]


def test_an_evicted_prompt_still_hits_the_unbounded_index():
    cache = Cache(max_size=1)
    cache.submit(0, "a", unit(0), 0.9, None)
    cache.submit(1, "b", unit(90), 0.9, None)
    assert cache.submit(2, "a", unit(0), 0.9, None)[:3] == ("semantic_cache", 1.0, 0)


def test_lifetime_counts_from_the_last_store():
    cache = Cache(ttl=10, semantic=False)
    assert [cache.submit(i, "a", None, 1.0, now)[0] for i, now in enumerate((0, 10, 10.5, 20, 21))] == ["llm", "exact_cache", "llm", "exact_cache", "llm"]


def test_disabled_exact_cache_stores_again():
    cache = Cache(exact=False, semantic=False)
    assert [cache.submit(i, "a", None, 1.0, None)[0] for i in range(2)] == ["llm", "llm"]


def test_plan_matches_the_cache_for_every_configuration(spark):
    rng = np.random.default_rng(5)
    rows = [(c, s, str(int(rng.integers(0, 12))), rng.standard_normal(4).tolist(), t) for c, t in (("x", 0.6), ("y", 0.5), ("z", 0.9)) for s in range(60)]
    df = spark.createDataFrame(rows, "config string, seq long, key string, vector array<double>, threshold double").orderBy(F.rand(1))
    got = {(r.config, r.seq): (r.source, r.matched_seq, r.stored) for r in replay.replay(df, max_size=5).collect()}
    want = {}
    caches = {}
    for c, s, k, v, t in rows:
        cache = caches.setdefault(c, Cache(max_size=5))
        source, _, matched, stored = cache.submit(s, k, np.array(v) / np.linalg.norm(v), t, None)
        want[c, s] = (source, matched, stored)
    assert got == want


def traffic(rng):
    """Configurations of every kind: (config, seq, key, vector, threshold, failed)."""
    rows = []

    def add(config, vectors, threshold, keys=None, failing=0.0):
        for s, v in enumerate(vectors):
            rows.append((config, 3 * s + 1, str(s if keys is None else keys[s]), None if v is None else [float(x) for x in v], threshold, bool(rng.random() < failing)))

    add("random", rng.standard_normal((150, 3)), 0.7)
    add("keys", rng.standard_normal((150, 4)), 0.72, rng.integers(0, 25, 150))
    chain = [unit(3.0 * i) for i in range(110)]
    add("chain", chain, 1 / (1 + 2 * math.sin(math.radians(1.5))))  # the next one is just near enough
    add("shuffled chain", [chain[i] for i in rng.permutation(110)], 0.94)
    few = rng.standard_normal((9, 3))
    add("copies", [few[i] for i in rng.integers(0, 9, 140)], 0.95, rng.integers(0, 6, 140), failing=0.3)
    add("apart", np.eye(90), 0.9)
    add("all alike", np.ones((80, 2)), 1.0)
    add("without", [None if i % 3 else rng.standard_normal(3) for i in range(90)], 0.7, rng.integers(0, 12, 90))
    add(None, [np.zeros(2), np.ones(2), np.zeros(2), np.ones(2)], 0.5)
    add("never", np.ones((30, 2)), 0.0)
    return rows


@pytest.mark.parametrize(("max_size", "exact"), [(None, True), (4, True), (0, True), (None, False)])
def test_rounds_equal_the_cache(spark, max_size, exact):
    rows = traffic(np.random.default_rng(17))
    df = spark.createDataFrame(rows, "config string, seq long, key string, vector array<double>, threshold double, failed boolean").withColumn("tag", F.col("seq") * 2).orderBy(F.rand(2))
    got = {(r.config, r.seq): r for r in replay.replay(df, max_size=max_size, exact=exact, carry=("tag",), hot=0, block=24, front=48).collect()}
    caches = {}
    assert len(got) == len(rows)
    for c, s, k, v, t, failed in rows:
        length = np.linalg.norm(v) if v else 0
        cache = caches.setdefault(c, Cache(max_size=max_size, exact=exact))
        source, sim, matched, stored = cache.submit(s, k, None if v is None else np.array(v) / (length or 1), t, None, failed)
        r = got[c, s]
        assert (r.source, r.matched_seq, r.stored, r.tag) == (source, matched, stored, 2 * s), (c, s, r, source, matched, stored)
        assert r.similarity == (None if sim is None else pytest.approx(sim, abs=1e-12))


def test_rounds_hold_a_front_and_a_block_only(spark, monkeypatch):
    from quern.operators import rounds

    rng = np.random.default_rng(3)
    t = pa.table({"config": ["c"] * 700, "seq": range(700), "key": [str(i) for i in range(700)], "vector": [v.tolist() for v in rng.standard_normal((700, 3))], "threshold": [0.7] * 700, "base": [5] * 700, "held": pa.array([None] * 700, pa.int64())})
    out = rounds._settle(t.take(pa.array(rng.permutation(700))), None, True)
    cache = Cache()
    want = [s for s, v in enumerate(t.column("vector").to_pylist()) if cache.submit(s, str(s), np.array(v), 0.7, None)[3]]
    assert out.column("seq").to_pylist() == want and out.column("rank").to_pylist() == list(range(5, 5 + len(want)))
    sizes = []
    real = rounds.durable

    def noted(df):
        kept = real(df)
        if {"held", "late"} & set(df.columns) or "late" in df.columns:
            sizes.append(kept.groupBy("config", "block").count().agg(F.max("count")).first()[0])
        return kept

    monkeypatch.setattr(rounds, "durable", noted)
    rows = [("c", i, str(i), rng.standard_normal(3).tolist(), 0.8, False) for i in range(300)]
    df = spark.createDataFrame(rows, "config string, seq long, key string, vector array<double>, threshold double, failed boolean")
    assert rounds.settled(df, block=32, front=64).count() == 300
    assert sizes and max(s for s in sizes if s) <= 32


def test_only_large_configurations_go_in_rounds(spark):
    rows = [(c, s, str(s % 7), [float(s % 5), 1.0], 0.8) for c, n in (("a", 40), ("b", 12)) for s in range(n)]
    df = spark.createDataFrame(rows, "config string, seq long, key string, vector array<double>, threshold double")
    want = sorted(map(str, replay.replay(df).collect()))
    for hot in (0, 20, 100):
        assert sorted(map(str, replay.replay(df, hot=hot, block=8, front=16).collect())) == want
    assert replay.replay(df.limit(0), hot=0).count() == 0


def test_empty_requests(spark):
    df = spark.createDataFrame([], "config string, seq long, prompt string")
    assert replay.replay(df).count() == 0
