"""Expiry by doubled pointers against the cache in order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import expiry, replay
from quern.operators.shared import filled, numbered


def key(r):
    return tuple((x is None, str(x)) for x in r)


def both(spark, rows, ttl):
    df = spark.createDataFrame(rows, "config string, seq long, key string, now double").withColumns({c: F.lit(c) for c in ("k", "pos", "at", "store", "held", "own")}).orderBy(F.rand(4))
    columns = ["config", "seq", "source", "similarity", "matched_seq", "stored"]
    got = sorted((tuple(r) for r in expiry.replayed(df, ttl).select(*columns).collect()), key=key)
    want = sorted((tuple(r) for r in replay.replay(df, ttl=ttl, semantic=False).select(*columns).collect()), key=key)
    assert len(want) == len(rows)
    return got, want


@pytest.mark.parametrize("ttl", [0.0, 3.0, 1000.0])
def test_equals_the_cache(spark, ttl):
    rng = np.random.default_rng(6)
    times = np.cumsum(rng.integers(0, 3, 600)).astype(float).tolist()  # many at the same time, many at the very end of a lifetime
    rows = [("hot", i, "one", t) for i, t in enumerate(times)]
    rows += [("mixed", i, str(int(rng.integers(0, 9))), t) for i, t in enumerate(times[:200])]
    rows += [(None, i, None if i % 2 else "x", t) for i, t in enumerate(times[:20])]
    rows += [("single", 5, "a", 7.0)]
    got, want = both(spark, rows, ttl)
    assert got == want


def test_times_that_run_backwards_or_are_missing(spark):
    rng = np.random.default_rng(7)
    rows = [("c", i, "back", float(rng.integers(0, 40))) for i in range(60)]
    rows += [("c", 100 + i, "gaps", None if i % 4 == 1 else float(i)) for i in range(40)]
    rows += [("c", 200 + i, "usual", float(i)) for i in range(40)]
    got, want = both(spark, rows, 5.0)
    assert got == want


def test_empty_and_refused(spark):
    none = spark.createDataFrame([], "config string, seq long, prompt string, now double")
    assert expiry.replayed(none, 5.0).count() == 0
    with pytest.raises(ValueError, match="negative"):
        expiry.replayed(none, -1.0)


def test_no_python_and_no_window_over_a_whole_key(spark):
    df = spark.range(3000).select(F.lit("c").alias("config"), F.col("id").alias("seq"), F.lit("hot").alias("key"), F.col("id").cast("double").alias("now"))
    got = expiry.replayed(df, 6.0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert got.agg(F.count_if("stored")).first()[0] == -(-3000 // 7)


def test_places_and_fills_along_a_hot_key(spark):
    rows = [("a", i, i * 10 if i % 17 == 3 else None) for i in range(500)] + [("b", i, None) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, o long, x long").repartition(5)
    assert all(r.pos == r.o for r in numbered(df, "g", "o").collect())
    last = {(r.g, r.o): r.y for r in filled(df, "g", "o", value="x", name="y").collect()}
    following = {(r.g, r.o): r.y for r in filled(df, "g", "o", value="x", name="y", ahead=True).collect()}
    for g, o, _ in rows:
        known = [x for h, i, x in rows if h == g and x is not None]
        assert last[g, o] == max((x for x in known if x <= 10 * o), default=None)
        assert following[g, o] == min((x for x in known if x >= 10 * o), default=None)
