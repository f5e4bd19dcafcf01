import pytest
from pyspark.sql import functions as F

from quern.llm import mixing


def test_targets_share_the_excess_again():
    got = mixing.targets({"b": 100, "a": 10, None: 1000})
    assert got["a"] == 20.0 and sum(got.values()) == pytest.approx(1.5 * 1110)
    assert got["b"] == 200.0 and got[None] == pytest.approx(1445.0)
    assert mixing.targets({}) == {} and mixing.targets({"x": 0}) == {"x": 0.0}


def test_sources_take_weights_by_code_point_with_null_last():
    got = mixing.targets({"é": 10**6, "z": 10**6, "Z": 10**6, None: 10**6}, share=0.01)
    assert [round(got[s] / got[None]) for s in ("Z", "z", "é", None)] == [1, 0, 0, 1]
    assert got["Z"] / got["z"] == pytest.approx(2.5) and got["z"] / got["é"] == pytest.approx(2.0)


def cost_of(supply, flow):
    total = 0
    for (tokens, _), f in zip(supply, flow, strict=True):
        total += max(0, sum(f.values()) - tokens)
    return total


def test_flow_fills_quotas_and_repeats_only_where_it_must():
    supply, quota = [(100, [0]), (50, [0, 1]), (30, [1])], [120, 60]
    flow = mixing.min_cost_flow(supply, quota)
    assert [sum(f.get(s, 0) for f in flow) for s in (0, 1)] == quota and cost_of(supply, flow) == 0
    flow = mixing.min_cost_flow(supply, [220, 80])
    assert [sum(f.get(s, 0) for f in flow) for s in (0, 1)] == [220, 80] and cost_of(supply, flow) == 120
    assert all(sum(f.values()) <= 2 * t for (t, _), f in zip(supply, flow, strict=True))


def test_taken_words_come_near_their_targets(spark, sf001):
    got = mixing.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "text"), "doc_id")
    rows = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most"), F.sum("size").alias("size"), F.first("source_size").alias("source_size")).collect()
    want = mixing.targets({r.source: r["size"] for r in rows})
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == r["size"]
        assert abs(r.taken - r.target) <= r.most
    assert got.where("taken not in (0, size, 2 * size)").count() == 0


def test_reruns_agree(spark, sf001):
    a, b = (sorted((r.doc_id, r.taken) for r in mixing.query(spark, sf001).collect()) for _ in range(2))
    assert a == b


def test_overlapping_sources(spark):
    rows = [(i, " ".join(["w"] * 10), ["a"] if i % 3 == 0 else ["b", "a", "a"] if i % 3 == 1 else ["b", None]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, of array<string>")
    got = mixing.mix(df, F.col("of")).collect()
    assert len(got) == 300 and {tuple(r.members) for r in got if r.members} >= {("a",), ("a", "b")}
    assert max(r.copies for r in got) <= 2
    total = {"a": 2000, "b": 2000, None: 1000}
    assert sum(r.taken for r in got) == pytest.approx(min(6000, sum(mixing.targets(total).values())), abs=30)


def test_trouble(spark, dirty, nothing, sf001):
    assert mixing.mix(nothing).count() == 0 and mixing.mix_stage(spark, nothing, sf001).count() == 0
    got = mixing.mix(dirty).collect()
    assert len(got) == dirty.count()
    assert all(r.size == 0 and r.taken == 0 for r in got if r.doc_id in (2, 3, 4))
    stage = mixing.mix_stage(spark, dirty, sf001)
    assert stage.columns == dirty.columns
    assert sorted(str(r.doc_id) for r in stage.collect()) == sorted(str(r.doc_id) for r in got for _ in range(r.copies))


def _repeated(n, source="a", text="w " * 10, first=None):
    return [(first, text, source)] * n


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_equal_rows_end_within_half_a_document_of_the_target(spark, parts):
    rows = _repeated(100)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
    got = mixing.mix(df).collect()
    assert len(got) == 100
    assert sum(r.taken for r in got) == 1500 == round(got[0].target)
    assert {r.copies for r in got} == {1, 2}


def test_equal_rows_among_others(spark):
    rows = _repeated(60) + [(i, f"x{i} " + "w " * 9, "a") for i in range(40)] + [(100 + i, f"y{i} " + "w " * 9, "b") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    for got in (mixing.mix(df).collect(), mixing.mix(df.repartition(3)).collect()):
        by = {}
        for r in got:
            t = by.setdefault(r.members[0], [0, r.target])
            t[0] += r.taken
        assert all(abs(taken - target) <= 10 for taken, target in by.values()), by
        assert all(r.taken <= 2 * r["size"] for r in got)


def test_stage_repeats_equal_rows_as_planned(spark):
    df = spark.createDataFrame(_repeated(100), "doc_id long, text string, source string").repartition(5)
    assert mixing.mix_stage(spark, df, "").count() == 150


def _cheapest(supply, quota, copies):
    """(most tokens, least cost) by trying every flow."""
    import itertools

    arcs = [(p, s) for p, (_, members) in enumerate(supply) for s in members]
    best = (0, 0)
    for flow in itertools.product(*[range(copies * supply[p][0] + 1) for p, _ in arcs]):
        out, into = [0] * len(supply), [0] * len(quota)
        for (p, s), f in zip(arcs, flow, strict=True):
            out[p] += f
            into[s] += f
        if any(o > copies * t for o, (t, _) in zip(out, supply, strict=True)) or any(i > q for i, q in zip(into, quota, strict=True)):
            continue
        cost = sum(k * min(t, max(0, o - k * t)) for o, (t, _) in zip(out, supply, strict=True) for k in range(copies))
        best = max(best, (sum(out), -cost))
    return best[0], -best[1]


def test_flow_is_a_cheapest_one():
    import random

    rng = random.Random(5)
    for _ in range(25):
        supply = [(rng.randint(0, 2), sorted(rng.sample(range(3), rng.randint(1, 2)))) for _ in range(3)]
        quota = [rng.randint(0, 4) for _ in range(3)]
        given = [sum(f.values()) for f in mixing.min_cost_flow(supply, quota)]
        cost = sum(k * min(t, max(0, g - k * t)) for g, (t, _) in zip(given, supply, strict=True) for k in range(2))
        assert (sum(given), cost) == _cheapest(supply, quota, 2)
