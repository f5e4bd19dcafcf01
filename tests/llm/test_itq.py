import numpy as np
import pytest

from quern.llm import itq

DIM = 64


@pytest.fixture(scope="module")
def planted():
    """Random vectors with near copies at several cosines, exact copies and a large group."""
    rng = np.random.default_rng(9)
    v = rng.standard_normal((900, DIM))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = list(v)
    for i in range(300):
        z = rng.standard_normal(DIM)
        z -= (z @ v[i]) * v[i]
        c = (0.91, 0.94, 0.97, 0.99)[i % 4]
        rows.append(c * v[i] + np.sqrt(1 - c * c) * z / np.linalg.norm(z))
    rows += [v[5]] * 40
    rows += [v[6] + 0.01 * rng.standard_normal(DIM) for _ in range(60)]
    return np.array(rows)


def exact(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= itq.THRESHOLD
    np.fill_diagonal(linked, False)
    return linked


def test_recall_against_all_pairs_and_no_false_link(spark, planted):
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(planted)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in itq.near_duplicates(df).collect()}
    linked = exact(planted)
    n = np.array([got[i].n_links for i in range(len(planted))])
    assert (n <= linked.sum(1)).all() and n.sum() >= 0.97 * linked.sum()
    label = np.arange(len(planted))
    while True:
        new = np.array([min(label[i], label[linked[i]].min()) if linked[i].any() else label[i] for i in range(len(label))])
        if (new == label).all():
            break
        label = new
    same = np.mean([got[i].component_id == label[i] for i in range(len(label))])
    assert same >= 0.97
    assert all(got[i].kept == (got[i].component_id == i) for i in got)


def test_parts_grow_with_the_vectors():
    assert itq.part_bits(0) == itq.part_bits(48_000) == 8
    assert itq.part_bits(10**8) == 19 and itq.part_bits(10**12) == 24


def leaning(n, d, average, seed=11):
    """Unit vectors whose cosines with each other average ``average``."""
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, d))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    common = np.zeros(d)
    common[0] = 1
    v = np.sqrt(1 - average) * v + np.sqrt(average) * common
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def partners(v, cosine, common, seed=12):
    """For each vector another at the cosine that leans as all do."""
    rng = np.random.default_rng(seed)
    z = rng.standard_normal(v.shape)
    z[:, 0] = 0 if common else z[:, 0]
    z -= (z * v).sum(1, keepdims=True) * v
    return cosine * v + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1, keepdims=True)


@pytest.mark.parametrize("average", [0.0, 0.4, 0.7])
@pytest.mark.parametrize("d", [64, 384])
def test_recall_where_vectors_share_a_direction(spark, average, d):
    v = leaning(1500 if d == 64 else 900, d, average)
    near = np.vstack([partners(v[:400], c, average > 0, seed=s) for s, c in enumerate((0.9005, 0.92, 0.95))])
    every = np.vstack([v, near])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(every)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in itq.near_duplicates(df).collect()}
    linked = exact(every)
    n = np.array([got[i] for i in range(len(every))])
    assert (n <= linked.sum(1)).all() and n.sum() >= 0.93 * linked.sum()


@pytest.mark.parametrize("n", [48_000, 10**6, 10**8])
@pytest.mark.parametrize("average", [0.0, 0.4])
def test_tables_and_distance_keep_pairs_at_the_threshold(n, average):
    v = leaning(4000, DIM, average)
    model = itq.learn(v[:2000], n)
    y = partners(v[2000:], 0.9, average > 0)
    (part, code), (other, far) = itq.codes(v[2000:], model), itq.codes(y, model)
    close = np.bitwise_count((code ^ far).view(np.uint64)).sum(axis=1) <= model.reach
    assert ((part == other).any(axis=1) & close).mean() >= 0.9


def test_codes_are_balanced(planted):
    unit = planted[:900] / np.linalg.norm(planted[:900], axis=1, keepdims=True)
    mean, projection = itq.fit(planted[:900], 96)
    ones = ((unit - mean) @ projection >= 0).mean(0)
    assert len(ones) >= 96
    assert ((ones > 0.35) & (ones < 0.65)).all()


def test_blocks_count_each_pair_once(spark, planted, monkeypatch):
    monkeypatch.setattr(itq, "BLOCK", 7)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(planted[1200:])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in itq.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(got))] == exact(planted[1200:]).sum(1).tolist()


def test_unusable_vectors_and_other_trouble(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (11, [float("inf"), 1.0]), (6, [1.0, 0.0]), (7, [2.0, 0.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (6, [1.0, 0.0]), (10, [1e300, 1e300])]
    got = itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 8, 10, 11)] + [(6, 3, 6, True)] * 2 + [(7, 3, 6, False), (None, 3, 6, False)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert itq.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_other_columns_and_floats(spark, planted):
    rows = [(i, x.astype(np.float32).tolist(), i) for i, x in enumerate(planted[1200:1300])]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    busy = plain.selectExpr("*", "1 as v", "2 as k", "'x' as cid", "3 as h1", "4 as copies", "5 as component_id", "6 as n_links")
    assert sorted(itq.near_duplicates(busy).collect()) == sorted(itq.near_duplicates(plain).collect())
    single = np.array([x.astype(np.float32) for x in planted[1200:1300]], np.float64)
    assert {r.vec_id: r.n_links for r in itq.near_duplicates(plain).collect()} == dict(enumerate(exact(single).sum(1).tolist()))


def test_chance_candidates_are_not_joined_before_they_are_checked(spark, monkeypatch):
    """Where all vectors share a direction chance candidates are many; what is compared exactly stays in proportion to them."""
    v = leaning(12_000, DIM, 0.7)
    near = partners(v[:50], 0.95, True)
    every = np.vstack([v, near])
    seen = {}
    real = itq.C.durable

    def noted(df):
        kept = real(df)
        if "dense" in df.columns:
            seen["pairs"], seen["entries"] = kept.where("not dense").count(), kept.where("dense").count()
        return kept

    monkeypatch.setattr(itq.C, "durable", noted)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(every)], "vec_id long, embedding array<double>")
    got = itq.near_duplicates(df).toPandas().set_index("vec_id").sort_index()
    assert (got.n_links.loc[12_000:] >= 1).mean() >= 0.93
    assert got.groupby("component_id").size().max() <= 4
    assert seen["pairs"] <= 10 * len(every) and seen["entries"] <= len(every)


@pytest.mark.parametrize("many", [0, 10**9])
def test_pairs_and_dense_blocks_find_the_same_links(spark, planted, monkeypatch, many):
    monkeypatch.setattr(itq, "BLOCK", 31)
    x = np.vstack([planted[:200], planted[900:1100], planted[1200:]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    real = itq._candidates

    def forced(batches, given, limit=many, inner=real):
        import quern.llm.itq as module

        module.MANY = limit
        return inner(batches, given)

    monkeypatch.setattr(itq, "_candidates", forced)
    got = {r.vec_id: r.n_links for r in itq.near_duplicates(df).collect()}
    linked = exact(x).sum(1)
    n = np.array([got[i] for i in range(len(x))])
    assert (n <= linked).all() and n.sum() >= 0.97 * linked.sum()


def test_parts_come_back_from_the_whole_code(planted):
    unit = planted[:500] / np.linalg.norm(planted[:500], axis=1, keepdims=True)
    model = itq.learn(unit[:300], 10**9)
    part, code = itq.whole_codes(unit, model)
    assert (itq.parts_of(code, model) == part).all() and code.shape[1] * 64 >= model.count * model.bits
