import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.config import Settings
from quern.operators import embedding, lookup, lsh, nearest, serving
from quern.plans import grid
from quern.sources import datasets, sinks


def test_budget_guard_stops_at_the_cap(spark):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate([5, 5, 0, 5, 1])], "seq int, cost int")
    got = serving.budget_guard(rows, F.col("cost"), 10, ["seq"], F.expr("seq div 2")).orderBy("seq").collect()
    assert [r.sent for r in got] == [True, True, False, False, False]
    assert [r.spent_before for r in got] == [0, 5, 10, 10, 15]


def test_pool_admits_the_first_keys_only(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, None), (3, "a"), (4, "c"), (5, None)], "seq int, k string")
    got = serving.admit(rows, ["k"], cap=2).orderBy("seq").collect()
    assert [r.admitted for r in got] == [True, True, False, True, False, False]


def test_responses_and_errors(spark):
    row = ("r", "llm", "m", None, "backend", "answer", 3, 4, None)
    hit = ("s", "exact_cache", "asked", None, None, "answer", 3, 4, 1.0)
    df = spark.createDataFrame([row, hit], "request_id string, source string, requested_model string, canonical_name string, response_model string, answer string, input_tokens int, output_tokens int, similarity double")
    miss, hit = serving.responses(df).orderBy("request_id").collect()
    assert (miss.id, miss.cache_status, miss.cache_similarity, miss.input_tokens, miss.model) == ("msg_r", "MISS", None, 3, "backend")
    assert (hit.cache_status, hit.cache_similarity, hit.output_tokens, hit.model) == ("HIT", 1.0, 0, "asked")
    names = spark.createDataFrame([(n,) for n in (*serving.ERRORS, "else", None)], "e string")
    assert [r.s for r in names.select(serving.error_status(F.col("e")).alias("s")).collect()] == [400, 402, 422, 500, 502, 500, 500, None]


def test_log_is_enough_to_replay(spark, tmp_path):
    fields = "seq long, request_id string, arrival_ts double, completion_ts double, embedding_model string, threshold double, prompt string, cache_source string, similarity double, latency_ms double"
    df = spark.createDataFrame([(1, "a", 1.5, 2.0, "m", 0.8, 'say "x"\n', "llm", None, 3.0)], fields)
    sinks.append_log(serving.log_records(df), str(tmp_path / "log"))
    record = json.loads("".join(p.read_text() for p in (tmp_path / "log").glob("part-*")))
    assert list(record) == [f.split()[0] for f in fields.split(", ")[1:]] and record["similarity"] is None
    back = datasets.from_log(spark, str(tmp_path / "log")).first()
    assert back.prompt == 'say "x"\n' and back.seq == 1


def test_store_operations(spark):
    schema = "key string, response_text string, created_at long, expires_at long"
    store = spark.createDataFrame([("k", "old", 1, None), ("l", "x", 1, 5)], schema)
    after = lookup.upsert(store, spark.createDataFrame([("k", "new", 1, None)], schema))
    assert {r.key: r.response_text for r in after.collect()} == {"k": "new", "l": "x"}
    assert lookup.delete(after, spark.createDataFrame([("k",), ("none",)], "key string")).count() == 1
    keyed = spark.createDataFrame([("p", "r", 1, 5)], schema).withColumn("key", F.sha2(F.lit("p"), 256))
    asked = spark.createDataFrame([("p",), ("P",)], "prompt string")
    hits = lambda now: {r.prompt: r.exact_hit for r in lookup.lookup(asked, keyed, F.lit(now)).collect()}
    assert hits(5) == {"p": True, "P": False} and hits(6) == {"p": False, "P": False}
    assert lookup.purge(store, F.lit(6)).count() == 1


def test_knn_blocks_agree_with_plain_search(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((150, 8))
    v[7] = 0
    v[20] = v[21]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    got = {}
    for r in nearest.knn(df, df, k=5, block=40).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.neighbour_id, r.distance))
    assert {round(x[2], 9) for x in got[7]} == {1.0}  # from the zero vector all are as far, up to rounding
    for i in set(range(150)) - {7}:
        d = np.sqrt(((u - u[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(150), np.round(d, 12))) if j != i][:5]
        assert [x[1] for x in sorted(got[i])] == order
    assert nearest.knn(df, df.limit(0)).count() == 0
    assert nearest.knn(df.limit(3), df.limit(3), k=10).count() == 6


def test_lsh_recall(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    near = base + 0.15 * rng.standard_normal(base.shape)
    rows = [(i, x.tolist()) for i, x in enumerate(np.vstack([base, near]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    radius = 0.4
    found = {(r.query_id, r.neighbour_id) for r in nearest.lsh_neighbours(df, df, radius).collect()}
    u = np.vstack([base, near])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    d = np.sqrt(((u[:, None] - u[None]) ** 2).sum(2))
    true = {(i, j) for i in range(120) for j in range(120) if i != j and d[i, j] <= radius}
    assert found <= true and len(found) >= 0.9 * len(true) > 0
    with pytest.raises(ValueError, match="backend"):
        nearest.search(df, df, backend="other")


def test_embedding_is_once_a_text(spark):
    assert embedding.mock_vector("hello")[:3] == pytest.approx([-0.0261806, 0.0292197, 0.0085234], abs=1e-6)
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id int, text string")
    got = {r.id: r.embedding for r in embedding.embed(df, embedding.mock_embedder(8), "m").collect()}
    assert got[1] == got[2] == embedding.mock_vector("a", 8) and got[3] != got[1] and got[4] is None
    assert embedding.resolve("all-minilm").canonical_name == "all-MiniLM-L6-v2"
    with pytest.raises(ValueError, match="modernbert"):
        embedding.resolve("other")


def test_grid(spark):
    cells = grid.grid(spark)
    rows = cells.orderBy("position").collect()
    assert len({r.config_id for r in rows}) == 30 and rows[0].config_id == "all-MiniLM-L6-v2|faq|0.70"
    assert grid.subset(cells, workloads=["faq"], thresholds=[0.7]).count() == 2
    with pytest.raises(ValueError):
        grid.subset(cells, models=["none"])


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("# QUERN_POOL_CAP=9\nQUERN_POOL_CAP=3\nQUERN_ENABLE_EXACT_CACHE=no\nQUERN_CACHE_TTL_SECONDS=\n")
    got = Settings.load(str(tmp_path / ".env"), env={"QUERN_SIMILARITY_THRESHOLD": "0.5"})
    assert (got.pool_cap, got.enable_exact_cache, got.cache_ttl_seconds, got.similarity_threshold) == (3, False, None, 0.5)
    with pytest.raises(ValueError):
        Settings(similarity_threshold=2)


def test_auto_search_is_exact_at_every_size(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SMALL_STORE_BYTES", 0)
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "vec_id long, embedding array<double>")
    got = nearest.search(df, df, radius=0.5, k=2)
    assert got.columns == nearest.knn(df, df, k=2).columns and got.count() == 12


def test_lsh_is_that_of_plain_code_and_moves_no_candidate_pair(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 12))
    x[:5] = 0.0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0, None] + [0.0] * 10), (902, [float("nan")] + [0.0] * 11), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    d = np.sqrt(((u[:, None] - u[None]) ** 2).sum(2))
    for width in (1.6, 0.3):
        sign = lsh.signatures(u, lsh.directions(3, 12, 42), width)
        met = (sign[:, None] == sign[None]).any(axis=2)
        want = {(i, j) for i in range(0, 400, 20) for j in range(400) if i != j and met[i, j] and d[i, j] <= 1.0}
        found = lsh.neighbours(df.where("vec_id % 20 = 0"), df, 1.0, tables=3, width=width, piece_bytes=1 << 13)
        got = [(r.query_id, r.neighbour_id) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want
    # One exchange, in front of the search: pairs are made where the vectors are.
    plan = found._jdf.queryExecution().executedPlan().toString().rpartition("== Initial Plan ==")[2]
    assert "Join" not in plan and plan.count("Exchange ") == 1
    assert lsh.neighbours(df, df.limit(0), 1.0).count() == lsh.neighbours(df.limit(0), df, 1.0).count() == 0
