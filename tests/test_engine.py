import pytest
from pyspark.sql import functions as F

from quern.config import Settings
from quern.engine import Engine
from quern.operators import backends
from quern.sources import datasets, store


# A lambda goes to the workers as it is; they can't import this module.
by_first_letter = lambda texts: [[1.0, 0.0] if t.removeprefix("search_query: ")[:1] == "a" else [0.0, 1.0] for t in texts]


@pytest.fixture
def requests(spark):
    rows = [(0, "r0", "apple", None), (1, "r1", "apple", None), (2, "r2", "avocado", None), (3, "r3", "banana", None), (4, "r4", "apple", "modernbert"), (5, "r5", "x", "third")]
    return spark.createDataFrame(rows, "seq long, request_id string, prompt string, embedding_model string").withColumns({"now": F.col("seq").cast("double"), "latency_ms": F.lit(2.0)})


def test_requests_pass_through_the_cascade(spark, requests, tmp_path):
    engine = Engine(Settings(similarity_threshold=0.9, pool_cap=2), by_first_letter)
    served = engine.serve(requests).cache()
    got = {r.seq: (r.source, r.matched_seq, r.answer, r.status) for r in served.collect()}
    apple = "Computed response for: elppa"
    assert got[0] == ("llm", None, apple, None) and got[1] == ("exact_cache", 0, apple, None)
    assert got[2] == ("semantic_cache", 0, apple, None) and got[3][0] == "llm"
    assert got[4][0] == "llm"  # another pool key, another cache
    assert got[5] == (None, None, None, 400)
    heads = {r.request_id: (r.cache_status, r.cache_similarity, r.input_tokens) for r in engine.responses(served).collect()}
    assert heads["r0"] == ("MISS", None, 0) and heads["r1"] == ("HIT", 1.0, 0) and "r5" not in heads
    whole = engine.stats(served).where("all_pool_model = 1 and all_pool_threshold = 1").first()
    assert (whole.total_requests, whole.exact_hits, whole.semantic_hits, whole.misses) == (5, 1, 1, 3) and whole.hit_rate == pytest.approx(0.4)
    assert whole.tokens_saved == 2 * 4  # the words of the cached answers
    assert {r.pool_model: (r.exact_entries, r.semantic_entries) for r in engine.clear_report(served).collect()} == {"all-MiniLM-L6-v2": (2, 2), "modernbert": (1, 1)}
    assert {r.pool_model: r.index_size for r in engine.breakdown(served).collect()} == {"all-MiniLM-L6-v2": 2, "modernbert": 1}
    engine.log(served).select(F.col("record").alias("value")).write.text(str(tmp_path / "log"))
    again = datasets.from_log(spark, str(tmp_path / "log")).where("embedding_model = 'all-MiniLM-L6-v2'")
    replayed = engine.serve(again.select("seq", "request_id", "prompt", F.lit(None).cast("string").alias("embedding_model")))
    assert [r.source for r in replayed.orderBy("seq").collect()] == ["llm", "exact_cache", "semantic_cache", "llm"]


def test_snapshot_of_the_store(spark, requests, tmp_path):
    engine = Engine(Settings(similarity_threshold=0.9, pool_cap=1), by_first_letter)
    entries = store.entries(engine.serve(requests), ttl=10)
    store.save(entries, str(tmp_path / "s"))
    (tmp_path / "s" / "part-bad.json").write_text("not an entry\n")
    got = {r.prompt: (r.access_count, r.expires_at) for r in store.load(spark, str(tmp_path / "s")).collect()}
    assert got == {"apple": (2, 10.0), "banana": (0, 13.0)}
    assert [r.prompt for r in store.load(spark, str(tmp_path / "s"), F.lit(12.0)).collect()] == ["banana"]


def test_failed_and_refused_calls_are_no_hits_and_no_totals(spark, requests):
    def make():
        def ask(prompt):
            if prompt == "apple":
                raise backends.Refusal(3, 0)
            raise OSError("down")

        return ask

    engine = Engine(Settings(pool_cap=1), by_first_letter, lambda df: backends.remote(df, make, retries=1, wait=0))
    got = {r.seq: (r.source, r.error, r.status) for r in engine.serve(requests).collect()}
    # Nothing was stored, so the next equal prompt is asked again and refused again.
    assert got[0] == got[1] == (None, "provider_refusal", 502) and got[2] == got[3] == (None, "provider_error", 500)


def test_a_failed_call_is_made_again_for_the_next_equal_prompt(spark, requests, tmp_path):
    mark = str(tmp_path / "asked")

    def make():
        def ask(prompt):
            import os

            if prompt == "apple" and not os.path.exists(mark):
                open(mark, "w").close()
                raise OSError("down once")
            return backends.Answer(f"says {prompt}", "m", 1, 2)

        return ask

    engine = Engine(Settings(pool_cap=1), by_first_letter, lambda df: backends.remote(df, make, retries=0, wait=0))
    got = {r.seq: (r.source, r.matched_seq, r.answer, r.error) for r in engine.serve(requests).collect()}
    assert got[0] == (None, None, None, "provider_error")
    assert got[1] == ("llm", None, "says apple", None)
    assert got[2] == ("semantic_cache", 1, "says apple", None)


def test_budget_is_each_keys_own_and_invalid_requests_get_no_answer(spark):
    make = lambda: lambda prompt: backends.Answer("x", "m", 1_000_000, 0)  # noqa: E731  five dollars a call
    rows = [(i, f"r{i}", f"{w} {i}", m, t) for i, (w, m, t) in enumerate([("a", None, None), ("b", None, None), ("c", None, None), ("d", "modernbert", None), ("e", None, 1.5), (None, None, None)])]
    rows = [(s, r, None if p.startswith("None") else p, m, t) for s, r, p, m, t in rows]
    df = spark.createDataFrame(rows, "seq long, request_id string, prompt string, embedding_model string, threshold double")
    engine = Engine(Settings(budget_cap_usd=9.0, similarity_threshold=0.99, enable_semantic_cache=False), by_first_letter, lambda d: backends.remote(d, make))
    got = {r.seq: (r.source, r.status) for r in engine.serve(df).collect()}
    assert got == {0: ("llm", None), 1: ("llm", None), 2: (None, 402), 3: ("llm", None), 4: (None, 422), 5: (None, 422)}


def test_each_pool_key_embeds_by_its_own_model(spark, requests):
    served = Engine(Settings(), by_first_letter).serve(requests.where("seq in (0, 4)"))
    names = {r.seq: r.canonical_name for r in served.collect()}
    from quern.operators import embedding

    assert names == {0: embedding.resolve("all-MiniLM-L6-v2").canonical_name, 4: embedding.resolve("modernbert").canonical_name}


def test_connectors_read_their_servers_answers():
    def send(url, headers, body):
        if url.endswith("/chat/completions"):
            assert headers["Authorization"] == "Bearer k"
            return {"choices": [{"message": {"content": "c"}}], "usage": {"prompt_tokens": 1, "completion_tokens": 2}, "model": "m2"}
        if url.endswith("/api/generate"):
            return {"response": "g", "eval_count": 4}
        if body["messages"][0]["content"] == "no":
            return {"stop_reason": "refusal", "usage": {"input_tokens": 5}, "content": []}
        return {"content": [{"type": "text", "text": "x"}, {"type": "other"}, {"type": "text", "text": "y"}], "usage": {"input_tokens": 6, "output_tokens": 7}}

    assert backends.chat_completions("u", "m", "k", send)("p") == backends.Answer("c", "m2", 1, 2)
    assert backends.local_generate("u", "m", send)("p") == backends.Answer("g", "m", 0, 4)
    assert backends.messages("u", "m", "k", send=send)("p") == backends.Answer("xy", "m", 6, 7)
    with pytest.raises(backends.Refusal):
        backends.messages("u", "m", "k", send=send)("no")


def test_unknown_provider():
    with pytest.raises(ValueError, match="provider"):
        Engine(Settings(embedding_provider="none"))
