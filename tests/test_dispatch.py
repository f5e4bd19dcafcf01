"""Calls that a budget gates and retries in chains, against a plain loop; every call that is sent is counted."""

import glob
import os

import pytest

from quern.config import Settings
from quern.engine import Engine
from quern.operators import backends, dispatch

by_prompt = lambda texts: [[float(b) for b in t.encode()[:4].ljust(4, b"x")] for t in texts]


def counted(folder, answer):
    """A backend that leaves a file for each call: ``answer(prompt, calls of it before)``."""

    def make():
        def ask(prompt):
            import os
            import uuid

            name = f"{folder}/{prompt.encode().hex()}"
            os.makedirs(name, exist_ok=True)
            before = len(os.listdir(name))
            open(f"{name}/{uuid.uuid4().hex}", "w").close()
            return answer(prompt, before)

        return ask

    return lambda df: backends.remote(df, make, retries=0, wait=0)


def sent(folder):
    return {bytes.fromhex(os.path.basename(d)).decode(): len(os.listdir(d)) for d in glob.glob(f"{folder}/*")}


def plain(prompts, cap, answer, cost):
    """(source, error) of each request in order, and the calls sent, for an exact cache."""
    store, spent, calls, out = set(), 0.0, {}, []
    for p in prompts:
        if p in store:
            out.append(("exact_cache", None))
        elif spent >= cap:
            out.append((None, "budget_exceeded"))
        else:
            n = calls.get(p, 0)
            calls[p] = n + 1
            try:
                answer(p, n)
                store.add(p)
                out.append(("llm", None))
                spent += cost
            except backends.Refusal:
                out.append((None, "provider_refusal"))
                spent += cost
            except OSError:
                out.append((None, "provider_error"))
    return out, calls


def frame(spark, prompts):
    return spark.createDataFrame([(i, f"r{i}", p) for i, p in enumerate(prompts)], "seq long, request_id string, prompt string")


def served(spark, folder, prompts, answer, **settings):
    engine = Engine(Settings(enable_semantic_cache=False, **settings), by_prompt, counted(folder, answer))
    rows = engine.serve(frame(spark, prompts)).select("seq", "source", "error", "status").collect()
    return [(r.source, r.error) for r in sorted(rows, key=lambda r: r.seq)], {r.status for r in rows}


def test_no_call_is_sent_beyond_the_budget(spark, tmp_path):
    answer = lambda prompt, before: backends.Answer("x", "m", 1_000_000, 0)  # noqa: E731  five dollars a call
    prompts = [f"p{i}" for i in range(30)]
    got, statuses = served(spark, tmp_path, prompts, answer, budget_cap_usd=10.0)
    assert got == plain(prompts, 10.0, answer, 5.0)[0] and statuses == {None, 402}
    assert sum(sent(tmp_path).values()) == 2


@pytest.mark.parametrize("cap", [0.0, 33.0, 1000.0])
def test_equal_to_calls_in_order_with_failures_of_every_kind(spark, tmp_path, cap):
    def answer(prompt, before):
        if prompt == "refused" or (prompt == "late" and before < 3):
            raise backends.Refusal(1_000_000, 0)
        if prompt == "down" or (prompt == "flaky" and before < 1):
            raise OSError("down")
        return backends.Answer("x", "m", 1_000_000, 0)

    prompts = ["a", "down", "flaky", "refused", "b", "down", "late", "flaky", "a", "late", "refused", "c", "late", "flaky", "down", "late", "late", "d"]
    want, calls = plain(prompts, cap, answer, 5.0)
    got, _ = served(spark, tmp_path, prompts, answer, budget_cap_usd=cap, call_reserve_usd=5.0)
    assert got == want
    assert all(n <= calls[p] for p, n in sent(tmp_path).items()) and (cap != 1000.0 or sent(tmp_path) == calls)


def test_a_thousand_repeats_of_a_failing_prompt_take_few_rounds(spark, tmp_path, monkeypatch):
    rounds = []
    real = dispatch._covered
    monkeypatch.setattr(dispatch, "_covered", lambda *a: (rounds.append(1), real(*a))[1])

    def answer(prompt, before):
        if prompt == "bad":
            raise OSError("down")
        return backends.Answer("x", "m", 0, 0)

    prompts = ["ok", *["bad"] * 1000, "ok", "other"]
    got, _ = served(spark, tmp_path, prompts, answer)
    assert got == plain(prompts, 200.0, answer, 0.0)[0]
    assert sent(tmp_path) == {"ok": 1, "bad": 1000, "other": 1} and len(rounds) <= 8


def test_unknown_models_get_an_error_and_no_place_in_the_pool(spark):
    rows = [(0, "a", "no-such-model"), (1, "b", None), (2, "c", "modernbert"), (3, "d", "no-such-model"), (4, "e", None)]
    df = spark.createDataFrame([(s, f"r{s}", p, m) for s, p, m in rows], "seq long, request_id string, prompt string, embedding_model string")
    got = {r.seq: (r.source, r.error, r.status) for r in Engine(Settings(pool_cap=2, enable_semantic_cache=False), by_prompt).serve(df).collect()}
    assert got[0] == (None, "unknown_model", 500) and got[1][0] == got[2][0] == got[4][0] == "llm"
    assert got[3] == (None, "pool_cap_exceeded", 400)  # the pool is full by then
    assert Engine(Settings()).serve(df).where("seq = 0").first().source == "llm"  # the mock embedder takes any name


def test_breakdown_is_of_the_capped_store_and_the_index_of_its_own(spark):
    df = frame(spark, [f"{chr(97 + i % 26)}{i}" for i in range(40)] + ["a0"])
    off = Engine(Settings(cache_max_size=5, enable_semantic_cache=False), by_prompt)
    row = off.breakdown(served_ := off.serve(df)).first()
    assert (row.model_breakdown, row.index_size) == ({"all-MiniLM-L6-v2": 5}, 0)
    report = off.clear_report(served_).first()
    assert (report.exact_entries, report.semantic_entries) == (5, 0)
    on = Engine(Settings(cache_max_size=5, similarity_threshold=1.0), by_prompt)
    row = on.breakdown(on.serve(df)).first()
    assert (row.model_breakdown, row.index_size) == ({"all-MiniLM-L6-v2": 5}, 40)


def test_the_search_backend_comes_from_the_settings(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0 + i % 3]) for i in range(60)], "vec_id long, embedding array<double>")
    want = sorted((r.query_id, r.neighbour_id) for r in Engine(Settings(), by_prompt).search(df, df, 2).collect())
    assert sorted((r.query_id, r.neighbour_id) for r in Engine(Settings(index_backend="cells"), by_prompt).search(df, df, 2).collect()) == want
    assert Engine(Settings(index_backend="ivf"), by_prompt).search(df, df, 2).count() == 120
    assert Engine(Settings(index_backend="lsh", similarity_threshold=0.9), by_prompt).search(df, df, 2).count() > 0


def test_the_backend_comes_from_the_settings(spark):
    df = frame(spark, ["a", "b", "a"])
    slow = Engine(Settings(mock_latency_seconds=0.01, enable_semantic_cache=False), by_prompt).serve(df).collect()
    quick = Engine(Settings(enable_semantic_cache=False), by_prompt).serve(df).collect()
    assert sorted((r.seq, r.answer, r.source) for r in slow) == sorted((r.seq, r.answer, r.source) for r in quick)
    with pytest.raises(ValueError, match="provider"):
        Engine(Settings(llm_provider="none"))
