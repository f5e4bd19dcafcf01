"""Backends that answer what the cache does not.

The mock backend is a pair of column expressions. A remote one is a function
from prompts to answers that runs on batches; it is made once a worker, and
what it refuses or fails at becomes a status, not an error of the job.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.columns import MOCK_PREFIX, mock_answer
from quern.operators.serving import MOCK_MODEL

ANSWER = "answer string, response_model string, input_tokens int, output_tokens int, error string"


class Refusal(Exception):
    """The provider answered but declined; it has been paid for."""

    def __init__(self, input_tokens: int = 0, output_tokens: int = 0):
        super().__init__("refused")
        self.input_tokens, self.output_tokens = input_tokens, output_tokens


@dataclass(frozen=True)
class Answer:
    text: str
    model: str
    input_tokens: int
    output_tokens: int


Post = Callable[[str, dict, dict], dict]


def post(url: str, headers: dict, body: dict, timeout: float = 60.0) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as r:
        return json.load(r)


def chat_completions(base_url: str, model: str, key: str, send: Post = post) -> Callable[[str], Answer]:
    """A server of the chat-completions form."""

    def ask(prompt: str) -> Answer:
        got = send(f"{base_url}/chat/completions", {"Authorization": f"Bearer {key}"}, {"model": model, "messages": [{"role": "user", "content": prompt}]})
        usage = got.get("usage", {})
        return Answer(got["choices"][0]["message"]["content"], got.get("model", model), usage.get("prompt_tokens", 0), usage.get("completion_tokens", 0))

    return ask


def local_generate(base_url: str, model: str, send: Post = post) -> Callable[[str], Answer]:
    """A local server that takes a prompt and gives one response."""

    def ask(prompt: str) -> Answer:
        got = send(f"{base_url}/api/generate", {}, {"model": model, "prompt": prompt, "stream": False})
        return Answer(got["response"], model, got.get("prompt_eval_count", 0), got.get("eval_count", 0))

    return ask


def messages(base_url: str, model: str, key: str, max_tokens: int = 256, send: Post = post) -> Callable[[str], Answer]:
    """A server of the messages form, whose answers are lists of blocks and may be refusals."""

    def ask(prompt: str) -> Answer:
        got = send(f"{base_url}/v1/messages", {"x-api-key": key, "anthropic-version": "2023-06-01"}, {"model": model, "max_tokens": max_tokens, "messages": [{"role": "user", "content": prompt}]})
        usage = got.get("usage", {})
        if got.get("stop_reason") == "refusal":
            raise Refusal(usage.get("input_tokens", 0), usage.get("output_tokens", 0))
        text = "".join(b["text"] for b in got["content"] if b.get("type") == "text")
        return Answer(text, got.get("model", model), usage.get("input_tokens", 0), usage.get("output_tokens", 0))

    return ask


def _ask(ask: Callable[[str], Answer], prompt: str, retries: int, wait: float) -> tuple:
    for attempt in range(retries + 1):
        try:
            a = ask(prompt)
            return a.text, a.model, a.input_tokens, a.output_tokens, None
        except Refusal as r:
            return None, None, r.input_tokens, r.output_tokens, "provider_refusal"
        except (OSError, KeyError, IndexError, ValueError):
            if attempt == retries:
                return None, None, 0, 0, "provider_error"
            time.sleep(wait * 2**attempt)
    raise AssertionError


def mock(requests: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Never fails, and states no usage by input and output."""
    text = mock_answer(F.col(prompt))
    return requests.withColumns({"answer": text, "response_model": F.lit(MOCK_MODEL), "input_tokens": F.lit(0), "output_tokens": F.lit(0), "error": F.lit(None).cast("string")})


def remote(requests: DataFrame, make: Callable[[], Callable[[str], Answer]], prompt: str = "prompt", retries: int = 2, wait: float = 0.5) -> DataFrame:
    """Requests with what the backend that ``make`` gives says to each distinct prompt; each is asked once.

    Rows that have ``seqs`` are chains (see ``dispatch``): for each place in
    order the prompt is asked, until an answer comes.
    """
    if "seqs" in requests.columns:
        return chains(requests, make, prompt, retries, wait)
    distinct = requests.select(F.col(prompt).alias("_p")).where("_p is not null").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()
        for b in batches:
            rows = [(p, *_ask(ask, p, retries, wait)) for p in b["_p"]]
            yield pd.DataFrame(rows, columns=["_p", "answer", "response_model", "input_tokens", "output_tokens", "error"])

    answers = distinct.mapInPandas(run, f"_p string, {ANSWER}")
    return requests.join(answers, requests[prompt] == answers["_p"], "left").drop("_p")


def chains(requests: DataFrame, make: Callable[[], Callable[[str], Answer]], prompt: str = "prompt", retries: int = 2, wait: float = 0.5) -> DataFrame:
    """``(config, seq, key, segment, answer, ...)`` of the places of each row's ``seqs`` that were asked for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()
        for b in batches:
            rows = []
            for config, key, segment, text, seqs in zip(b["config"], b["key"], b["segment"], b["prompt"], b["seqs"], strict=True):
                for seq in seqs:
                    got = _ask(ask, text, retries, wait)
                    rows.append((config, int(seq), key, segment, *got))
                    if got[-1] is None:
                        break
            yield pd.DataFrame(rows, columns=["config", "seq", "key", "segment", "answer", "response_model", "input_tokens", "output_tokens", "error"])

    rows = requests.select("config", "key", "segment", F.col(prompt).alias("prompt"), "seqs")
    return rows.mapInPandas(run, f"config string, seq long, key string, segment long, {ANSWER}")


def by_settings(settings) -> Callable[[DataFrame], DataFrame]:
    """The backend that ``llm_provider`` names: mock, chat-completions, local-generate or messages.

    Keys come from the environment of the workers, never from a plan.
    """
    kind, url, model = settings.llm_provider, settings.llm_base_url, settings.llm_model
    if kind == "mock" and not settings.mock_latency_seconds:
        return mock
    if kind not in ("mock", "chat-completions", "local-generate", "messages"):
        raise ValueError(f"unknown backend provider {kind!r}")
    latency, most, retries = settings.mock_latency_seconds, settings.max_output_tokens, settings.max_retries

    def make() -> Callable[[str], Answer]:
        import os

        key = os.environ.get("QUERN_LLM_KEY", "")
        if kind == "chat-completions":
            return chat_completions(url, model, key)
        if kind == "local-generate":
            return local_generate(url, model)
        if kind == "messages":
            return messages(url, model, key, most)

        def slow(prompt: str) -> Answer:
            time.sleep(latency)
            return Answer(MOCK_PREFIX + prompt[::-1], MOCK_MODEL, 0, 0)

        return slow

    return lambda df: remote(df, make, retries=retries)
