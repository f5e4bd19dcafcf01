"""Embedding by distinct text: each text of a model goes through its function once."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSION = 384


@dataclass(frozen=True)
class Model:
    canonical_name: str
    checkpoint: str
    prefix: str = ""
    dimension: int = DIMENSION


# Names by which models are asked for.
_MINILM = Model("all-MiniLM-L6-v2", "sentence-transformers/all-MiniLM-L6-v2")
_MODERN = Model("modernbert", "nomic-ai/modernbert-embed-base", "search_query: ", 768)
REGISTRY = {
    "all-minilm": _MINILM,
    "all-MiniLM-L6-v2": _MINILM,
    "modernbert": _MODERN,
}


def resolve(name: str) -> Model:
    if name not in REGISTRY:
        raise ValueError(f"unknown embedding model {name!r}; known: {sorted({m.canonical_name for m in REGISTRY.values()})}")
    return REGISTRY[name]


def mock_vector(text: str, dimension: int = DIMENSION) -> list[float]:
    """A unit vector that the text alone decides, the same in every process."""
    rng = random.Random(text)
    v = np.array([rng.uniform(-1.0, 1.0) for _ in range(dimension)])
    return (v / np.linalg.norm(v)).tolist()


def mock_embedder(dimension: int = DIMENSION) -> Callable[[list[str]], list[list[float]]]:
    return lambda texts: [mock_vector(t, dimension) for t in texts]


def transformer_embedder(checkpoint: str, trust_remote_code: bool = False) -> Callable[[list[str]], list[list[float]]]:
    """A model that is loaded once a worker; needs the optional package for it."""
    held: dict[str, object] = {}

    def embed(texts: list[str]) -> list[list[float]]:
        if "model" not in held:
            from sentence_transformers import SentenceTransformer

            held["model"] = SentenceTransformer(checkpoint, trust_remote_code=trust_remote_code)
        return held["model"].encode(texts).tolist()

    return embed


def http_embedder(url: str, model: str, timeout: float = 30.0) -> Callable[[list[str]], list[list[float]]]:
    """A server that takes {"model", "prompt"} and answers {"embedding"}."""
    import json
    import urllib.request

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            body = json.dumps({"model": model, "prompt": t}).encode()
            with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as r:
                out.append(json.load(r)["embedding"])
        return out

    return embed


def embed(texts: DataFrame, embedder: Callable[[list[str]], list[list[float]]], model: str, text: str = "text", prefix: str = "") -> DataFrame:
    """Rows with ``model``, ``text_hash`` and ``embedding``.

    Texts are hashed with the model's prefix, each distinct one is embedded
    once, and vectors are joined back.
    """
    hashed = texts.withColumn("model", F.lit(model)).withColumn("text_hash", F.sha2(F.concat(F.lit(prefix), F.col(text)), 256))
    distinct = hashed.groupBy("model", "text_hash").agg(F.first(F.concat(F.lit(prefix), F.col(text))).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"model": b["model"], "text_hash": b["text_hash"], "embedding": embedder(b["t"].tolist())})

    vectors = distinct.where("t is not null").mapInPandas(run, "model string, text_hash string, embedding array<double>")
    return hashed.join(vectors, ["model", "text_hash"], "left")
