"""Settings of the engine, from the environment or a dotenv file."""

from __future__ import annotations

import dataclasses
import os
from dataclasses import dataclass
from pathlib import Path

PREFIX = "QUERN_"


@dataclass(frozen=True)
class Settings:
    llm_provider: str = "mock"
    llm_model: str = "mock"
    llm_base_url: str = ""
    mock_latency_seconds: float = 0.0
    max_retries: int = 2
    max_output_tokens: int = 256
    budget_cap_usd: float = 200.0
    call_reserve_usd: float | None = None
    input_price_per_mtok: float = 5.0
    output_price_per_mtok: float = 25.0
    embedding_provider: str = "mock"
    embedding_model: str = "all-MiniLM-L6-v2"
    embedding_url: str = "http://localhost:11434/api/embeddings"
    trust_remote_code: bool = False
    memo_folder: str = ""
    enable_exact_cache: bool = True
    enable_semantic_cache: bool = True
    similarity_threshold: float = 0.85
    cache_ttl_seconds: float | None = None
    cache_max_size: int = 1000
    pool_cap: int = 8
    hot_requests: int = 200_000
    index_backend: str = "auto"
    index_recall: float = 0.95
    index_folder: str = ""
    lsh_tables: int = 8
    lsh_width: float = 1.6

    def __post_init__(self) -> None:
        if not 0.0 <= self.similarity_threshold <= 1.0:
            raise ValueError("similarity_threshold must be in [0, 1]")
        if self.index_backend not in ("auto", "exact", "cells", "ivf", "lsh"):
            raise ValueError(f"unknown index backend {self.index_backend!r}")

    @classmethod
    def load(cls, dotenv: str | None = None, env: dict[str, str] | None = None) -> Settings:
        """Environment variables over a dotenv file over the defaults; empty values are ignored."""
        found: dict[str, str] = {}
        if dotenv and Path(dotenv).exists():
            for line in Path(dotenv).read_text(encoding="utf-8").splitlines():
                name, eq, value = line.partition("=")
                if eq and not name.lstrip().startswith("#"):
                    found[name.strip()] = value.strip().strip("\"'")
        found |= os.environ if env is None else env
        given = {}
        for f in dataclasses.fields(cls):
            raw = found.get(PREFIX + f.name.upper(), "")
            if raw:
                kind = type(f.default) if f.default is not None else float
                given[f.name] = raw.lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
        return cls(**given)
