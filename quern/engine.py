"""A stream of requests through the whole cache, in set form.

    engine = Engine(Settings(similarity_threshold=0.8))
    served = engine.serve(requests)          # seq, request_id, prompt, ...
    engine.responses(served), engine.stats(served), engine.clear_report(served)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.config import Settings
from quern.functions.columns import prompt_key, token_count
from quern.operators import backends, dispatch, embedding, memo, metrics, nearest, replay, serving
from quern.operators.shared import durable

Embedder = Callable[[list[str]], list[list[float]]]


class Engine:
    """Routes requests to pool keys, replays each key's cache in order and answers what it missed."""

    def __init__(self, settings: Settings | None = None, embedder: Embedder | None = None, backend: Callable[[DataFrame], DataFrame] | None = None):
        self.settings = settings or Settings()
        self.embedder = embedder
        self._given = embedder is not None
        self.backend = backend or backends.by_settings(self.settings)
        if embedder is None:
            self._embedder(self.settings.embedding_model)

    def _embedder(self, model: str) -> Embedder:
        s = self.settings
        if s.embedding_provider == "mock":
            return embedding.mock_embedder()
        if s.embedding_provider == "sentence-transformers":
            return embedding.transformer_embedder(embedding.resolve(model).checkpoint, s.trust_remote_code)
        if s.embedding_provider == "http":
            return embedding.http_embedder(s.embedding_url, model)
        raise ValueError(f"unknown embedding provider {s.embedding_provider!r}")

    def _vectors(self, rows: DataFrame) -> DataFrame:
        """``(pool_model, prompt, canonical_name, embedding)``: each distinct prompt by the model of its pool key.

        Each model has an embedder and a prefix of its own; there are at most
        as many models as the pool has keys. With a memo folder in the settings
        only prompts that no run has embedded yet are.
        """
        out = None
        for r in rows.select("pool_model").distinct().orderBy("pool_model").limit(self.settings.pool_cap).collect():
            known = embedding.REGISTRY.get(r.pool_model) or embedding.Model(r.pool_model, "")  # a name that mock and http embedders take as it is
            prompts = rows.where(F.col("pool_model") == r.pool_model).select("prompt").distinct()
            embed = memo.Memo(rows.sparkSession, self.settings.memo_folder).embed if self.settings.memo_folder else embedding.embed
            got = embed(prompts, self.embedder or self._embedder(r.pool_model), known.canonical_name, text="prompt", prefix=known.prefix)
            got = got.select(F.lit(r.pool_model).alias("pool_model"), "prompt", F.lit(known.canonical_name).alias("canonical_name"), "embedding")
            out = got if out is None else out.unionByName(got)
        return out if out is not None else rows.sparkSession.createDataFrame([], "pool_model string, prompt string, canonical_name string, embedding array<double>")

    def _replay(self, keyed: DataFrame, calls: DataFrame | None) -> DataFrame:
        """Decisions, where requests whose call failed, and those after a spent budget, would store nothing."""
        s = self.settings
        rows = keyed.select("config", "seq", "key", F.col("embedding").alias("vector"), F.col("pool_threshold").alias("threshold"), "now")
        if calls is not None:
            failed = calls.where("error is not null").select("config", "seq", F.lit(True).alias("bad"))
            closed = calls.where("error = 'budget_exceeded'").groupBy("config").agg(F.min("seq").alias("closed"))
            rows = rows.join(failed, ["config", "seq"], "left").join(F.broadcast(closed), "config", "left")  # a row a pool key
            rows = rows.withColumn("failed", F.coalesce("bad", F.lit(False)) | F.coalesce(F.col("seq") >= F.col("closed"), F.lit(False))).drop("bad", "closed")
        return replay.replay(rows, max_size=s.cache_max_size, ttl=s.cache_ttl_seconds, exact=s.enable_exact_cache, semantic=s.enable_semantic_cache, hot=s.hot_requests)

    def _budget(self) -> dispatch.Budget:
        s = self.settings
        return dispatch.Budget(s.budget_cap_usd, s.input_price_per_mtok, s.output_price_per_mtok, s.max_output_tokens, s.call_reserve_usd)

    def _decide(self, keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(decisions, calls with their answers): what fails stores nothing, so the next equal prompt is asked again.

        Rounds of replay and calls: a replay tells which requests call, given
        what is known to fail; their calls, and after a failure those of the equal
        prompts that follow, are sent (``dispatch``); another replay is needed only
        where some failed. The deterministic backend never fails and needs one.
        """
        if self.backend is backends.mock:
            decided = self._replay(keyed, None)
            return decided, self.backend(keyed.join(decided.where("stored").select("config", "seq"), ["config", "seq"]).select("config", "seq", "prompt"))
        budget = self._budget()
        requests = keyed.select("config", "seq", "key", "prompt")
        calls = None
        while True:
            decided = durable(self._replay(keyed, calls))
            asked = decided.where(F.col("source") == replay.LLM).select("config", "seq")
            if calls is not None:
                asked = asked.join(calls, ["config", "seq"], "left_anti")
            asked = durable(requests.join(asked, ["config", "seq"]).select("config", "seq", "key"))
            if calls is not None and asked.isEmpty():
                return decided, calls
            calls = dispatch.send(requests, asked, calls, self.backend, budget)
            if calls is None:  # there was no request
                return decided, keyed.sparkSession.createDataFrame([], dispatch.CALL)
            calls = durable(dispatch.settle(calls, budget))
            if calls.where("error is not null").isEmpty():
                return decided, calls

    def _unknown(self, routed: DataFrame) -> Column:
        """Whether a request asks for a model that is not there; mock and http embedders take any name."""
        if self._given or self.settings.embedding_provider == "sentence-transformers":
            return ~F.col("pool_model").isin(*embedding.REGISTRY)
        return F.lit(False)

    def serve(self, requests: DataFrame) -> DataFrame:
        """``requests(seq, request_id, prompt[, embedding_model, threshold, requested_model, now, latency_ms])``, decided and answered.

        A request that is invalid (no prompt, or a threshold outside [0, 1]),
        asks for an unknown model, is of a key beyond the pool's cap, beyond its
        key's budget, or whose call failed or was refused has an error, its
        status and no source; it stores nothing, and an unknown model takes no
        place in the pool. Calls beyond the budget are not sent. A prompt is
        embedded once by each model.
        """
        s = self.settings
        have = set(requests.columns)
        optional = {"embedding_model": "string", "threshold": "double", "requested_model": "string", "now": "double", "latency_ms": "double"}
        full = requests.withColumns({c: F.lit(None).cast(t) for c, t in optional.items() if c not in have})
        invalid = F.col("prompt").isNull() | F.coalesce(~F.col("threshold").between(0.0, 1.0), F.lit(False))
        routed = serving.route(full.where(~invalid), s.embedding_model, s.similarity_threshold)
        unknown = self._unknown(routed)
        known, pool = routed.where(~unknown), ["pool_model", "pool_threshold"]
        admitted = serving.admit(known, pool, s.pool_cap)
        rows = admitted.where("admitted").withColumn("config", F.format_string("%s|%.6f", "pool_model", "pool_threshold"))
        keyed = durable(rows.join(self._vectors(rows), ["pool_model", "prompt"], "left").withColumn("key", prompt_key(F.col("prompt"))))
        decided, calls = self._decide(keyed)
        joined = keyed.join(decided, ["config", "seq"]).withColumn("answer_seq", F.coalesce("matched_seq", "seq"))
        answered = calls.select("config", F.col("seq").alias("answer_seq"), "answer", "response_model", "input_tokens", "output_tokens", "error")
        out = joined.join(answered, ["config", "answer_seq"], "left")
        failed = F.col("error").isNotNull()
        out = out.withColumn("source", F.when(~failed, F.col("source"))).withColumn("tokens", F.when(~failed, token_count(F.col("answer"))).otherwise(0))
        rejected = admitted.where("not admitted").withColumn("error", F.lit("pool_cap_exceeded"))
        wrong = full.where(invalid).withColumn("error", F.lit("invalid_request"))
        full_at = serving.full_at(known, pool, s.pool_cap)
        late = F.lit(False) if full_at is None else F.col("seq") > full_at
        nowhere = routed.where(unknown).withColumn("error", F.when(late, "pool_cap_exceeded").otherwise("unknown_model"))
        every = out
        for more in (rejected, wrong, nowhere):
            every = every.unionByName(more, allowMissingColumns=True)
        return every.withColumn("status", serving.error_status(F.col("error")))

    def search(self, queries: DataFrame, store: DataFrame, k: int = 1, **options) -> DataFrame:
        """Nearest neighbours by the backend that the settings name."""
        s = self.settings
        own = {"lsh": {"radius": nearest.max_distance(s.similarity_threshold), "tables": s.lsh_tables, "width": s.lsh_width}, "ivf": {"recall": s.index_recall, "folder": s.index_folder or None}}
        return nearest.search(queries, store, s.index_backend, k=k, **own.get(s.index_backend, {}), **options)

    def responses(self, served: DataFrame) -> DataFrame:
        return serving.responses(served.where("error is null"))

    def stats(self, served: DataFrame) -> DataFrame:
        """Totals by pool key and over all."""
        return metrics.roll_up(metrics.counters(served, "pool_model", "pool_threshold"), "pool_model", "pool_threshold")

    def _stored(self, served: DataFrame) -> DataFrame:
        """What was stored, and where it still is."""
        stored = served.where("stored and error is null")
        return metrics.held(stored, self.settings.cache_max_size, self.settings.enable_semantic_cache, ("pool_model", "pool_threshold"))

    def breakdown(self, served: DataFrame) -> DataFrame:
        """The exact store's entries by model, and the semantic index's size, by pool key."""
        return metrics.model_breakdown(self._stored(served), "pool_model", "pool_threshold")

    def clear_report(self, served: DataFrame) -> DataFrame:
        """What a clear removes by pool key: the exact store holds its cap at most, the index everything stored."""
        return metrics.clear_report(self._stored(served), "pool_model", "pool_threshold")

    def log(self, served: DataFrame) -> DataFrame:
        done = served.where("source is not null")
        rows = done.select("seq", "request_id", F.col("now").alias("arrival_ts"), (F.col("now") + F.col("latency_ms") / 1000).alias("completion_ts"), F.col("pool_model").alias("embedding_model"), F.col("pool_threshold").alias("threshold"), "prompt", F.col("source").alias("cache_source"), "similarity", "latency_ms")
        return serving.log_records(rows)
