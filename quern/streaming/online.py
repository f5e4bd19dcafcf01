"""The cache as a stream: each key's requests are decided against state that they fill."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quern.functions.columns import normalised, prompt_key
from quern.operators.replay import Cache

OUT = "config string, seq long, source string, similarity double, matched_seq long, stored boolean"


class CacheProcessor(StatefulProcessor):
    """The exact store as one value (give it a max_size) and the semantic index as a list, by configuration.

    A configuration's requests are decided in order of seq within a batch; new
    vectors are appended to the list.
    """

    def __init__(self, max_size: int | None = None, ttl: float | None = None, semantic: bool = True):
        self.options = {"max_size": max_size, "ttl": ttl, "semantic": semantic}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.exact = handle.getValueState("exact", "entries string")
        self.index = handle.getListState("index", "seq long, vector array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        import numpy as np

        cache = Cache(**self.options)
        if self.exact.exists():
            cache.store = {k: (s, e) for k, s, e in json.loads(self.exact.get()[0])}
        if self.options["semantic"]:
            for seq, vector in self.index.get():
                cache._add(seq, np.asarray(vector, dtype=float))
        known = cache.size
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = []
        for r in batch.itertuples():
            vector = None if r.vector is None else np.asarray(r.vector, dtype=float)
            now = None if pd.isna(r.now) else float(r.now)
            out.append((key[0], int(r.seq), *cache.submit(int(r.seq), r.key, vector, float(r.threshold), now)))
        self.exact.update((json.dumps([(k, s, e) for k, (s, e) in cache.store.items()]),))
        for i in range(known, cache.size):
            self.index.appendValue((cache.seqs[i], cache.vectors[i].tolist()))
        yield pd.DataFrame(out, columns=["config", "seq", "source", "similarity", "matched_seq", "stored"]).astype({"matched_seq": "Int64", "similarity": "Float64"})

    def close(self) -> None:
        pass


def decide(requests: DataFrame, max_size: int | None = None, ttl: float | None = None, semantic: bool = True) -> DataFrame:
    """Decisions on a stream of ``requests(config, seq, prompt[, vector, threshold, now])``."""
    has = set(requests.columns)
    rows = requests.select(
        F.col("config").cast("string").alias("config"),
        F.col("seq").cast("long").alias("seq"),
        prompt_key(F.col("prompt")).alias("key"),
        (normalised(F.col("vector")) if "vector" in has else F.lit(None).cast("array<double>")).alias("vector"),
        (F.col("threshold").cast("double") if "threshold" in has else F.lit(1.0)).alias("threshold"),
        (F.col("now").cast("double") if "now" in has else F.lit(None).cast("double")).alias("now"),
    )
    return rows.groupBy("config").transformWithStateInPandas(CacheProcessor(max_size, ttl, semantic and "vector" in has), OUT, "append", "none")


def exact_hits(requests: DataFrame) -> DataFrame:
    """``requests(config, seq, prompt)`` with ``exact_hit``, state keyed by prompt so that it spreads over all tasks."""
    rows = requests.select(F.concat_ws("\x1f", F.col("config").cast("string"), prompt_key(F.col("prompt"))).alias("config"), F.col("seq").cast("long").alias("seq"), "prompt")
    out = rows.groupBy("config").transformWithStateInPandas(_FirstSeen(), "config string, seq long, exact_hit boolean", "append", "none")
    return out.select(F.substring_index("config", "\x1f", 1).alias("config"), "seq", "exact_hit")


class _FirstSeen(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "first long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        known = self.seen.exists()
        seqs = sorted(int(s) for b in rows for s in b["seq"])
        if not known:
            self.seen.update((seqs[0],))
        yield pd.DataFrame({"config": [key[0]] * len(seqs), "seq": seqs, "exact_hit": [known or i > 0 for i in range(len(seqs))]})

    def close(self) -> None:
        pass


def tail(spark, folder: str, schema: str, per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, so many new files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def run_to_end(stream: DataFrame, checkpoint: str, out: str) -> DataFrame:
    """Everything that is there now, decided and appended to Parquet at ``out``; the result read back."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)
