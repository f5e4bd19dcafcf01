"""Embeddings that outlast a run: a table a model, bucketed by the text's hash.

A run embeds only texts whose hash the table does not have, adds them and joins
its rows with the whole. Both joins find the table dealt by hash already, so what
has been kept is read and never shuffled. A table is a folder, so another
session opens it by name, and a model's vectors are evicted by removing it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.shared import _path, durable, exists

BUCKETS = 64


class Memo:
    """The memo in ``folder``, a shared one. ``buckets`` is fixed when a model's table is made."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _name(self, model: str) -> str:
        return "quern_memo_" + hashlib.sha256(f"{self.folder}\n{model}\n{self.buckets}".encode()).hexdigest()[:24]

    def _where(self, model: str) -> str:
        return f"{self.folder}/{hashlib.sha256(model.encode()).hexdigest()[:24]}-{self.buckets}"

    def _table(self, model: str) -> str:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self._name(model)} (text_hash STRING, embedding ARRAY<DOUBLE>) USING parquet "
            f"CLUSTERED BY (text_hash) SORTED BY (text_hash) INTO {self.buckets} BUCKETS LOCATION '{self._where(model)}'"
        )
        return self._name(model)

    def known(self, model: str) -> DataFrame:
        """``(text_hash, embedding)`` of a model; what two runs added at once counts once."""
        name = self._table(model)
        self.spark.catalog.refreshTable(name)  # another session may have added to it
        return self.spark.table(name).dropDuplicates(["text_hash"])

    def size(self, model: str) -> int:
        return self.known(model).count()

    def evict(self, model: str) -> None:
        """Forgets a model's vectors; unknown models do nothing."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(model)}")
        if exists(self.spark, self._where(model)):
            path, files = _path(self.spark, self._where(model))
            files.delete(path, True)

    def embed(self, texts: DataFrame, embedder: Callable[[list[str]], list[list[float]]], model: str, text: str = "text", prefix: str = "") -> DataFrame:
        """As ``embedding.embed``: rows with ``model``, ``text_hash`` and ``embedding``; only texts that are not known are embedded.

        A null text has no embedding and is not kept. A run that fails before
        its vectors are added adds none of them.
        """
        full = F.concat(F.lit(prefix), F.col(text))
        hashed = texts.withColumn("model", F.lit(model)).withColumn("text_hash", F.sha2(full, 256))
        asked = hashed.where("text_hash is not null").groupBy("text_hash").agg(F.first(full).alias("t"))
        missing = asked.join(self.known(model).select("text_hash"), "text_hash", "left_anti")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"text_hash": b["text_hash"], "embedding": embedder(b["t"].tolist())})

        new = durable(missing.mapInPandas(run, "text_hash string, embedding array<double>"))
        if not new.isEmpty():
            # Dealt as the table is, so each bucket gets one file.
            new.repartition(self.buckets, "text_hash").write.insertInto(self._table(model))
        return hashed.join(self.known(model), "text_hash", "left").select(*texts.columns, "model", "text_hash", "embedding")
