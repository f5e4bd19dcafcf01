"""Exact-match cache operations as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.columns import expired, prompt_key


def exact_replay(requests: DataFrame, seq: str = "seq", prompt: str = "prompt", by: tuple[str, ...] = ()) -> DataFrame:
    """Each request with ``key``, ``first_seq`` and ``exact_hit``: whether an earlier one had its prompt.

    The first request of a key is a map-side combined minimum that is joined
    back, so a prompt that is most of the traffic is not one window. The join
    has a key of its own: below an aggregation by the same key Spark could not
    split it.
    """
    keyed = requests.withColumn("key", prompt_key(F.col(prompt)))
    join_key = F.concat(F.lit("k"), F.col("key")).alias("_k")
    first = keyed.groupBy(*by, "key").agg(F.min(seq).alias("first_seq")).select(*by, join_key, "first_seq")
    return keyed.select("*", join_key).join(first, [*by, "_k"]).drop("_k").withColumn("exact_hit", F.col(seq) > F.col("first_seq"))


def upsert(store: DataFrame, updates: DataFrame, order: str = "created_at") -> DataFrame:
    """The latest entry of each key; of equal times that of ``updates``."""
    columns = store.columns
    ranked = store.withColumn("_new", F.lit(0)).unionByName(updates.select(*columns).withColumn("_new", F.lit(1)))
    latest = ranked.groupBy("key").agg(F.max_by(F.struct(*columns), F.struct(order, "_new")).alias("e"))
    return latest.select("e.*")


def delete(store: DataFrame, keys: DataFrame) -> DataFrame:
    """The store without ``keys(key)``; unknown keys do nothing."""
    return store.join(keys.select("key"), "key", "left_anti")


def lookup(requests: DataFrame, store: DataFrame, now: Column, prompt: str = "prompt") -> DataFrame:
    """Requests with the entry of their key; an expired entry is a miss."""
    entries = store.select(F.col("key"), F.col("response_text"), F.col("expires_at"))
    keyed = requests.withColumn("key", prompt_key(F.col(prompt))).join(entries, "key", "left")
    live = F.col("response_text").isNotNull() & ~expired(now, F.col("expires_at"))
    return keyed.withColumn("exact_hit", live).withColumn("response_text", F.when(live, F.col("response_text"))).drop("expires_at")


def purge(store: DataFrame, now: Column) -> DataFrame:
    return store.where(~expired(now, F.col("expires_at")))


def embedded(store: DataFrame) -> DataFrame:
    """Entries that have an embedding."""
    return store.where("embedding is not null")
