"""Cache entries as files: a snapshot that a later run starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.columns import expired

ENTRY = "key string, prompt string, response_text string, embedding array<double>, created_at double, access_count int, expires_at double, metadata map<string,string>"


def save(entries: DataFrame, path: str) -> None:
    """Entries as JSON lines."""
    entries.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def load(spark: SparkSession, path: str, now: Column | None = None) -> DataFrame:
    """The entries of a snapshot; lines that are no entry are left out, and with ``now`` expired ones too."""
    rows = spark.read.text(path).select(F.from_json("value", ENTRY).alias("e")).select("e.*").where("key is not null")
    return rows if now is None else rows.where(~expired(now, F.col("expires_at")))


def entries(decided: DataFrame, ttl: float | None = None) -> DataFrame:
    """What replayed requests leave in the store: an entry for each that was stored, the latest of a key.

    ``decided``: key, prompt, answer, seq, stored, matched_seq, now and the
    model's name; the hits of an entry are its access count.
    """
    hits = decided.where("matched_seq is not null").groupBy(F.col("matched_seq").alias("seq")).agg(F.count("*").cast("int").alias("access_count"))
    kept = decided.where("stored").select("key", "prompt", F.col("answer").alias("response_text"), "embedding", "seq", "now", "canonical_name").join(hits, "seq", "left")
    row = F.struct(
        "prompt", "response_text", "embedding", F.col("now").alias("created_at"), F.coalesce("access_count", F.lit(0)).alias("access_count"),
        (F.lit(None).cast("double") if ttl is None else F.col("now") + ttl).alias("expires_at"), F.create_map(F.lit("canonical_name"), "canonical_name").alias("metadata"),
    )
    return kept.groupBy("key").agg(F.max_by(row, "seq").alias("e")).select("key", "e.*")
