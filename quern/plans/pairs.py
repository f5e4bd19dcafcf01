"""Query pairs and their requests derived from the shared test tables.

The tables hold no query pairs, so neighbouring vectors stand for them: an
even vec_id and the odd one after it. Two "models" are the whole vector and
its first half.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.columns import config_id, normalised

MODELS = ("m64", "m32")
CALIBRATED = (0.45, 0.46, 0.47, 0.48, 0.49)
FROZEN = (0.7, 0.75, 0.8, 0.85, 0.9)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, thresholds: tuple[float, ...]) -> DataFrame:
    rows = [(m, w, t) for m in MODELS for w in ("faq", "code", "chat") for t in thresholds]
    return spark.createDataFrame(rows, "model string, workload string, threshold double").withColumn("config_id", config_id(F.col("model"), F.col("workload"), F.col("threshold")))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pair_no, pair_id, workload, original_label, author_label`` and the two rows' ids and vectors."""
    e = read(spark, sf_dir, "embeddings").select(F.expr("vec_id div 2").alias("pair_no"), (F.col("vec_id") % 2).alias("side"), "vec_id", "embedding", "label")
    row = F.struct("vec_id", "embedding", "label")
    both = e.groupBy("pair_no").agg(F.max(F.when(F.col("side") == 0, row)).alias("a"), F.max(F.when(F.col("side") == 1, row)).alias("b")).where("a is not null and b is not null")
    same = (F.col("a.label") == F.col("b.label")).cast("int")
    workload = F.element_at(F.array(*[F.lit(w) for w in ("faq", "code", "chat")]), (F.col("pair_no") % 3 + 1).cast("int"))
    author = F.when(F.col("pair_no") % 5 == 0, None).when(F.col("pair_no") % 7 == 0, 1 - same).otherwise(same)
    return both.select("pair_no", F.format_string("%s-%06d", workload, "pair_no").alias("pair_id"), workload.alias("workload"), same.alias("original_label"), author.cast("int").alias("author_label"), "a", "b")


def by_model(pairs: DataFrame) -> DataFrame:
    """Pairs as the sweep takes them, once a model, labels resolved to the author's where there is one."""
    out = None
    for model, width in (("m64", 64), ("m32", 32)):
        v = lambda side, width=width: normalised(F.slice(F.col(f"{side}.embedding"), 1, width))
        one = pairs.select(
            F.lit(model).alias("model"), "workload", "pair_id", F.col("pair_no").alias("seq"), F.col("a.vec_id").cast("string").alias("key_1"), F.col("b.vec_id").cast("string").alias("key_2"),
            v("a").alias("vector_1"), v("b").alias("vector_2"), F.coalesce("author_label", "original_label").alias("label"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def dataset(pairs: DataFrame) -> DataFrame:
    """The pairs in a dataset's columns, with text that leads back to the rows."""
    return pairs.select(
        "pair_id", "workload", F.lit("vectors").alias("source_corpus"), F.col("pair_no").cast("string").alias("source_pair_id"),
        F.concat(F.lit('says "'), F.col("a.vec_id").cast("string"), F.lit('", twice\nover')).alias("query_1"), F.concat(F.lit("vector, "), F.col("b.vec_id").cast("string")).alias("query_2"),
        "original_label", "author_label", F.create_map(F.lit("label"), F.col("a.label").cast("string"), F.lit("other"), F.col("b.label").cast("string")).alias("metadata"), F.col("pair_no").alias("seq"),
    )
