import pytest
from pyspark.sql import functions as F

from quern.operators import lookup, replay
from quern.streaming import online


@pytest.fixture
def folder(spark, small, tmp_path):
    """The first vectors as three files of requests."""
    e = spark.read.parquet(f"{small}/embeddings.parquet").where("vec_id < 120")
    rows = e.select((F.col("label") % 3).cast("string").alias("config"), F.col("vec_id").alias("seq"), (F.col("vec_id") % 17).cast("string").alias("prompt"), F.col("embedding").cast("array<double>").alias("vector"), F.lit(0.47).alias("threshold"))
    for k in range(3):
        rows.where((F.col("seq") >= 40 * k) & (F.col("seq") < 40 * (k + 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return tmp_path, rows


def test_stream_decides_as_the_batch_does(spark, folder):
    tmp, rows = folder
    stream = online.tail(spark, str(tmp / "in"), rows.schema.simpleString()[7:-1].replace(":", " ").replace("array<double", "array<double"))
    got = online.run_to_end(online.decide(stream, max_size=6), str(tmp / "c"), str(tmp / "out"))
    key = lambda df: sorted((r.config, r.seq, r.source, r.matched_seq, r.stored) for r in df.collect())
    assert key(got) == key(replay.replay(rows, max_size=6))


def test_exact_stream_spreads_by_prompt(spark, folder):
    tmp, rows = folder
    stream = online.tail(spark, str(tmp / "in"), rows.schema.simpleString()[7:-1].replace(":", " "))
    got = online.run_to_end(online.exact_hits(stream), str(tmp / "c"), str(tmp / "out"))
    want = lookup.exact_replay(rows, by=("config",))
    key = lambda df: sorted((r.config, r.seq, r.exact_hit) for r in df.collect())
    assert key(got) == key(want)
