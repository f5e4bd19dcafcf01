"""Embeddings that outlast a run; every text that is embedded is counted."""

import glob
import os

from pyspark.sql import functions as F

from quern.config import Settings
from quern.engine import Engine
from quern.operators import embedding, memo


def counting(folder):
    def embed(texts):
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        for t in texts:
            open(f"{folder}/{uuid.uuid4().hex}", "w").write(t)
        return [[float(len(t)), 1.0] for t in texts]

    return embed


def embedded(folder):
    return sorted(open(p).read() for p in glob.glob(f"{folder}/*"))


def test_only_new_texts_are_embedded_and_a_model_can_be_evicted(spark, tmp_path):
    kept, calls = memo.Memo(spark, str(tmp_path / "memo"), buckets=4), str(tmp_path / "calls")
    rows = [(1, "a"), (2, "a"), (3, "bb"), (4, None)]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("t", F.lit("given"))
    want = sorted(map(str, embedding.embed(df, counting(str(tmp_path / "plain")), "m", prefix="p:").select("id", "text", "t", "model", "text_hash", "embedding").collect()))
    first = kept.embed(df, counting(calls), "m", prefix="p:")
    assert sorted(map(str, first.select("id", "text", "t", "model", "text_hash", "embedding").collect())) == want
    assert embedded(calls) == ["p:a", "p:bb"] and kept.size("m") == 2
    kept.embed(df, counting(calls), "m", prefix="p:").collect()
    assert embedded(calls) == ["p:a", "p:bb"]
    again = memo.Memo(spark.newSession(), str(tmp_path / "memo"), buckets=4)  # another session finds it
    more = df.unionByName(spark.createDataFrame([(5, "ccc")], "id int, text string").withColumn("t", F.lit("given")))
    assert {r.id: r.embedding for r in again.embed(more, counting(calls), "m", prefix="p:").collect()}[5] == [5.0, 1.0]
    assert embedded(calls) == ["p:a", "p:bb", "p:ccc"]
    again.embed(df, counting(calls), "other", prefix="p:").collect()
    assert len(embedded(calls)) == 5
    kept.evict("m")
    kept.evict("never")
    assert kept.size("m") == 0 and kept.size("other") == 2
    kept.embed(df, counting(calls), "m", prefix="p:").collect()
    assert len(embedded(calls)) == 7


def test_the_table_is_joined_without_being_dealt_again(spark, tmp_path):
    kept = memo.Memo(spark, str(tmp_path / "memo"), buckets=4)
    df = spark.range(50).select(F.col("id").cast("string").alias("text"))
    got = kept.embed(df, embedding.mock_embedder(4), "m")
    assert got.where("embedding is null").count() == 0
    assert kept.embed(df.limit(0), embedding.mock_embedder(4), "m").count() == 0
    plan = kept.known("m")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan


def test_the_engine_embeds_a_prompt_once_in_all_runs(spark, tmp_path):
    calls = str(tmp_path / "calls")
    df = spark.createDataFrame([(i, f"r{i}", p) for i, p in enumerate(["a", "b", "a"])], "seq long, request_id string, prompt string")
    for _ in range(2):
        engine = Engine(Settings(memo_folder=str(tmp_path / "memo")), counting(calls))
        assert engine.serve(df).where("source is not null").count() == 3
    assert embedded(calls) == ["a", "b"] and os.path.exists(tmp_path / "memo")
