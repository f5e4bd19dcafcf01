import __spark_entry__
import corpus_pipeline
from quern.llm import bpe, mixing, quality, registry, simhash, spans


def test_stages_one_after_the_other_are_the_run(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf001).cache()
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf001)
    want = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in last.collect())
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf001).collect())
    assert got == want


def test_stages_on_trouble_and_on_nothing(spark, dirty, nothing, sf001):
    for df in (dirty, nothing):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, df, sf001).collect()


def test_stage_functions_are_the_operators():
    assert [f for _, f in corpus_pipeline.STAGES] == [quality.keep_good, simhash.keep_one, spans.drop_spans, mixing.mix_stage, bpe.encode_stage]


def test_thirteen_queries_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    assert set(registry.QUERIES) | {"pipeline"} <= set(names)
