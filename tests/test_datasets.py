import json

import pytest
from pyspark.sql import functions as F

from quern.operators import annotation, sampling, validation
from quern.sources import corpora, datasets, sinks

PAIR = ("p-1", "faq", "corpus", "s-1", 'says "hi",\nthere', "second", 1, None, {"b": "2", "a": "1"}, 0)
OTHER = ("p-2", "chat", "corpus", "s-2", "é first", "other", 0, 1, {}, 1)


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame([PAIR, OTHER], datasets.SCHEMA)


def plain(df):
    return sorted((tuple({} if c == "metadata" and r[c] is None else r[c] for c in datasets.COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_export_and_load(spark, pairs, tmp_path, kind):
    sinks.export_dataset(pairs, str(tmp_path / "d.csv"), str(tmp_path / "d.json"))
    got = datasets.load(spark, str(tmp_path / f"d.{kind}"))
    assert plain(got) == plain(pairs)
    assert [r.pair_id for r in got.orderBy("seq").collect()] == ["p-1", "p-2"]


def test_csv_metadata_keys_are_in_order_and_nulls_empty(pairs, tmp_path):
    sinks.export_csv(pairs, str(tmp_path / "d.csv"))
    text = (tmp_path / "d.csv").read_bytes().decode()
    assert '"{""a"":""1"",""b"":""2""}"' in text and ",1,,\"" in text and text.endswith("\r\n")


def test_load_refuses(spark, tmp_path):
    (tmp_path / "a.csv").write_text("pair_id,workload\nx,faq\n")
    with pytest.raises(validation.DatasetError, match="source_corpus"):
        datasets.load(spark, str(tmp_path / "a.csv"))
    (tmp_path / "b.json").write_text(json.dumps({"pair_id": "x"}))
    with pytest.raises(validation.DatasetError, match="list"):
        datasets.load(spark, str(tmp_path / "b.json"))
    with pytest.raises(validation.DatasetError):
        datasets.load(spark, str(tmp_path / "c.txt"))
    header = ",".join(datasets.COLUMNS)
    (tmp_path / "d.csv").write_text(f"{header}\np,faq,c,s,q,r,1,,{{}}\np,mail,c,s,q,r,1,,{{}}\n")
    with pytest.raises(validation.DatasetError, match=":3: invalid workload"):
        datasets.load(spark, str(tmp_path / "d.csv"))


@pytest.mark.parametrize(
    ("change", "problem"),
    [({"pair_id": ""}, "pair_id"), ({"workload": "mail"}, "workload"), ({"source_corpus": None}, "source_corpus"), ({"query_1": " \t"}, "query_1"), ({"query_2": ""}, "query_2"), ({"original_label": 2}, "original_label"), ({"original_label": None}, "original_label"), ({"author_label": 7}, "author_label"), ({}, None)],
)
def test_problems(spark, pairs, change, problem):
    row = pairs.where("pair_id = 'p-1'")
    for k, v in change.items():
        row = row.withColumn(k, F.lit(v))
    assert [r.problem for r in validation.violations(row).collect()] == ([problem] if problem else [])


def test_corpora(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("id\tquestion1\tquestion2\tis_duplicate\n1\ta\tb\t1\n2\t\tb\t0\n3\tc\td\t0\n")
    got = corpora.question_pairs(spark, str(tmp_path / "q.tsv")).collect()
    assert [(r.source_pair_id, r.label) for r in got] == [("1", 1), ("3", 0)]
    (tmp_path / "s.csv").write_text("pair_id,question1,question2,is_duplicate\nx,\"a, b\",c,1\n")
    assert corpora.duplicate_questions(spark, str(tmp_path / "s.csv")).first().query_1 == "a, b"
    (tmp_path / "c.json").write_text(json.dumps([{"pair_id": "1", "utterance_1": "", "utterance_2": "b", "same_intent": 1}]))
    assert corpora.utterance_pairs(spark, str(tmp_path / "c.json")).count() == 1
    (tmp_path / "bad.csv").write_text("pair_id\nx\n")
    with pytest.raises(validation.DatasetError, match="question1"):
        corpora.duplicate_questions(spark, str(tmp_path / "bad.csv"))


def test_candidate_data_source(spark):
    spark.dataSource.register(corpora.CandidateSource)
    got = spark.read.format("candidates").options(workload="code", n="10", seed="3", partitions="3").load()
    again = spark.read.format("candidates").options(workload="code", n="10", seed="3").load()
    assert got.count() == 10 and sorted(got.collect()) == sorted(again.collect())


def test_sampling(spark):
    sources = {w: corpora.synthetic(spark, w, 40, seed=1) for w in sampling.WORKLOADS}
    got = sampling.sample_dataset(sources, n=10, seed=7, ratio=0.25)
    rows = got.orderBy("seq").collect()
    assert [r.pair_id for r in rows[:2]] == ["faq-0000", "faq-0001"] and len(rows) == 30
    for w in sampling.WORKLOADS:
        assert sum(r.original_label for r in rows if r.workload == w) == 2  # 2.5 rounds to even
    assert rows == sampling.sample_dataset(sources, n=10, seed=7, ratio=0.25).orderBy("seq").collect()
    assert rows != sampling.sample_dataset(sources, n=10, seed=8, ratio=0.25).orderBy("seq").collect()
    with pytest.raises(sampling.ShortfallError, match="label 1"):
        sampling.sample_dataset(sources, n=100)
    with pytest.raises(sampling.ShortfallError, match="no source for chat"):
        sampling.sample_dataset({k: v for k, v in sources.items() if k != "chat"})


def test_annotation(spark, pairs, tmp_path):
    sinks.save_progress(spark.createDataFrame([("p-1", 0), ("p-2", 0), ("gone", 1)], "pair_id string, label int"), str(tmp_path / "p.json"))
    progress = datasets.load_progress(spark, str(tmp_path / "p.json"))
    label = lambda df: {r.pair_id: r.author_label for r in df.collect()}
    assert label(annotation.merge_progress(pairs, progress)) == {"p-1": 0, "p-2": 1}
    assert label(annotation.merge_progress(pairs, progress, overwrite=True)) == {"p-1": 0, "p-2": 0}
    assert datasets.load_progress(spark, str(tmp_path / "none.json")).count() == 0
    assert annotation.blind_view(pairs).columns == ["pair_id", "query_1", "query_2"]
    assert annotation.remaining(pairs).first().remaining == 1
    answers = spark.createDataFrame([("p-1", 1, "?"), ("p-2", 2, "0"), ("p-1", 3, "Q"), ("p-1", 4, "1")], "pair_id string, position int, answer string")
    summary = annotation.session_summary(pairs, answers, overwrite=True).first()
    assert (summary.total_pairs, summary.already_labeled, summary.newly_labeled, summary.skipped, summary.quit_early) == (2, 1, 1, 1, True)
    assert label(annotation.apply_answers(pairs, answers)) == {"p-1": None, "p-2": 1}
    assert label(annotation.apply_answers(pairs, answers, overwrite=True)) == {"p-1": None, "p-2": 0}


def test_result_files_are_the_same_bytes_again(spark, small, tmp_path):
    from quern.operators import metrics
    from quern.plans.catalog import P, _sweep

    evaluated = metrics.evaluate(_sweep(spark, small, P.CALIBRATED))
    for name in ("a", "b"):
        sinks.write_results(evaluated, str(tmp_path / f"{name}.csv"), ["config_id"])
        sinks.write_decisions(_sweep(spark, small, P.CALIBRATED), str(tmp_path / f"{name}-d.csv"), ["config_id", "pair_id"])
    assert (tmp_path / "a.csv").read_bytes() == (tmp_path / "b.csv").read_bytes()
    assert (tmp_path / "a-d.csv").read_bytes() == (tmp_path / "b-d.csv").read_bytes()
    lines = (tmp_path / "a.csv").read_text().splitlines()
    assert lines[0] == ",".join(sinks.RESULT_COLUMNS) and len(lines) == 31 and "time" not in lines[0]


@pytest.mark.parametrize("bad", ["{not json", "[1, 2]", "7"])
def test_malformed_metadata_is_an_error_that_names_the_row(spark, tmp_path, bad):
    import csv
    import json

    rows = [[f"p{i}", "faq", "c", str(i), "a b", "c d", "1", "", m] for i, m in enumerate(["{}", "", '{"k": "v"}', bad])]
    path = tmp_path / "d.csv"
    with path.open("w", newline="") as f:
        csv.writer(f).writerows([datasets.COLUMNS, *rows])
    with pytest.raises(validation.DatasetError, match=r"d\.csv:5: invalid metadata"):
        datasets.load_csv(spark, str(path))
    good = tmp_path / "g.csv"
    with good.open("w", newline="") as f:
        csv.writer(f).writerows([datasets.COLUMNS, *rows[:3]])
    assert [r.metadata for r in datasets.load_csv(spark, str(good)).orderBy("seq").collect()] == [{}, {}, {"k": "v"}]
    as_json = tmp_path / "d.json"
    as_json.write_text(json.dumps([dict(zip(datasets.COLUMNS, r[:6] + [1, None, {"k": "v"} if i < 3 else 5], strict=True)) for i, r in enumerate(rows)]))
    with pytest.raises(validation.DatasetError, match=r"item\[3\]: invalid metadata"):
        datasets.load_json(spark, str(as_json))
