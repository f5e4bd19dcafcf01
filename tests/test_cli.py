import csv
import json

import pytest

from quern import cli
from quern.operators.embedding import mock_vector

WORDS = {"faq": 3, "code": 1, "chat": 2}


@pytest.fixture
def dataset(spark, tmp_path):
    args = ["sample", "--n", "6", "--out-csv", str(tmp_path / "d.csv"), "--out-json", str(tmp_path / "d.json")]
    assert cli.main(args, spark) == 0
    return tmp_path


def test_sample_then_kappa_and_export(spark, dataset, capsys):
    rows = list(csv.DictReader((dataset / "d.csv").open()))
    assert len(rows) == 18 and sum(int(r["original_label"]) for r in rows) == 9
    assert cli.main(["kappa", "--dataset", str(dataset / "d.json"), "--strict", "--out-json", str(dataset / "k.json")], spark) == 0
    assert "overall: kappa none" in capsys.readouterr().out
    assert json.loads((dataset / "k.json").read_text())["overall"]["n_excluded"] == 18
    assert cli.main(["export", "--dataset", str(dataset / "d.json"), "--out-csv", str(dataset / "e.csv"), "--out-json", str(dataset / "e.json")], spark) == 0
    assert (dataset / "e.csv").read_bytes() == (dataset / "d.csv").read_bytes()


def test_annotate_is_blind_and_resumes(spark, dataset):
    shown = []

    def ask(answers):
        it = iter(answers)

        def one(text):
            shown.append(text)
            return next(it)

        return one

    args = cli.parser().parse_args(["annotate", "--dataset", str(dataset / "d.csv"), "--progress", str(dataset / "p.json"), "--out-csv", str(dataset / "a.csv"), "--out-json", str(dataset / "a.json")])
    cli.annotate(spark, args, ask(["1", "s", "q"]))
    assert len(json.loads((dataset / "p.json").read_text())) == 1
    assert not any("label" in s for s in shown)
    cli.annotate(spark, args, ask(["0"] * 17))
    assert len(json.loads((dataset / "p.json").read_text())) == 18
    assert {r["author_label"] for r in csv.DictReader((dataset / "a.csv").open())} == {"0", "1"}


def test_experiments(spark, dataset, tmp_path):
    run = lambda out, *more: cli.main(["experiments", "--dataset", str(dataset / "d.csv"), "--out-dir", str(out), "--dimension", "16", *more], spark)
    assert run(tmp_path / "x") == 0 and run(tmp_path / "y") == 0
    for name in ("results.csv", "decisions.csv"):
        assert (tmp_path / "x" / name).read_bytes() == (tmp_path / "y" / name).read_bytes()
    rows = list(csv.DictReader((tmp_path / "x/results.csv").open()))
    assert len(rows) == 30 and all(r["n"] == "6" for r in rows) and rows[0]["config_id"] == "all-MiniLM-L6-v2|faq|0.70"
    assert json.loads((tmp_path / "x/run_meta.json").read_text())["n_configurations"] == 30
    assert run(tmp_path / "z", "--models", "none") == 1


def test_mock_vectors_differ_by_text():
    assert mock_vector("a", 4) != mock_vector("b", 4)
