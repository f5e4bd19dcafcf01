"""Every query of the engine against DuckDB on the smallest tables, and what the package promises."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from quern.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def shown(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_agrees_with_sql(spark, small, duck, name):
    df = catalog.QUERIES[name](spark, small)
    got = sorted(tuple(shown(r[c]) for c in sorted(df.columns)) for r in df.collect())
    cur = duck.execute(catalog.SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in sorted(columns)]
    assert got == sorted(tuple(shown(r[i]) for i in order) for r in cur.fetchall())


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"lsh_candidates"}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 30


def test_core_works_without_the_optional_parts(tmp_path):
    root = Path(__file__).resolve().parent.parent
    code = (
        "import sys, importlib.util as u\n"
        "real = u.find_spec\n"
        "u.find_spec = lambda n, *a: None if n in ('quern.llm', 'corpus_pipeline') else real(n, *a)\n"
        f"sys.path.insert(0, {str(root)!r})\n"
        "import __spark_entry__ as e\n"
        "assert 'confusion_sweep' in e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())\n"
        "assert not any(m.startswith('quern.llm') for m in sys.modules)\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_core_works_where_an_optional_package_is_missing(tmp_path):
    root = Path(__file__).resolve().parent.parent
    code = (
        "import sys\n"
        "class Missing:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.partition('.')[0] in ('public_tokenizers', 'tokenizers', 'xxhash'):\n"
        "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
        "sys.meta_path.insert(0, Missing())\n"
        f"sys.path.insert(0, {str(root)!r})\n"
        "import __spark_entry__ as e\n"
        "assert 'confusion_sweep' in e.queries() and 'confusion_sweep' in e.oracle_sql() and 'pipeline' not in e.queries()\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_nothing_else_imports_the_optional_parts():
    root = Path(__file__).resolve().parent.parent
    for path in (root / "quern").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "quern.llm" not in path.read_text(), path
