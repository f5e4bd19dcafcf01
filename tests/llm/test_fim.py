import hashlib
import random
import re
import tracemalloc

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.llm import fim


def by_list(text, doc_id, pattern=fim.LINES, marks=fim.MARKS, rate=100, spm=50, seed=7):
    """(n, form, prefix, middle, suffix) with all units in a list."""
    units = [m.group() for m in re.finditer(pattern, text)]
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return n, "plain", "", "", text
    return n, "spm" if h[3] % 100 < spm else "psm", "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])


def joined(form, prefix, middle, suffix, marks=fim.MARKS):
    p, s, m = marks
    return suffix if form == "plain" else p + prefix + s + suffix + m + middle if form == "psm" else s + suffix + p + prefix + m + middle


def test_cuts_as_a_list_of_units_would():
    rng = random.Random(3)
    unit = re.compile(fim.LINES)
    for i in range(3000):
        text = "".join(rng.choice("ab\n\n<P>é\U0001f600\r") for _ in range(rng.randrange(40)))
        n, form, a, b = fim.cut(text, i, unit)
        want = by_list(text, i)
        assert (n, form) == want[:2]
        if form != "plain":
            assert (text[:a], text[a:b], text[b:]) == want[2:]
        assert fim.arrange(text, form, a, b) == joined(*want[1:])


def test_a_long_text_needs_no_more_room_than_a_short_one():
    unit = re.compile(fim.LINES)
    text = "line\n" * 400_000
    tracemalloc.start()
    fim.cut(text, 5, unit)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("aa", "b", "c"), ("xab", "by", "c"), ("", "b", "c")])
def test_marks_that_could_overlap_are_refused(marks):
    with pytest.raises(ValueError, match="marks"):
        fim.check_marks(marks)


def test_every_kind_of_row(spark, dirty, nothing):
    got = fim.transform(dirty).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = sorted((r.doc_id or -1, *by_list(r.text or "", r.doc_id)) for r in dirty.collect())
    assert sorted((r.doc_id or -1, r.n, r.form, r.output, r.back) for r in got) == sorted((d, n, form, joined(form, p, m, s), p + m + s) for d, n, form, p, m, s in want)
    assert all((r.prefix_chars is None) == (r.form == "plain") for r in got)
    assert fim.transform(nothing).count() == 0


def test_other_units_marks_and_rates(spark):
    rows = [(i, f"one two  three {i} four\nfive " * (i % 5)) for i in range(200)] + [(500, "a <P> b"), (501, "a | b")]
    df = spark.createDataFrame(rows, "id long, body string")
    marks = ("|", "@", "§§"[:1])
    got = {r.doc_id: r for r in fim.transform(df, r"\s*\S+", marks, rate=60, spm=20, seed=3, id_col="id", text_col="body").withColumn("back", fim.restored(F.col("output"), F.col("form"), marks)).collect()}
    for i, text in rows:
        units, form, p, m, s = by_list(text, i, r"\s*\S+", marks, 60, 20, 3)
        if form != "plain":  # what no unit covers, here a last blank, is the suffix's
            s = text[len(p + m) :]
        assert (got[i].n, got[i].form, got[i].output, got[i].back) == (units, form, joined(form, p, m, s, marks), text)
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"} and got[501].form == "plain"
    assert {r.form for r in fim.transform(df, rate=0, id_col="id", text_col="body").collect()} == {"plain"}


def test_agrees_with_sql(spark, sf001):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf001}/documents.parquet'")
    df = fim.query(spark, sf001)
    cur = con.execute(f"SELECT {', '.join(df.columns)} FROM ({fim.SQL})")
    assert sorted(map(tuple, df.collect())) == sorted(cur.fetchall())
    assert {r.form for r in df.collect()} >= {"psm", "spm"}
