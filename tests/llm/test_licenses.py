import re

from quern.llm import licenses

CASES = [
    (1, "MIT License mit license; GNU General Public License, version 3 or later"),
    (2, "Licensed under the Apache License, Version 2.0."),
    (3, "CC BY-SA 4.0 and cc-by"),
    (4, "SPDX-License-Identifier: GPL-2.0-only"),
    (5, "Permission is hereby granted, free of charge, to any person obtaining a copy of it"),
    (6, "mit\nlicense"),
    (7, "the mitlicense, apachelicense and mit, license"),
    (8, None),
    (9, "ΜIT LICENSE"),  # a Greek letter
    (10, "mit license " * 3000),
    (11, "SPDX-License-Identifier: Apache-2.0 OR MIT"),
    (12, "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 AND BSD-3-Clause. Then text or mit."),
    (13, "Chelsea won the EPL 2-0; AFL 3.0 and BSL 1.0 were on, mit Apache 2 0 Leuten."),
    (14, "Redistributions of source code must retain the above copyright notice, this list of conditions"),
    (15, "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"),
    (16, "It is licensed under the EPL 2.0, the rest released under Apache 2.0 and LGPLv2.1"),
    (17, "Neither the name of the University nor the names of its contributors may be used"),
    (18, "the gnu lesser general public licence version 2.1 or any later version, gnu general public license v2"),
    (19, "2-clause BSD license, new BSD licence, BSD style license, the Unlicense"),
    (20, "epl"),
    (21, "license"),
    (22, "creative commons attribution-share alike 3.0 unported; https://creativecommons.org/licenses/by-nc/4.0/"),
]


#: Compiled here, as there are more of them than the module keeps.
COMPILED = [(re.compile(r.pattern), re.compile(r.before), r) for r in licenses.RULES]


def in_expression(w, i):
    """Whether word i follows an SPDX tag with nothing but an expression's words between them, however many."""
    while i > 0 and (w[i - 1] in licenses.EXPRESSION or w[i - 1].isdigit()):
        i -= 1
        if w[max(0, i - 3) : i] == ["spdx", "license", "identifier"]:
            return True
    return False


def scanned(text):
    """Every rule at every word, without gates or keys; then the best of a start, then what lies within better ones."""
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    best = {}
    for i in range(len(w)):
        window, before = " ".join(w[i : i + licenses.WINDOW]), " ".join(w[max(0, i - licenses.CONTEXT) : i])
        part = i > 0 and w[i - 1] in ("or", "and", "with") and in_expression(w, i)
        for pattern, needed, r in COMPILED:
            m = pattern.match(window)
            if m and (not r.before or (part if r.before == licenses.PART else needed.search(before))):
                best[i] = max(best.get(i, (0, 0, "")), (r.priority, m[0].count(" ") + 1, r.label))
    found = [(i, *x) for i, x in sorted(best.items())]

    def inside(a, b):
        return a[0] >= b[0] and a[0] + a[2] <= b[0] + b[2]

    return [x for x in found if not any((inside(x, y) or inside(y, x)) and y[1:] > x[1:] for y in found)]


def base(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), sorted(labels)


def test_base_is_that_of_plain_code(spark, docs, dirty):
    rows = docs.select("doc_id", "text").unionByName(dirty.select("doc_id", "text")).unionByName(spark.createDataFrame(CASES, "doc_id long, text string"))
    got = sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, sorted(r.base))) for r in licenses.scan_licenses(rows).collect())
    assert got == sorted(str((r.doc_id, *base(r.text))) for r in rows.collect())


def labels_of(spark):
    rows = licenses.scan_licenses(spark.createDataFrame(CASES, "doc_id long, text string")).collect()
    return {r.doc_id: [(d.label, d.start, d.n) for d in r.detections] for r in rows}


def test_rules_resolve_overlaps(spark):
    got = labels_of(spark)
    names = {i: [x[0] for x in d] for i, d in got.items()}
    assert got[1][-1] == ("gpl-3", 4, 8)
    assert names[2] == ["apache-2.0"]  # the name within it is suppressed
    assert ("cc-by-sa-4.0", 0, 5) in got[3]
    assert got[4] == [("gpl-2", 0, 7)]
    assert names[5] == names[15] == ["mit"] and names[14] == ["bsd"] and names[17] == ["bsd-3-clause"]
    assert got[8] == [] and names[13] == [] and names[20] == names[21] == []
    assert names[11] == ["apache-2.0", "mit"]
    assert names[12] == ["gpl-2", "classpath-exception", "bsd-3-clause"]
    assert names[16] == ["epl-2.0", "apache-2.0", "lgpl-2.1"]
    assert names[18] == ["lgpl-2.1", "gpl-2"]
    assert names[19] == ["bsd-2-clause", "bsd-3-clause", "bsd", "unlicense"]
    assert names[22] == ["cc-by-sa-3.0", "cc-by-nc-4.0"]


def _made_up(n):
    """Texts of the rules' own words, whole and broken."""
    import random

    rng = random.Random(4)
    words = sorted({w for r in licenses.RULES for w in re.findall(r"[a-z0-9]{2,}|[0-9]", r.pattern)})
    told = [t for _, _, t in licenses._WORDED] + [name.split("|")[0] for _, name, *_ in licenses._NAMED] + ["spdx license identifier", "licensed under the", "2 0", "or later", "v3"]
    plain = [re.sub(r"[\[\]|]|<\d+>", " ", t) for t in told]
    return [(i, " ".join(rng.choice(plain) if rng.random() < 0.5 else " ".join(rng.sample(words, 3)) for _ in range(rng.randint(1, 12)))) for i in range(n)]


def test_every_detection_is_that_of_all_rules_at_all_words(spark, docs):
    some = spark.createDataFrame([(100_000 + i, t) for i, t in _made_up(120)] + [(-i, t) for i, t in CASES if i != 10], "doc_id long, text string")
    short = docs.where("length(text) < 600 or text rlike '(?i)licen[cs]e'").where("length(text) < 4000").select("doc_id", "text")
    rows = short.unionByName(some)
    got = {(r.doc_id, r.n_words): [tuple(d) for d in r.detections] for r in licenses.scan_licenses(rows).collect()}
    source = {r.doc_id: r.text for r in rows.collect()}
    wrong = {k[0]: (d, scanned(source[k[0]])) for k, d in got.items() if d != scanned(source[k[0]])}
    assert wrong == {} and sum(map(len, got.values())) > 100


def test_few_texts_pass_the_gate(spark):
    from pyspark.sql import functions as F

    t = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bare = F.concat(F.lit(" "), F.regexp_replace(F.lower("text"), licenses.NOT_WORD, " "), F.lit(" "))
    n, passed = t.agg(F.count("*"), F.sum(F.rlike(bare, F.lit(f" (?:{'|'.join(licenses.KEYWORDS)}) ")).cast("int"))).first()
    assert passed < 0.15 * n


def test_empty_table_and_clashing_columns(spark, dirty, nothing):
    assert licenses.scan_licenses(nothing).count() == 0
    assert licenses.scan_licenses(dirty).count() == dirty.count()


def test_query_columns(spark, sf001):
    df = licenses.query(spark, sf001)
    assert [c for c in df.columns][:8] == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    rows = df.collect()
    assert all(0 <= r.score <= 1 for r in rows) and all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_there_are_hundreds_of_rules():
    assert len(licenses.RULES) > 300
    assert len({(r.pattern, r.before) for r in licenses.RULES}) > 300


def test_expressions_of_any_length(spark):
    names = ["EPL-2.0", "ISC", "Zlib", "AFL-3.0", "MIT", "Apache-2.0", "MPL-2.0", "BSL-1.0"]
    long = "x y\nSPDX-License-Identifier: " + " OR ".join((names * 5)[:40]) + "\nthen more words or mit rules"
    twice = "SPDX-License-Identifier: MIT AND ISC\nplain or zlib words SPDX-License-Identifier: Zlib WITH Classpath-exception-2.0"
    huge = "SPDX-License-Identifier: " + "MIT OR " * 20_000 + "ISC"
    rows = [(1, long), (2, twice), (3, "spdx license identifier"), (4, "or mit"), (5, huge)]
    got = {r.doc_id: r.detections for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows[:4]:
        assert [(d.start, d.priority, d.n, d.label) for d in got[i]] == scanned(text), i
    assert len([d for d in got[1] if d.priority >= 94]) == 40 and {d.label for d in got[1]} >= {"epl-2.0", "isc", "zlib", "afl-3.0"}
    assert len(got[5]) == 20_001 and {d.label for d in got[5]} == {"mit", "isc"}
