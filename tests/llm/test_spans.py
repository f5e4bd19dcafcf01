import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import spans

CUTTER = spans._cutter()


def plain_cut(text):
    """Sentences by a cutter of its own, which walks through the text character by character."""
    import zlib

    def split(t, marks, after, line):
        out, at, i = [], 0, 0
        while i < len(t):
            k = i + 1
            if t[i] in marks:
                if k < len(t) and t[k] in after and (k + 1 < len(t) and t[k + 1].isspace()):
                    k += 1
                if k >= len(t) or not t[k].isspace():
                    i += 1
                    continue
            elif not (line and t[i] == "\n"):
                i += 1
                continue
            end = i if t[i] == "\n" else k
            while k < len(t) and t[k].isspace():
                k += 1
            out.append(t[at:end])
            at = i = k
        return [*out, t[at:]]

    pieces = []
    for sentence in split(text, ".!?…", "\"'”’»)]", True):
        if len(sentence.split()) <= spans.LONG_SENTENCE:
            pieces.append(sentence)
            continue
        for clause in split(sentence, ",;:", "", False):
            if len(clause.split()) <= spans.LONG_SENTENCE:
                pieces.append(clause)
                continue
            part = []
            for n, w in enumerate(clause.split()):
                if n and zlib.crc32(w.lower().encode()) % spans.ONE_IN == 0:
                    pieces.append(" ".join(part))
                    part = []
                part.append(w)
            pieces.append(" ".join(part))
    return pieces


def brute(rows, least=spans.MIN_WORDS):
    """Removed sentences by row, by comparing runs as text."""
    found, first, gone = [], {}, {}
    for n, (doc_id, text) in enumerate(rows):
        words = [s.lower().split() for s in plain_cut(text or "")]
        for a, b in spans.runs(np.array([len(w) for w in words]), least):
            run = " ".join(x for w in words[a:b] for x in w)
            found.append((run, doc_id, n, a, b))
            first[run] = min(first.get(run, (doc_id, n, a)), (doc_id, n, a))
    for run, doc_id, n, a, b in found:
        if doc_id != first[run][0] or (first[run][1] == n and a != first[run][2]):
            gone.setdefault(n, set()).update(range(a, b))
    return gone


def test_runs_are_shortest_and_reach_both_ends():
    assert spans.runs(np.array([10, 10, 10, 10]), 25) == [(0, 3), (1, 4)]
    assert spans.runs(np.array([30, 5, 24]), 25) == [(0, 1), (0, 2), (1, 3)]
    assert spans.runs(np.array([3]), 25) == []
    assert spans.runs(np.array([0, 30, 0, 5, 24, 0]), 25) == [(1, 2), (1, 4), (3, 5)]
    with pytest.raises(IndexError):
        spans.runs(np.array([3]), 25)[0]


def test_stretches_join_what_meets_within_a_text_only():
    run = lambda a, b: a << 32 | b
    place, key = np.array([1, 1, 1, 2, 1]), np.array([5, 5, 5, 5, 6])
    got = spans._stretches(place, key, np.array([run(0, 9), run(2, 4), run(9, 11), run(10, 12), run(12, 13)]))
    rows = sorted(zip(got[2].tolist(), got[3].tolist(), [(r >> 32, r & 0xFFFFFFFF) for r in got[4].tolist()], strict=True))
    assert rows == [(1, 5, (0, 11)), (1, 6, (12, 13)), (2, 5, (10, 12))]
    assert len(spans._stretches(place[:0], key[:0], key[:0])[0]) == 0


def test_cut_is_lossless():
    for text in ("", "one, two, three, four, five, six, seven, eight, nine, ten, eleven, twelve, thirteen. x", "a. b", "One. Two!  Three\n\nfour Five", " x ", "\n\n", "a.\n", "他说。我们走！好 吧。", "word " * 60, "a b  c\td " * 9):
        s, g = spans.cut(text, CUTTER)
        assert "".join(a + b for a, b in zip(s, g, strict=True)) == text


@pytest.mark.parametrize("block", [spans.BLOCK_RUNS, 200])
def test_result_is_that_of_plain_code(spark, docs, block, monkeypatch):
    monkeypatch.setattr(spans.spans, "__defaults__", (*spans.spans.__defaults__[:-1], block))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r["__removed"] for r in spans.dedup(docs).collect()}
    want = brute(sorted(rows))
    want = {sorted(rows)[n][0]: len(s) for n, s in want.items()}
    assert {k: v for k, v in got.items() if v} == want and len(got) == len(rows)


def passage(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))


def test_a_passage_put_into_other_texts_goes_from_all_but_the_first(spark):
    rng = np.random.default_rng(4)
    shared = ". ".join(passage(rng, 9).capitalize() for _ in range(7)) + "."
    one = passage(rng, 60).capitalize() + "."
    rows = [(i, f"{passage(rng, 40)} {shared if i % 2 else one} {passage(rng, 40)}") for i in range(8)]
    got = {r.doc_id: r["__text"] for r in spans.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        inside = shared if i % 2 else one
        kept = sum(w in got[i] for w in set(inside.split()))
        assert kept == len(set(inside.split())) if i < 2 else kept <= 24  # what shares a sentence with other words may stay
        assert text.split()[0] in got[i] and text.split()[-1] in got[i]


def test_trouble(spark, dirty, nothing, sf001):
    assert spans.dedup(nothing).count() == 0
    got = spans.dedup(dirty).collect()
    assert len(got) == dirty.count()
    assert sum(r["__text"] is None for r in got) == 2
    same = [r["__removed"] for r in got if r.doc_id == 1 and r.source == "a"]
    assert same == [0, 0]  # equal rows are one document
    stage = spans.drop_spans(spark, dirty, sf001)
    assert stage.columns == dirty.columns and stage.dtypes == dirty.dtypes and stage.count() == dirty.count()


def test_null_ids_are_documents_after_the_rest(spark):
    text = " ".join(f"word{i}" for i in range(30)) + "."
    got = spans.dedup(spark.createDataFrame([(None, f"{text} Anna"), (3, f"{text} Berta"), (None, f"{text} Clara")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r["__removed"] > 0, "word5" in r["__text"]) for r in got) == [(0, True, False), (0, True, False), (3, False, True)]


@pytest.mark.parametrize("block", [spans.BLOCK_RUNS, 1])
def test_a_repeated_row_keeps_its_text_in_one_block_and_in_two(spark, block, monkeypatch):
    monkeypatch.setattr(spans.spans, "__defaults__", (*spans.spans.__defaults__[:-1], block))
    rng = np.random.default_rng(5)
    text = f"{passage(rng, 30).capitalize()}. {passage(rng, 40).capitalize()}."
    rows = [(1, text), (1, text), (2, f"{passage(rng, 9).capitalize()}. {text}")]
    got = spans.dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r.doc_id, r["__removed"] > 0, r["__text"] == text) for r in got) == [(1, False, True), (1, False, True), (2, True, False)]


@pytest.mark.parametrize("end", ["", "\n", ".\n\n", ". \n \n", "。"])
def test_white_space_at_the_end_repeats_nothing(spark, end):
    text = passage(np.random.default_rng(6), 80) + end
    got = spans.dedup(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["__removed"] == 0 and got["__text"] == text


def test_a_passage_inside_one_long_sentence_is_found(spark):
    rng = np.random.default_rng(8)
    shared = passage(rng, 90)  # no mark, no capital
    rows = [(i, f"{passage(rng, 15)} {shared} {passage(rng, 15)}") for i in range(4)]
    got = {r.doc_id: r["__text"] for r in spans.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    for i in (1, 2, 3):
        assert sum(w in got[i] for w in shared.split()) <= 45
        assert got[i].split()[:15] == rows[i][1].split()[:15]


def test_scripts_without_spaces(spark):
    rng = np.random.default_rng(9)
    say = lambda n: "".join(chr(0x4E00 + int(c)) for c in rng.integers(0, 9000, n)) + "。"
    shared = "".join(say(20) for _ in range(6))
    rows = [(1, say(30) + shared + say(30)), (2, say(30) + shared + say(30)), (3, say(200))]
    got = {r.doc_id: r["__text"] for r in spans.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1] and 62 <= len(got[2]) <= 80


def test_capitals_alone_end_no_sentence():
    assert len(spans.cut("Der Hund und die Katze gingen. Dann kam Anna", CUTTER)[0]) == 2


def test_columns_named_as_internal_ones_stay_as_they_are(spark, dirty):
    names = ("__text", "__removed", "__row", "__at", "__key", "__place", "__gone", "row", "gone", "row_key", "place", "n_removed", "h1", "h2", "first", "again", "run")
    extra = dirty.withColumns({c: F.lit(f"given {c}") for c in names})
    want = sorted(map(str, spans.drop_spans(spark, dirty, "").select(dirty.columns).collect()))
    got = spans.drop_spans(spark, extra, "")
    assert got.columns == extra.columns and all(r[c] == f"given {c}" for r in got.collect() for c in names)
    assert sorted(map(str, got.select([c for c in dirty.columns if c not in names]).collect())) == sorted(map(str, spans.drop_spans(spark, dirty, "").select([c for c in dirty.columns if c not in names]).collect())) and want
    assert spans.dedup(extra).count() == extra.count()
