"""Fill-in-middle: a text is cut at two unit borders and its parts are put in another order.

The cutter holds no list of units. A first pass over a lazy match iterator
counts them; the ranks of both cuts follow from the count and the row's id; a
second pass advances the iterator to those ranks and keeps two offsets. So
beside the text itself, the space is the same for a line and for a book.

The transformed text is exact to reverse: the marks occur in no text that is
transformed (such texts stay plain), so where each of them stands is certain.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common as C

LINES = r"[^\n]*\n|[^\n]+"
MARKS = ("<P>", "<S>", "<M>")
SEED = 7
#: Of 100 texts, how many are transformed, and of these how many have the suffix first.
RATE, SPM = 100, 50
#: Characters of finished texts that a worker holds before it hands them on.
HELD_CHARS = 8 << 20
PARTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, ...]:
    """Four numbers below 2^32 from the row's id; a null id counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4]) for i in range(0, 16, 4))


def count_units(text: str, unit: re.Pattern) -> int:
    return sum(1 for _ in unit.finditer(text))


def borders(text: str, unit: re.Pattern, first: int, second: int) -> tuple[int, int]:
    """The offsets after ``first`` and after ``second`` units, first <= second; one walk, no unit kept."""
    matches, at, end = unit.finditer(text), 0, 0
    found = []
    for rank in (first, second):
        while at < rank:
            end = next(matches).end()
            at += 1
        found.append(end)
    return found[0], found[1]


def cut(text: str, doc_id: int | None, unit: re.Pattern, marks: tuple[str, str, str] = MARKS, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> tuple[int, str, int, int]:
    """(units, form, end of the prefix, end of the middle); the ends are 0 for a plain text."""
    n = count_units(text, unit)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
        return n, "plain", 0, 0
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, "spm" if h4 % 100 < spm else "psm", *borders(text, unit, a, b)


def arrange(text: str, form: str, a: int, b: int, marks: tuple[str, str, str] = MARKS) -> str:
    p, s, m = marks
    if form == "psm":
        return "".join((p, text[:a], s, text[b:], m, text[a:b]))
    if form == "spm":
        return "".join((s, text[b:], p, text[:a], m, text[a:b]))
    return text


def check_marks(marks: tuple[str, str, str]) -> None:
    """A mark is found with certainty only if none can begin inside another one or at its end."""
    if len(set(marks)) != 3 or any(not m or m[0] in m[1:] or any(m[0] in x[1:] for x in marks) for m in marks):
        raise ValueError("marks must differ, and begin with a character that occurs nowhere else in them")


def _transform(batches: Iterator[pa.RecordBatch], pattern: str, marks: tuple[str, str, str], rate: int, spm: int, seed: int) -> Iterator[pa.RecordBatch]:
    unit = re.compile(pattern)
    out: list[tuple] = []
    held = 0

    def flush() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    for batch in batches:
        for ident, value in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            doc_id, text = ident.as_py(), value.as_py()
            n, form, a, b = cut(text, doc_id, unit, marks, rate, spm, seed)
            plain = form == "plain"
            out.append((doc_id, n, form, None if plain else a, None if plain else b - a, arrange(text, form, a, b, marks)))
            held += len(text)
            if held >= HELD_CHARS:
                yield flush()
                out, held = [], 0
    if out:
        yield flush()


def transform(docs: DataFrame, unit: str = LINES, marks: tuple[str, str, str] = MARKS, rate: int = RATE, spm: int = SPM, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` for every row of docs.

    ``unit`` is the pattern of a unit, matched left to right; what no unit
    covers belongs to the part that it stands in. ``output`` is the whole
    transformed text. Empty texts and texts that hold a mark are ``plain``: they
    stay as they are, their part lengths null. Null texts count as empty; rows
    of a null id are cut as if the id had no digits; repeated rows give the same
    row each, and equal texts of other ids are cut elsewhere. A text is worked
    through whole, however long. An empty table gives no rows. Columns other
    than the two named are not read. No row leaves its partition.
    """
    check_marks(marks)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(lambda it: C.lean(_transform(it, unit, marks, rate, spm, seed)), PARTS)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``output`` was made of; only output and form are used, and no part is searched for text."""
    first = F.length(F.lit(marks[0])), F.length(F.lit(marks[1])), F.length(F.lit(marks[2]))

    def between(start: Column, end: Column) -> Column:
        return F.substr(output, start, end - start)

    end = F.length(output) + 1
    p, s, m = (F.instr(output, F.lit(x)) for x in marks)
    psm = F.concat(between(first[0] + 1, s), between(m + first[2], end), between(s + first[1], m))
    spm = F.concat(between(p + first[0], m), between(m + first[2], end), between(first[1] + 1, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every document cut, rearranged and rebuilt, as digests."""
    got = transform(C.table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = """
WITH rows AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
cut AS (
  SELECT *, string_split(t, chr(10)) AS parts,
    length(t) - length(replace(t, chr(10), '')) + CASE WHEN t = '' OR suffix(t, chr(10)) THEN 0 ELSE 1 END AS n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM rows),
ranks AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
heads AS (
  SELECT *, CASE WHEN a = 0 THEN '' WHEN a = n THEN t ELSE array_to_string(parts[1:a], chr(10)) || chr(10) END AS head,
    CASE WHEN b = 0 THEN '' WHEN b = n THEN t ELSE array_to_string(parts[1:b], chr(10)) || chr(10) END AS upto
  FROM ranks),
three AS (SELECT *, substr(upto, length(head) + 1) AS mid, substr(t, length(upto) + 1) AS tail FROM heads)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(head) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || mid ELSE '<S>' || tail || '<P>' || head || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM three
"""
