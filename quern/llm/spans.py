"""Substring dedup by sliding spans of sentences.

A text is cut into sentences, long ones at their commas, and long clauses
before words that their own hash picks, so that a passage put into the middle of
a sentence is cut alike wherever it stands. From every sentence on, and up to every sentence, the shortest run of consecutive sentences with
at least ``MIN_WORDS`` words is hashed: a window that slides by sentences and
holds enough words that it does not repeat by chance. All runs of all texts
are joined on their hash; of a run that occurs again, the first place (least
document, then least sentence) stays, and sentences that any later place
covers are removed.

The join is one exchange of hashes and places. Before it every block of texts
settles its own repeats: only a block's first place of a run goes to the
run's group, its later ones are known to go and are dealt out by content. So a
passage that a third of the corpus holds makes a group of one row a block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import common as C

MIN_WORDS = 26
LONG_SENTENCE = 12
BLOCK_RUNS = 1 << 18
BATCH_TEXTS = 512

#: One word in so many begins a part of a long clause.
ONE_IN = 8

#: A sentence ends after a line break, after an end mark before white space,
#: and after the end marks of scripts that write no spaces.
#: What stands between two sentences or clauses is the group that matched.
BOUNDARY = r"[.!?…][\"'”’»)\]]?(\s+)|[。！？][」』”’）]?(\s*)|(\n\s*)"
CLAUSE = r"[,;:](\s+)|[、，；：](\s*)"
#: Characters of scripts without spaces; two of them count as a word.
UNSPACED = r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003134f]"


def _cutter():
    """(what ends a sentence, what ends a clause, what separates words, a character without spaces)."""
    return re.compile(BOUNDARY), re.compile(CLAUSE), re.compile(r"(\s+)"), re.compile(UNSPACED)


def _pieces(text: str, boundary) -> Iterator[tuple[str, str]]:
    at = 0
    for m in boundary.finditer(text):
        start, end = m.span(m.lastindex)
        yield text[at:start], text[start:end]
        at = end
    yield text[at:], ""


def _parts(clause: str, gap) -> Iterator[tuple[str, str]]:
    """A clause cut before each word that its hash picks."""
    turns = gap.split(clause)  # words and what stands between them in turn
    at = 0
    for i in range(2, len(turns), 2):
        if not crc32(turns[i].lower().encode("utf-8", "surrogatepass")) % ONE_IN and turns[i]:
            yield "".join(turns[at : i - 1]), turns[i - 1]
            at = i
    yield "".join(turns[at:]), ""


def _long(text: str) -> bool:
    return len(text) > 2 * LONG_SENTENCE and len(text.split(None, LONG_SENTENCE)) > LONG_SENTENCE


def cut(text: str, cutter) -> tuple[list[str], list[str]]:
    """(sentences, what stands after each); joined in turn they are the text again.

    A sentence of more than ``LONG_SENTENCE`` words counts as its clauses, and
    such a clause as its parts.
    """
    sentences, gaps = [], []
    for sentence, gap in _pieces(text, cutter[0]):
        if not _long(sentence):
            sentences.append(sentence)
            gaps.append(gap)
            continue
        for clause, inner in _pieces(sentence, cutter[1]):
            if _long(clause):
                for part, space in _parts(clause, cutter[2]):
                    sentences.append(part)
                    gaps.append(space)
                gaps[-1] = inner
            else:
                sentences.append(clause)
                gaps.append(inner)
        gaps[-1] = gap
    return sentences, gaps


def sizes(sentences: list[str], words: list[list[str]], cutter) -> np.ndarray:
    """The words of each sentence; in scripts without spaces two characters make one."""
    return np.array([len(w) if s.isascii() else len(w) + len(cutter[3].findall(s)) // 2 for s, w in zip(sentences, words, strict=True)])


def runs(sizes: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The shortest runs [a, b) of at least ``least`` words from each start and to each end.

    Pieces without words neither begin nor end a run, so that no two runs of a
    text are the same words at the same place.
    """
    held = np.flatnonzero(sizes)
    total = np.r_[0, np.cumsum(sizes[held])]
    n = len(held)
    starts = np.arange(n)
    ends = np.searchsorted(total, total[:-1] + least, side="left")
    forward = {(int(a), int(b)) for a, b in zip(starts, ends, strict=True) if b <= n}
    begins = np.searchsorted(total, total[1:] - least, side="right") - 1
    back = {(int(a), int(b)) for a, b in zip(begins, starts + 1, strict=True) if a >= 0}
    return sorted((int(held[a]), int(held[b - 1]) + 1) for a, b in forward | back)


def _settle(digests: list[bytes], run: np.ndarray, place: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    """A block's runs, those that repeat an earlier place of the block marked as ``again``."""
    h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    order = np.lexsort((run, key, place, h[:, 1], h[:, 0]))
    h, run, place, key = h[order], run[order], place[order], key[order]
    # A repeated row has the same runs again: they are no other place, so one of each stands for all.
    other = np.ones(len(run), bool)
    other[1:] = (h[1:] != h[:-1]).any(axis=1) | (place[1:] != place[:-1]) | (key[1:] != key[:-1]) | (run[1:] != run[:-1])
    h, run, place, key = h[other], run[other], place[other], key[other]
    new = np.ones(len(run), bool)
    new[1:] = (h[1:] != h[:-1]).any(axis=1)
    first = np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))
    again = place > place[first]
    again[1:] |= ~new[1:] & (place[1:] == place[:-1]) & (key[1:] == key[:-1])
    # Known repeats need no comparison any more: those of a text that meet become one stretch, dealt by content.
    known = _stretches(place[again], key[again], run[again])
    columns = [np.concatenate([x, y]) for x, y in zip((h[~again, 0], h[~again, 1].astype(np.int32), place[~again], key[~again], run[~again], again[~again]), known, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h1", "h2", "place", "row_key", "run", "again"])


def _stretches(place: np.ndarray, key: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping or touching runs of a text as one, in the columns of a block's runs."""
    order = np.lexsort((run, key, place))
    place, key, run = place[order], key[order], run[order]
    start, end = run >> 32, run & 0xFFFFFFFF
    text = np.zeros(len(run), bool)
    text[:1] = True
    text[1:] = (place[1:] != place[:-1]) | (key[1:] != key[:-1])
    # Within a text starts ascend; ends are lifted by text so that their running maximum never reaches over.
    lift = np.cumsum(text) << 32
    reach = np.maximum.accumulate(lift + end) if len(run) else lift
    new = text.copy()
    new[1:] |= (lift + start)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.r_[at[1:], len(run)] - 1 if len(at) else at
    stretch = start[at] << 32 | (reach[last] - lift[last])
    h1 = key[at] ^ (stretch * np.int64(0x5851F42D4C957F2D))
    return h1, np.zeros(len(at), np.int32), place[at], key[at], stretch, np.ones(len(at), bool)


def _spans(batches: Iterator[pa.RecordBatch], least: int, block: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    cutter = _cutter()
    digests: list[bytes] = []
    found: list[np.ndarray] = []
    rows: list[tuple[int, int, int]] = []

    def flush() -> pa.RecordBatch:
        places, keys, counts = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        return _settle(digests, np.concatenate(found), np.repeat(places, counts), np.repeat(keys, counts))

    for batch in batches:
        for key, place, text in zip(batch.column("row_key").to_pylist(), batch.column("place").to_pylist(), batch.column("text"), strict=True):
            sentences = cut(text.as_py() or "", cutter)[0]
            words = [x.lower().split() for x in sentences]
            own = runs(sizes(sentences, words, cutter), least)
            if not own:
                continue
            joined = [" ".join(w) for w in words]
            digests += [xxhash.xxh3_128_digest(" ".join(filter(None, joined[a:b]))) for a, b in own]
            found.append(np.array([a << 32 | b for a, b in own]))
            rows.append((place, key, len(own)))
            if len(digests) >= block:
                yield flush()
                digests.clear()
                found.clear()
                rows.clear()
    if rows:
        yield flush()


def _place(ident: Column, key: Column) -> Column:
    """A document's place in the order of ids; rows with a null id come last, by content."""
    return F.coalesce(ident, F.lit(2**63 - 1) - F.shiftrightunsigned(key, 2))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, block: int = BLOCK_RUNS) -> DataFrame:
    """``(h1, h2, place, row_key, run, again)``: a row for each run.

    run: first sentence << 32 | end; again: whether it is known to repeat an
    earlier place (h1 then only deals it out).
    """
    ident, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    key = C.row_key(ident, text)
    rows = docs.select(_place(ident, key).alias("place"), key.alias("row_key"), text.alias("text")).where("text is not null")
    return rows.mapInArrow(lambda it: C.lean(_spans(it, min_words, block)), "h1 long, h2 int, place long, row_key long, run long, again boolean")


def repeated(found: DataFrame) -> DataFrame:
    """``(place, row_key, gone array<long>)``: the runs of a text that are not at their first place."""
    first = F.min(F.when(~F.col("again"), F.col("place"))).over(Window.partitionBy("h1", "h2"))
    later = found.withColumn("first", first).where("again or place > first")
    return later.groupBy("place", "row_key").agg(F.collect_list("run").alias("gone"))


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cutter = _cutter()
    for b in (x.slice(at, BATCH_TEXTS) for x in batches for at in range(0, x.num_rows, BATCH_TEXTS)):
        given, texts, removed = b.column("text"), [], []
        for i, gone in enumerate(b.column("gone").to_pylist()):
            out = {k for run in gone or () for k in range(run >> 32, run & 0xFFFFFFFF)}
            text = given[i].as_py()
            removed.append(len(out))
            if out:
                sentences, gaps = cut(text, cutter)
                # A kept sentence is followed by its own gap, or by the line break that a removed neighbour had.
                text = "".join(s + g for k, (s, g) in enumerate(zip(sentences, gaps, strict=True)) if k not in out).rstrip()
            texts.append(text)
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], names=["row", "text", "n_removed"])


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``(row, text, n_removed)``: each row's other columns, its text less its repeated spans, and how many sentences those were.

    Every row stays, also where nothing of its text is left (empty) and where
    the text is null. Rows that share an id count as one document and keep each
    other's runs. Rows with a null id are documents of their own, after the rest.
    Sentences are compared in lower case with single spaces. Ties between
    places of equal id go by content; texts count whole, however long they are;
    an empty table gives no rows. A passage is found where whole sentences,
    clauses or parts of it hold ``min_words`` words: some dozen words at either
    end, which share a sentence with other text, may not be covered.
    """
    ident, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    key = C.row_key(ident, text)
    gone = repeated(spans(docs, id_col, text_col, min_words))
    keyed = docs.select(C.as_row(docs, (text_col,)).alias("row"), text.alias("text"), key.alias("row_key"), _place(ident, key).alias("place"))
    rows = keyed.join(gone, ["place", "row_key"], "left").select("row", "text", "gone")
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_removed", T.IntegerType())])
    return rows.mapInArrow(lambda it: C.lean(_rebuild(it)), schema)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``cleaned`` with the given columns side by side: the new text is ``__text``, the number of sentences ``__removed``.

    Given columns of these two names give way to them.
    """
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in (text_col, "__text", "__removed")]
    return cleaned(docs, id_col, text_col, min_words).select(*own, F.col("text").alias("__text"), F.col("n_removed").alias("__removed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document's text without repeated spans."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return cleaned(docs).select("row.doc_id", "n_removed", "text")


def drop_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts lose repeated spans; a document of which no word is left goes.

    Rows with a null text stay as they are, as do all rows that lose nothing.
    The columns are those of ``docs``; ``n_chars``, where it is one, counts the
    text that is left. An empty table gives no rows.
    """
    left = cleaned(docs).where("n_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    columns = {c: F.col("row").getField(c) for c in docs.columns if c != "text"} | {"text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(columns["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return left.select(*[columns[c].alias(c) for c in docs.columns])
