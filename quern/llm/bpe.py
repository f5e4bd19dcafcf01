"""Byte-level BPE over a table of distinct words.

Texts are split into words by the tokenizer's own pattern and coded by blocks
of documents: a block keeps its distinct words once and each text becomes the
places of its words in that list, most frequent first, as variable-length
integers. Words go to their bucket, where every distinct word of the corpus is
encoded once; the ids go back to the blocks and are joined to the texts by
position. So what is shuffled is a byte or two a word and each block's own
words, not every occurrence.

Decoding joins each id to its piece, a table of vocabulary size, and joins the
pieces' bytes.

The blocks are made twice, for the words and for the texts. Both passes read
the same partitions in the same order; a checksum of the block's words travels
with either, and if they ever differ the job fails rather than give wrong ids.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common as C
from quern.llm.packing import pack, unpack

DEFAULT_TOKENIZER = str(public_tokenizers.path("byte_bpe_50k.json"))
#: Bytes of text for each bucket of words.
BUCKET_BYTES = 48 << 20
BLOCK_CHARS = 8 << 20
BATCH_TOKENS = 1 << 19
_ROW = "kind int, block long, bucket int, at long, doc_id long, payload binary, mark long"
_SCHEMA = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("at", pa.int64()), ("doc_id", pa.int64()), ("payload", pa.binary()), ("mark", pa.int64())])

#: The pattern that splits a text before byte-level merges (a fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _latin(end: int = 0x250):
    """The pattern for texts of code points below ``end``, for the faster engine, and what finds others."""
    import re

    import regex

    def chars(kind: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(end) if regex.match(kind, chr(c)))

    letter, number, space = chars(r"\p{L}"), chars(r"\p{N}"), chars(r"\s")
    pattern = rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    return re.compile(pattern).findall, re.compile(f"[^\\x00-{chr(end - 1)}]").search


@functools.cache
def _unassigned():
    """What finds code points that had no meaning yet in this Python's Unicode version."""
    import re
    import sys
    import unicodedata

    out, start = [], None
    for c in range(sys.maxunicode + 2):
        open_ = c <= sys.maxunicode and unicodedata.category(chr(c)) == "Cn"
        if open_ and start is None:
            start = c
        elif not open_ and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return re.compile(f"[{''.join(out)}]").search


@functools.cache
def _splitter(path: str):
    """(function from a text to its words, special strings with their ids)."""
    import regex

    spec = json.load(open(path, encoding="utf-8"))
    if (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"] or spec["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError(f"{path} is not a plain byte-level tokenizer")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    every, (few, other), new = regex.compile(PATTERN).findall, _latin(), _unassigned()
    own = _tokenizer(path).pre_tokenizer.pre_tokenize_str

    def find(text: str) -> list[str]:
        if not other(text):
            return few(text)
        # Of code points that are newer than one of the Unicode tables only the library knows what it takes them for.
        return [text[s:e] for _, (s, e) in own(text)] if new(text) else every(text)

    if not special:
        return find, special
    part = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")")

    def split(text: str) -> list[str]:
        if not any(s in text for s in special):
            return find(text)
        out: list[str] = []
        for p in part.split(text):
            out.extend([p] if p in special else find(p))
        return out

    return split, special


def to_varint(v: np.ndarray) -> bytes:
    """Non-negative numbers as little-endian base-128 with continuation bits."""
    v = np.asarray(v, dtype=np.int64)
    if not len(v):
        return b""
    limits = [k for k in range(1, 5) if v.max() >= 1 << (7 * k)]
    n = np.ones(len(v), dtype=np.int64)
    for k in limits:
        n += v >= 1 << (7 * k)
    start = np.cumsum(n) - n
    out = np.zeros(int(start[-1] + n[-1]), dtype=np.uint8)
    out[start] = v & 127 | (n > 1) << 7
    for k in limits:
        has = np.flatnonzero(n > k)
        out[start[has] + k] = v[has] >> (7 * k) & 127 | (n[has] > k + 1) << 7
    return out.tobytes()


def from_varint(b: bytes) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8)
    last = np.flatnonzero(raw < 128)
    if len(last) == len(raw):
        return raw.astype(np.int64)
    start = np.r_[0, last[:-1] + 1]
    out = raw[start].astype(np.int64) & 127
    has = np.flatnonzero(last > start)
    k = 1
    while len(has):
        out[has] |= (raw[start[has] + k].astype(np.int64) & 127) << (7 * k)
        k += 1
        has = has[last[has] >= start[has] + k]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], path: str, buckets: int, kind: int, size: int) -> Iterator[pa.RecordBatch]:
    split, _ = _splitter(path)
    part = TaskContext.get().partitionId()
    number, at, chars = 0, 0, 0
    codes: dict[str, int] = defaultdict()
    codes.default_factory = codes.__len__
    texts: list[tuple[int, int | None, np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        block = part << 24 | number
        words = list(codes)
        every = np.concatenate([t[2] for t in texts]) if texts else np.zeros(0, np.int32)
        order = np.argsort(-np.bincount(every, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), dtype=np.int32)
        rank[order] = np.arange(len(words), dtype=np.int32)
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        crc = np.fromiter(map(zlib.crc32, coded), np.int64, len(words))
        mark = int(np.bitwise_xor.reduce(crc * (rank + 1))) if words else 0
        if kind:
            for i in range(0, len(texts), 512):
                some = texts[i : i + 512]
                yield _rows([(1, block, 0, n, d, to_varint(rank[c]), mark) for n, d, c in some])
            return
        bucket = crc % buckets
        by = np.argsort(bucket, kind="stable")
        for run in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(by) else []:
            some = [coded[i] for i in run]
            yield _rows([(0, block, int(bucket[run[0]]), -1, None, pack(rank[run], np.array([len(x) for x in some], np.int32), b"".join(some), level=3), mark)])

    for b in batches:
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            text = text.as_py() or ""
            found = split(text)
            texts.append((at, doc_id, np.fromiter(map(codes.__getitem__, found), np.int32, len(found))))
            at, chars = at + 1, chars + len(text)
            if chars >= size:
                yield from flush()
                number, chars = number + 1, 0
                codes.clear()
                texts.clear()
    if texts:
        yield from flush()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Word lists of one bucket after another become id lists; each distinct word is encoded once."""
    tokenizer, (_, special) = _tokenizer(path), _splitter(path)
    known: dict[bytes, np.ndarray] = {}
    bucket = None
    for b in batches:
        for r in b.to_pylist():
            if r["bucket"] != bucket:
                known, bucket = {}, r["bucket"]
            rank, sizes, raw = unpack(r["payload"], np.int32, np.int32, bytes)
            words = [raw[e - s : e] for s, e in zip(sizes, np.cumsum(sizes), strict=True)]
            new = [w for w in words if w not in known]
            for i in range(0, len(new), 20_000):
                some = new[i : i + 20_000]
                text = [w.decode("utf-8", "surrogatepass") for w in some]
                for w, t, e in zip(some, text, tokenizer.encode_batch_fast(text, add_special_tokens=False), strict=True):
                    known[w] = np.array([special[t]] if t in special else e.ids, np.int32)
            ids = [known[w] for w in words]
            yield _rows([(0, r["block"], r["bucket"], -1, None, pack(rank, np.array([len(x) for x in ids], np.int32), to_varint(np.concatenate(ids)), level=3), r["mark"])])


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a block its words' ids come first, then its texts."""
    block, parts, table = None, [], None
    out: list[np.ndarray] = []
    docs: list[int | None] = []
    held = 0

    def flush() -> pa.RecordBatch:
        offsets = np.r_[0, np.cumsum([len(x) for x in out])].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out)))], names=["doc_id", "ids"])

    for b in batches:
        for i in range(b.num_rows):
            r = {n: b.column(n)[i].as_py() for n in ("kind", "block", "doc_id", "payload", "mark")}
            if r["block"] != block:
                block, parts, table = r["block"], [], None
            if r["kind"] == 0:
                parts.append((r["mark"], unpack(r["payload"], np.int32, np.int32, bytes)))
                continue
            if table is None:
                table = _table(parts, r["mark"], block)
                parts = []
            start, size, ids = table
            places = from_varint(r["payload"])
            n = size[places]
            into = np.repeat(start[places] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            out.append(ids[into])
            docs.append(r["doc_id"])
            held += len(into)
            if held >= BATCH_TOKENS:
                yield flush()
                out, docs, held = [], [], 0
    if docs:
        yield flush()


def _table(parts: list, mark: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By place in the block's list: where the word's ids start, how many, and all ids."""
    if any(m != mark for m, _ in parts):
        raise RuntimeError(f"block {block}: its words and its texts come from different readings of the input")
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.int32)
    rank = np.concatenate([p[0] for _, p in parts])
    sizes = np.concatenate([p[1] for _, p in parts]).astype(np.int64)
    ids = np.concatenate([from_varint(p[2]).astype(np.int32) for _, p in parts])
    start, size = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
    start[rank], size[rank] = np.cumsum(sizes) - sizes, sizes
    return start, size, ids


def _coded(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, block_chars: int) -> DataFrame:
    """Blocks one after the other: first the ids of a block's words, then its texts."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))

    def blocks(kind: int) -> DataFrame:
        return rows.mapInArrow(lambda it: C.lean(_blocks(it, tokenizer, buckets, kind, block_chars)), _ROW)

    ids = blocks(0).repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: C.lean(_encode(it, tokenizer)), _ROW)
    # The texts come first in the union: blocks are numbered by partition, which a union counts through.
    return blocks(1).unionByName(ids).repartition("block").sortWithinPartitions("block", "kind", "at")


def encode(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, ids array<int>)`` for every row of docs.

    Null and empty texts have no ids. Rows with a null or repeated id, and
    wholly equal rows, stay rows of their own. Texts are encoded whole, however
    long they are. An empty table gives no rows, and other columns are not read.
    """
    return _coded(docs, tokenizer, id_col, text_col, block_chars).mapInArrow(lambda it: C.lean(_join(it)), "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``decode(encode(docs))`` with both steps in one worker."""
    return _coded(docs, tokenizer, id_col, text_col, block_chars).mapInArrow(lambda it: C.lean(_decode(_join(it), tokenizer)), "doc_id long, ids array<int>, text string")


@functools.cache
def _pieces(path: str) -> pa.Array:
    """The bytes of each id's piece; ids without one have null."""
    spec = json.load(open(path, encoding="utf-8"))
    # Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on, in order.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    table: dict[int, bytes] = {i: bytes(byte[c] for c in p) for p, i in spec["model"]["vocab"].items()}
    table |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return pa.array([table.get(i) for i in range(max(table) + 1)], pa.large_binary())


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    pieces = _pieces(path)
    for b in batches:
        lists = b.column("ids")
        found = pc.take(pieces, lists.flatten())
        ends = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1 + found.offset)[found.offset :]
        data = found.buffers()[2]
        raw = memoryview(data) if data is not None else memoryview(b"")
        cuts = np.r_[0, np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))]
        texts = [bytes(raw[ends[s] : ends[e]]).decode("utf-8", "replace") for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in b.schema.names], pa.array(texts, pa.string())], names=[*b.schema.names, "text"])


def decode(coded: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``(doc_id, ids, text)``: each id joined to its piece, the pieces' bytes joined to text.

    Bytes that are not UTF-8 become U+FFFD, as in the library. Null ids count
    as none.
    """
    rows = coded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(lambda it: C.lean(_decode(it, tokenizer)), "doc_id long, ids array<int>, text string")


def digests(got: DataFrame) -> DataFrame:
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2(F.col("text"), 256).alias("decoded_sha256"), "ids")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: ids and decoded text of every document, as digests."""
    return digests(round_trip(C.table(spark, sf_dir, "documents"))).drop("ids")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: ``doc_id, n_tokens, ids_sha256, decoded_sha256, ids``."""
    return digests(round_trip(docs))
