import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from quern.llm import bpe

WILD = [
    "",
    None,
    "<|endoftext|>",
    "a<|endoftext|><|endoftext|> b",
    "  \n\n x\u0085y  z　q w​z",
    "it's we'LL I'll don't 'tis''s",
    "\x00\x01 tab\tx",
    "x\x1cy \x1d z\x1e\x1f ᠎ a﻿ b",
    "³² ½ ª º µ ӿ ß",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.DEFAULT_TOKENIZER)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_ids_and_text_are_the_librarys(spark, docs, dirty, library):
    rng = random.Random(1)
    noise = "".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0xE000, 0x1FFFF), 32, 39, 10])) for _ in range(5000))
    rows = docs.select("doc_id", "text").unionByName(dirty.select("doc_id", "text")).unionByName(spark.createDataFrame(list(enumerate([*WILD, noise], 10_000)), "doc_id long, text string"))
    for chars in (bpe.BLOCK_CHARS, 3000):
        got = bpe.digests(bpe.round_trip(rows, block_chars=chars)).collect()
        assert sorted(str((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in got) == sorted(str((r.doc_id, *expected(library, r.text))) for r in rows.collect())


def test_encode_then_decode(spark, docs, nothing, library):
    coded = bpe.encode(docs)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.ids == library.encode(text[r.doc_id], add_special_tokens=False).ids for r in coded.collect())
    assert {r.doc_id: r.text for r in bpe.decode(coded).collect()} == text
    assert bpe.encode(nothing).count() == 0


def test_broken_bytes_decode_as_in_the_library(spark, library):
    ids = [[i] for i in range(0, 50257, 97)] + [[], [188, 50256, 126], None]
    got = {r.doc_id: r.text for r in bpe.decode(spark.createDataFrame(list(enumerate(ids)), "doc_id long, ids array<int>")).collect()}
    assert got == {i: library.decode(x or [], skip_special_tokens=False) for i, x in enumerate(ids)}


def test_every_code_point_is_split_alike(library):
    split, _ = bpe._splitter(bpe.DEFAULT_TOKENIZER)
    for cp in [*range(0x3100), *range(0xA000, 0xA100), *range(0xA780, 0xA800), *range(0xFE00, 0x10000), *range(0x10500, 0x10600), *range(0x1F300, 0x1F700)]:
        text = f"a{chr(cp)}1{chr(cp)} ."
        assert split(text) == [text[s:e] for _, (s, e) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_varints():
    for v in (np.array([], np.int64), np.array([0, 1, 127, 128, 16383, 16384, 2**31 - 1, 5, 2**34]), np.arange(100)):
        assert bpe.from_varint(bpe.to_varint(v)).tolist() == v.tolist()


def test_differing_readings_fail(monkeypatch):
    with pytest.raises(RuntimeError, match="different readings"):
        bpe._table([(1, [b"", b"", b""])], 2, 0)
