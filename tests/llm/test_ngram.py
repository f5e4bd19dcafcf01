import collections
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quern.llm import ngram


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\n"]


class Plain:
    """The same model with dictionaries."""

    def __init__(self, texts, order=ngram.ORDER):
        self.order = order
        seqs = [tokens(t) for t in texts]
        self.count = collections.Counter(w for s in seqs for w in s)
        self.n, self.v = sum(self.count.values()), len(self.count)
        self.grams = {order: collections.Counter(g for s in seqs for g in self.windows(s))}
        for k in range(order - 1, 0, -1):
            self.grams[k] = collections.Counter(g[1:] for g in self.grams[k + 1])
        self.context = {k: collections.defaultdict(lambda: [0, 0, 0, 0]) for k in self.grams}
        for k, grams in self.grams.items():
            for g, c in grams.items():
                self.context[k][g[:-1]][0] += c
                self.context[k][g[:-1]][min(c, 3)] += 1
        self.d = {k: ngram.discounts([sum(x == i for x in c.values()) for i in (1, 2, 3, 4)]) for k, c in self.grams.items()}

    def windows(self, s):
        s = [" "] * (self.order - 1) + s
        return [tuple(s[i : i + self.order]) for i in range(len(s) - self.order + 1)]

    def p(self, g):
        if not g:
            return 1 / (self.v + 1)
        k = len(g)
        lower = self.p(g[1:])
        if g[:-1] not in self.context[k]:
            return lower
        total, *n = self.context[k][g[:-1]]
        c = self.grams[k][g]
        return (c - self.d[k][min(c, 3) - 1] if c else 0) / total + sum(d * m for d, m in zip(self.d[k], n, strict=True)) / total * lower

    def score(self, text):
        t = tokens(text)
        return len(t), sum(self.count[w] > 0 for w in t), sum(math.log10((self.count[w] + 1) / (self.n + self.v + 1)) for w in t), sum(math.log10(self.p(g)) for g in self.windows(t))


def close(got, want):
    assert (got.n_tokens, got.n_known) == want[:2]
    assert got.base_score == pytest.approx(want[2], rel=1e-9, abs=1e-9) and got.score == pytest.approx(want[3], rel=1e-9, abs=1e-9)


def test_query_is_the_plain_model(spark, sf001):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()}
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in rows}
    plain = Plain([t for d, t in rows.items() if not out[d]])
    got = ngram.query(spark, sf001).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == out[r.doc_id] and r.train_tokens == plain.n
        close(r, plain.score(rows[r.doc_id]))


def test_held_out_text_is_likelier_than_by_single_words(spark):
    got = ngram.query(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("base_score").alias("base"), F.sum("score").alias("score")).first()
    assert got.score > 0.9 * got.base


def test_texts_whose_copy_was_learned_are_told_apart(spark):
    import random

    rng = random.Random(2)
    words = [f"w{i}" for i in range(4000)]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(4000)], k=150)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    apart = {}
    for order in (2, 3):
        got = {r.doc_id: r.score / r.n_tokens for r in ngram.score(df, ngram.train(df.where("doc_id < 150"), order=order)).collect()}
        apart[order] = min(got[i] for i in range(150)) - max(got[i] for i in range(150, 300))
    assert apart[3] > 0.5 and apart[3] > apart[2]


def test_probabilities_sum_to_one():
    plain = Plain(["a b a b c", "b c d", "a a a a a a"])
    for u in (("a", "b"), ("b", "c"), (" ", "a"), (" ", " "), ("unseen", "a"), ("a", "unseen")):
        assert sum(plain.p((*u, v)) for v in plain.count) + plain.p((*u, "unseen word")) == pytest.approx(1.0)


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("buckets", [1, 70])
def test_any_order_and_number_of_buckets(spark, docs, order, buckets, monkeypatch):
    some = docs.where("doc_id < 60 and length(text) < 4000").select("doc_id", "text").cache()
    rows = {r.doc_id: r.text for r in some.collect()}
    size = sum(len((t or "").encode()) for t in rows.values())
    monkeypatch.setattr(ngram, "BUCKET_BYTES", max(1, size // buckets))
    train = some.where("doc_id % 3 > 0")
    model = ngram.train(train, order=order, share=8)
    assert model.buckets >= buckets / 2 and (model.shares > 4 or buckets == 1)
    plain = Plain([t for d, t in rows.items() if d % 3], order)
    for r in ngram.score(some, model).collect():
        close(r, plain.score(rows[r.doc_id]))


def test_trouble_and_large_counts(spark, dirty, nothing):
    empty = ngram.train(nothing)
    assert ngram.score(nothing, empty).count() == 0
    assert all(r.score == 0.0 and r.n_known == 0 for r in ngram.score(dirty, empty).collect())
    rows = [(r.doc_id, r.text) for r in dirty.collect()]
    plain = Plain([t for _, t in rows])
    model = ngram.train(dirty)
    assert model.tokens == plain.n and model.types == plain.v
    got = sorted(ngram.score(dirty, model).collect(), key=lambda r: (str(r.doc_id), r.n_tokens, r.score))
    want = sorted(((str(d), *plain.score(t)) for d, t in rows), key=lambda x: (x[0], x[1], x[4]))
    for r, w in zip(got, want, strict=True):
        close(r, w[1:])


def test_words_and_ngrams_of_a_block_are_those_of_plain_code():
    import numpy as np
    import pyarrow as pa

    texts = [None, b"", b" \t", bytes(range(256)).replace(b"A", b"AB \x0b\x1c\x85"), "Ünï ÇA b c  X b c".encode(), b"a b c a b c a", b"\x1d \x1f b\r\n"]
    words = [(t or b"").lower().split() for t in texts]
    flat, sizes = ngram._split(pa.array(texts, pa.binary()))
    assert flat.view(pa.large_binary()).to_pylist() == [w for some in words for w in some] and sizes.tolist() == [len(w) for w in words]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.binary())], names=["doc_id", "text"])
    (block,) = ngram._blocks(iter([batch, batch.slice(0, 0)]), 3, ["doc_id"])
    assert block.sizes.tolist() == [len(w) + 1 for w in words] and [r[0] for r in block.rows] == list(range(len(texts)))
    at = np.flatnonzero(block.tokens)
    for k, (places, every) in enumerate(ngram._grams(block, 3)):
        gram = lambda p: tuple(block.tokens[p - k : p + 1].tolist())  # noqa: B023, E731
        assert [gram(p) for p in places[every]] == [gram(p) for p in at] and len({gram(p) for p in places}) == len(places)
