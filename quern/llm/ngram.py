"""Perplexity by an interpolated modified Kneser-Ney n-gram model.

The training documents' words are counted in Spark and numbered, the frequent
ones first. Their n-grams are counted then: combined within each block of text,
dealt by hash as numbers, merged. What a bucket has merged gives the rows of
the next lower order, each n-gram's last words with the number of words before
them, and so on down to words. An order's n-grams are dealt by one word and a
share of another, so that all that a context needs meets in one bucket, and a
frequent word is spread over many. Each bucket writes sorted arrays of hashes
with their counts to the shared folder; workers map those files into memory and
look up a block's distinct n-grams in hash order. What reaches the driver is a
few sums a bucket.

Words are known by 64-bit hashes; two words of one hash share their counts. An
n-gram that was not learned is taken for a learned one with a chance of 2^-28
at most, because n-grams' hashes are stored in part. The order is a parameter;
see ``ORDER``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common as C
from quern.llm.packing import mapped, new_folder, pack, unpack, write

BLOCK_BYTES = 12 << 20
#: The same of a block whose words alone are counted, and bytes of text that are split at a time.
WORDS_BYTES, _SLICE = 40 << 20, 1 << 20
#: The order of the model that the query trains, two or more.
ORDER = 3
#: Bytes of text for each bucket; a frequent word is dealt to one bucket in so many.
BUCKET_BYTES, SHARE = 48 << 20, 32
HELD_OUT, FOLDS = 2, 7
_START, _END = b" ", b"\n"  # no word holds either
_START_ID, _UNKNOWN = np.uint64(0), np.uint64(2**64 - 1)
_ROW = "bucket int, kind int, payload binary"


def held_out(doc_id: Column) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS) == HELD_OUT


def _mix(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The hash of two hashes in order."""
    x = u * np.uint64(0x9E3779B97F4A7C15) + v
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _gram(words: list[np.ndarray]) -> np.ndarray:
    """The hash of n-grams from the numbers of their words."""
    out = words[0]
    for w in words[1:]:
        out = _mix(out, w)
    return out if len(words) > 1 else _mix(out, np.uint64(0))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _home(words: list[np.ndarray], buckets: int, shares: int) -> np.ndarray:
    """The bucket of n-grams: by their first word but one and a share of the first, of pairs by the first and a share of the last.

    From order three on a context (all words but the last) has one home.
    """
    lead, split = (words[1], words[0]) if len(words) > 2 else (words[0], words[1])
    return _bucket(_mix(lead, split % np.uint64(shares)), buckets)


def _number(rank: np.ndarray, bucket: np.ndarray | int, buckets: int) -> np.ndarray:
    """A word's number, from its rank in its bucket; the start has 0."""
    return rank.astype(np.uint64) * np.uint64(buckets) + np.asarray(bucket).astype(np.uint64) + np.uint64(1)


def _rank(number: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, rank) of words."""
    rank, bucket = np.divmod(number - np.uint64(1), np.uint64(buckets))
    return bucket.astype(np.int64), rank.astype(np.int64)


@dataclass
class _Block:
    hashes: np.ndarray  # of the block's distinct tokens
    tokens: np.ndarray  # starts, words, end of each document, as places in hashes
    sizes: np.ndarray  # tokens of each document, without the starts
    rows: list  # what the caller gave with each document


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of texts, how many each has), A-Z in lower case; these functions have just the white space and the case that count here."""
    kind = pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string()
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, b"").view(kind)))
    lists = pc.ascii_split_whitespace(trimmed)
    flat, sizes = lists.flatten(), lists.value_lengths().to_numpy().astype(np.int64)
    empty = pc.binary_length(trimmed).to_numpy() == 0  # these are split into one empty word
    if empty.any():
        sizes[empty] = 0
        flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
    return flat.cast(pa.large_string()) if kind == pa.string() else flat, sizes


def _tokenized(batches: Iterator[pa.RecordBatch], extra: list[str], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list]]:
    """Blocks of texts: (hashes of the distinct words, words as places in hashes, words of each text, what else was asked for)."""
    import xxhash

    flats: list[pa.Array] = []
    sizes: list[np.ndarray] = []
    rows: list[tuple] = []

    def block():
        coded = pa.concat_arrays(flats).dictionary_encode()
        distinct = coded.dictionary.view(pa.large_binary()).to_pylist()
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, 7) for w in distinct), np.uint64, len(distinct))
        return hashes, coded.indices.to_numpy().astype(np.int64), np.concatenate(sizes), rows

    held = 0
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _SLICE, side="right")))
            some = b.slice(at, to - at)
            flat, n = _split(some.column("text"))
            flats.append(flat)
            sizes.append(n)
            rows.extend(zip(*[some.column(c).to_pylist() for c in extra], strict=True) if extra else [()] * some.num_rows)
            held += 8 * len(flat)
            at = to
            if held >= size:
                yield block()
                flats, sizes, rows, held = [], [], [], 0
    if sizes:
        yield block()


def _blocks(batches: Iterator[pa.RecordBatch], order: int, extra: list[str], size: int = BLOCK_BYTES) -> Iterator[_Block]:
    import xxhash

    edges = np.array([xxhash.xxh64_intdigest(w, 7) for w in (_START, _END)], np.uint64)
    for hashes, words, sizes, rows in _tokenized(batches, extra, size):
        tokens = np.zeros(len(words) + order * len(sizes), np.int64)
        tokens[np.arange(len(words)) + np.repeat(np.arange(len(sizes)) * order + order - 1, sizes)] = words + 2
        tokens[np.cumsum(sizes + order) - 1] = 1
        yield _Block(np.concatenate([edges, hashes]), tokens, sizes + 1, rows)


def _grams(b: _Block, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order from one on: (a place of each distinct n-gram, the n-gram at each token), tokens but the starts."""
    at = np.flatnonzero(b.tokens != 0)
    every = b.tokens[at] - 1  # the block's words are numbered as it is, and each stands somewhere
    places = np.zeros(len(b.hashes) - 1, np.int64)
    places[every] = at
    out = [(places, every)]
    for k in range(1, order):
        keys = b.tokens[at - k] << 32 | every
        by = np.argsort(keys)
        keys = keys[by]
        new = np.r_[True, keys[1:] != keys[:-1]]
        every = np.empty(len(by), np.int64)
        every[by] = np.cumsum(new) - 1
        out.append((at[by[new]], every))
    return out


def _words(ids: np.ndarray, b: _Block, places: np.ndarray, order: int) -> list[np.ndarray]:
    """The words' numbers of the n-grams that end at places."""
    return [ids[b.tokens[places - k]] for k in range(order - 1, -1, -1)]


def _count_words(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    end = np.array([xxhash.xxh64_intdigest(_END, 7)], np.uint64)
    for hashes, words, sizes, _ in _tokenized(batches, [], WORDS_BYTES):
        hashes, n = np.append(hashes, end), np.append(np.bincount(words, minlength=len(hashes)), len(sizes))
        yield from _deal(_bucket(hashes, buckets), 1, [hashes], (n,))


def _number_words(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Stores each bucket's words: hashes, each one's rank by count, and counts by rank."""
    for bucket, rows in _by_bucket(batches):
        (word,), (n,) = _dealt([p for _, p in rows], 1, (np.int64,))
        (word,), (n,) = _sum_by((word,), (n,))
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        write(folder, f"word-{bucket}.h", word.tobytes())
        write(folder, f"word-{bucket}.rank", rank.tobytes())
        _store_counts(folder, f"tokens-{bucket}", n[order][None])
        yield _note(types=len(word), tokens=int(n.sum()), word=[bucket])


def _numbers(folder: str, hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The numbers of words."""
    out = np.full(len(hashes), _UNKNOWN)
    bucket = _bucket(hashes, buckets)
    order = _order(bucket, hashes)
    for s, e in _runs(bucket[order]):
        some, b = order[s:e], int(bucket[order[s]])
        if (known := mapped(folder, f"word-{b}.h", "uint64", missing=True)) is None:
            continue
        at = np.minimum(np.searchsorted(known, hashes[some]), len(known) - 1)
        there = known[at] == hashes[some]
        out[some[there]] = _number(mapped(folder, f"word-{b}.rank", "uint32")[at[there]], b, buckets)
    return out


def _ids(folder: str, b: _Block, buckets: int) -> np.ndarray:
    """The numbers of a block's distinct tokens, the start first."""
    return np.concatenate([[_START_ID], _numbers(folder, b.hashes[1:], buckets)])


def _count(batches: Iterator[pa.RecordBatch], order: int, folder: str, buckets: int, shares: int) -> Iterator[pa.RecordBatch]:
    for b in _blocks(batches, order, []):
        places, every = _grams(b, order)[-1]
        words = _words(_ids(folder, b, buckets), b, places, order)
        yield from _deal(_home(words, buckets, shares), order, words, (np.bincount(every).astype(np.uint32),))


def _planes(v: np.ndarray) -> bytes:
    """The values' first bytes, then their second ones, and so on: alike bytes stand together."""
    return v.view(np.uint8).reshape(len(v), v.itemsize).T.tobytes()


def _values(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(np.frombuffer(raw, np.uint8).reshape(size, -1).T.tobytes(), kind)


def _order(bucket: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """Rows by bucket, and by the leading bits of minor that one number has room for beside it."""
    if not len(bucket):
        return np.zeros(0, np.int64)
    bits = int(minor.max()).bit_length()
    kept = min(bits, 64 - int(bucket.max()).bit_length())
    return np.argsort((bucket.astype(np.uint64) << np.uint64(kept)) | (minor >> np.uint64(bits - kept)) if kept < 64 else minor)


def _deal(bucket: np.ndarray, kind: int, words: list[np.ndarray], values: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    """A row for each bucket; within it rows are in order of one word, of which the differences are kept."""
    lead = 1 if len(words) > 2 else 0
    order = _order(bucket, words[lead])
    bucket, words, values = bucket[order], [w[order] for w in words], [v[order] for v in values]
    for s, e in _runs(bucket):
        columns = [w[s:e] for w in words]
        columns[lead] = np.diff(columns[lead], prepend=np.uint64(0))
        payload = pack(*map(_planes, columns), *(_planes(v[s:e]) for v in values))
        yield _row(int(bucket[s]), kind, payload)


def _dealt(payloads: list[bytes], size: int, kinds: tuple[type, ...]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(words, values) of rows that were dealt."""
    lead, kinds = 1 if size > 2 else 0, (np.uint64,) * size + kinds
    parts = []
    for p in payloads:
        part = [_values(raw, kind) for raw, kind in zip(unpack(p, *[bytes] * len(kinds)), kinds, strict=True)]
        part[lead] = np.cumsum(part[lead], dtype=np.uint64)
        parts.append(part)
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    return columns[:size], columns[size:]


def _runs(v: np.ndarray) -> list[tuple[int, int]]:
    if not len(v):
        return []
    cuts = np.flatnonzero(v[1:] != v[:-1]) + 1
    return list(zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(v)].tolist(), strict=True))


def _sum_by(keys: tuple[np.ndarray, ...], values: tuple[np.ndarray, ...]) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Each distinct key with its values' sums, in order of the key, of several in order of their hash."""
    by = keys[0] if len(keys) == 1 else _gram(list(keys))
    order = np.argsort(by)
    by = by[order]
    new = np.ones(len(order), bool)
    new[1:] = by[1:] != by[:-1]
    starts = np.flatnonzero(new)
    first = order[starts]
    return tuple(k[first] for k in keys), tuple(np.add.reduceat(v[order].astype(np.int64), starts) if len(starts) else v.astype(np.int64) for v in values)


def _counts_of_counts(n: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(n, 5), minlength=6)[1:5].tolist()


_RARE, _SMALL = 255, 200  # the code of counts that are written out, and what keeps four counts in one number


def _store(folder: str, name: str, hashes: np.ndarray, *counts: np.ndarray) -> None:
    """Sorted hashes and their counts.

    Of a hash the leading bits are told by its place (``.at`` has the start of
    each of their values) and the next 32 are stored.
    """
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    bits = np.uint64(max(1, len(hashes).bit_length() - 4))
    write(folder, f"{name}.h", ((hashes << bits) >> np.uint64(32)).astype(np.uint32).tobytes())
    write(folder, f"{name}.at", np.searchsorted(hashes >> (np.uint64(64) - bits), np.arange((1 << int(bits)) + 1, dtype=np.uint64)).astype(np.uint32).tobytes())
    _store_counts(folder, name, np.stack([n[order] for n in counts]))


def _store_counts(folder: str, name: str, counts: np.ndarray) -> None:
    """A byte for each column of counts: its place among the file's 255 commonest ones, or a sign that ``.rare`` has it."""
    small = (counts < _SMALL).all(axis=0)
    key = np.where(small, (counts * (_SMALL ** np.arange(len(counts), dtype=np.int64))[:, None]).sum(axis=0), -1)
    _, first, every, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    n[~small[first]] = 0
    common = np.argsort(-n, kind="stable")[:_RARE]
    common = common[n[common] > 0]
    code = np.full(len(first), _RARE, np.uint8)
    code[common] = np.arange(len(common))
    code = code[every]
    rare = np.flatnonzero(code == _RARE)
    write(folder, f"{name}.c", code.tobytes())
    write(folder, f"{name}.common", counts[:, first[common]].tobytes())
    write(folder, f"{name}.rare", np.concatenate([rare[None], counts[:, rare]]).astype(np.int64).tobytes())


def _place(known: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of hashes whose leading bits are told by place; all are halved in step."""
    bits = np.uint64((len(starts) - 1).bit_length() - 1)
    lead = (hashes >> (np.uint64(64) - bits)).astype(np.int64)
    tail = ((hashes << bits) >> np.uint64(32)).astype(np.uint32)
    low, end = starts[lead].astype(np.int64), starts[lead + 1].astype(np.int64)
    high = end
    for _ in range(int((end - low).max(initial=0)).bit_length()):
        mid = (low + high) >> 1
        less = (mid < high) & (known[np.minimum(mid, len(known) - 1)] < tail)
        low, high = np.where(less, mid + 1, low), np.where(less, high, mid)
    at = np.minimum(low, len(known) - 1)
    return at, (low < end) & (known[at] == tail)


def _counts_at(folder: str, name: str, at: np.ndarray, counts: int) -> list[np.ndarray]:
    """The counts at places."""
    code = mapped(folder, f"{name}.c", "uint8")[at]
    common = mapped(folder, f"{name}.common", "int64").reshape(counts, -1)
    rare = mapped(folder, f"{name}.rare", "int64").reshape(counts + 1, -1)
    is_rare = np.flatnonzero(code == _RARE)
    places = np.searchsorted(rare[0], at[is_rare])
    out = []
    for i in range(counts):
        n = np.array(common[i][np.minimum(code, common.shape[1] - 1)]) if common.shape[1] else np.zeros(len(at), np.int64)
        n[is_rare] = rare[i + 1][places]
        out.append(n)
    return out


def _fetch(folder: str, name: str, hashes: np.ndarray, counts: int) -> list[np.ndarray]:
    """The counts of hashes, 0 where there is none."""
    known = mapped(folder, f"{name}.h", "uint32")
    out = [np.zeros(len(hashes), np.int64) for _ in range(counts)]
    if not len(known) or not len(hashes):
        return out
    at, there = _place(known, mapped(folder, f"{name}.at", "uint32"), hashes)
    for o, n in zip(out, _counts_at(folder, name, at[there], counts), strict=True):
        o[there] = n
    return out


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    bucket, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            if r["bucket"] != bucket:
                if rows:
                    yield bucket, rows
                bucket, rows = r["bucket"], []
            rows.append((r["kind"], r["payload"]))
    if rows:
        yield bucket, rows


_NOTE = -1


def _row(bucket: int, kind: int, payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([payload], pa.binary())], names=["bucket", "kind", "payload"])


def _note(**what) -> pa.RecordBatch:
    return _row(-1, _NOTE, json.dumps(what).encode())


_CONTEXT = 100  # the kind of rows for contexts of an order, added to the order
_SUMS = (np.int64,) * 4


def _merge(batches: Iterator[pa.RecordBatch], level: int, folder: str, buckets: int, shares: int) -> Iterator[pa.RecordBatch]:
    """Stores the n-grams of an order and yields what lower orders need; other rows pass."""
    whole = level > 2 or shares == 1  # whether all of a context is in one bucket
    for bucket, rows in _by_bucket(batches):
        own = [p for kind, p in rows if kind == level]
        yield from (_row(bucket if kind >= 0 else -1, kind, p) for kind, p in rows if kind != level)
        rows.clear()
        if not own:
            continue
        words, (n,) = _dealt(own, level, (np.uint32,))
        own.clear()
        words, (n,) = _sum_by(tuple(words), (n,))
        _store(folder, f"gram{level}-{bucket}", _gram(list(words)), n)
        (context,), sums = _sum_by((_gram(list(words[:-1])),), (n, n == 1, n == 2, n > 2))
        yield _note(level=level, counts=_counts_of_counts(n), **{f"gram{level}": [bucket]}, **({f"context{level}": [bucket]} if whole else {}))
        if whole:
            _store(folder, f"context{level}-{bucket}", context, *sums)
        else:
            yield from _deal(_bucket(context, buckets), _CONTEXT + level, [context], sums)
        lower, (before,) = _sum_by(tuple(words[1:]), (np.ones(len(n), np.int64),))
        if level > 2:
            yield from _deal(_home(list(lower), buckets, shares), level - 1, list(lower), (before.astype(np.uint32),))
        else:
            yield from _deal(_rank(lower[0], buckets)[0], 1, list(lower), (before,))


def _merge_words(batches: Iterator[pa.RecordBatch], folder: str, buckets: int) -> Iterator[pa.RecordBatch]:
    for bucket, rows in _by_bucket(batches):
        yield from (_row(-1, kind, p) for kind, p in rows if kind == _NOTE)
        for level in sorted({kind for kind, _ in rows if kind > _CONTEXT}):
            (context,), sums = _dealt([p for kind, p in rows if kind == level], 1, _SUMS)
            (context,), sums = _sum_by((context,), tuple(sums))
            _store(folder, f"context{level - _CONTEXT}-{bucket}", context, *sums)
            yield _note(**{f"context{level - _CONTEXT}": [bucket]})
        own = [p for kind, p in rows if kind == 1]
        if own:
            (word,), (n,) = _dealt(own, 1, (np.int64,))
            (word,), (n,) = _sum_by((word,), (n,))
            _store_counts(folder, f"before-{bucket}", n[None])  # every word has one, so a word's place is its rank
            yield _note(words=_counts_of_counts(n), contexts=int(n.sum()), high=int((n > 2).sum()))


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of things seen once to four times."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return min(max(d1, 0.01), 1.0), min(max(d2, 0.01), 2.0), min(max(d3, 0.01), 3.0)


@dataclass(frozen=True)
class Model:
    """Where the arrays are and what holds for all of them."""

    folder: str
    order: int
    buckets: int
    shares: int
    held: dict[str, frozenset[int]]  # the buckets that have arrays, by their name
    tokens: int
    types: int
    continuations: int
    discounts: dict[int, tuple[float, float, float]]  # by order; of words at 1
    word_rest: float  # what the words' discounts leave for the uniform distribution

    def _look(self, kind: str, bucket_of: np.ndarray, hashes: np.ndarray, counts: int) -> list[np.ndarray]:
        out = [np.zeros(len(hashes), np.int64) for _ in range(counts)]
        order = _order(bucket_of, hashes)
        for s, e in _runs(bucket_of[order]):
            some = order[s:e]
            b = int(bucket_of[some[0]])
            if b in self.held.get(kind, ()):
                for o, n in zip(out, _fetch(self.folder, f"{kind}-{b}", hashes[some], counts), strict=True):
                    o[some] = n
        return out

    def log10(self, b: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(base log probability, count in training, model's log probability) of each token but the starts."""
        grams = _grams(b, self.order)
        places, every = grams[0]
        ids = _ids(self.folder, b, self.buckets)
        (word,) = _words(ids, b, places, 1)
        contexts, count = np.zeros((2, len(word)), np.int64)
        known = np.flatnonzero(word != _UNKNOWN)
        bucket, rank = _rank(word[known], self.buckets)
        order = np.lexsort((rank, bucket))
        for s, e in _runs(bucket[order]):
            some, at = known[order[s:e]], rank[order[s:e]]
            for out, name in ((contexts, "before"), (count, "tokens")):
                (out[some],) = _counts_at(self.folder, f"{name}-{bucket[order[s]]}", at, 1)
        base = np.log10((count + 1) / (self.tokens + self.types + 1))
        uniform = 1 / (self.types + 1)
        p = (self._less(contexts, 1) / self.continuations + self.word_rest * uniform) if self.continuations else np.full(len(word), uniform)
        low, at = p, every
        position = np.full(len(b.tokens), -1)
        position[b.tokens != 0] = np.arange(len(every))
        for k in range(2, self.order + 1):
            places, now = grams[k - 1]
            words = _words(ids, b, places, k)
            lower = low[at[position[places]]]  # of the same token with one word less before it
            # A context is the shorter n-gram at the token before, or nothing but starts.
            before, which = grams[k - 2]
            context_words = [np.append(w, _START_ID) for w in _words(ids, b, before, k - 1)]
            context = _gram(context_words)
            whole = k > 2 or self.shares == 1
            home = _home([*context_words, _START_ID], self.buckets, self.shares) if whole else _bucket(context, self.buckets)
            of = np.append(which, len(before))[position[places - 1]]
            total, once, twice, more = (x[of] for x in self._look(f"context{k}", home, context, 4))
            c = np.zeros(len(places), np.int64)
            some = np.flatnonzero(total)
            words = [w[some] for w in words]
            (c[some],) = self._look(f"gram{k}", _home(words, self.buckets, self.shares), _gram(words), 1)
            d1, d2, d3 = self.discounts[k]
            divide = np.maximum(total, 1)
            rest = (d1 * once + d2 * twice + d3 * more) / divide
            low, at = np.where(total > 0, self._less(c, k) / divide + rest * lower, lower), now
        return base[every], count[every], np.log10(low)[at]

    def _less(self, n: np.ndarray, order: int) -> np.ndarray:
        return np.maximum(n - np.choose(np.minimum(n, 3), [0.0, *self.discounts[order]]), 0.0)


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER, share: int = SHARE) -> Model:
    """The model of all rows of docs; null text counts as empty.

    There are as many buckets as the text's bytes ask for, and as many as
    shuffle partitions at least.
    """
    spark = docs.sparkSession
    folder = new_folder(C.shared_dir(spark), "ngram")
    texts = docs.select(F.col(text_col).cast("string").cast("binary").alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    shares = max(1, buckets // share)
    by_bucket = lambda rows: rows.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    words = by_bucket(texts.mapInArrow(lambda it: C.lean(_count_words(it, buckets)), _ROW))
    notes = [json.loads(bytes(r.payload)) for r in words.mapInArrow(lambda it: C.lean(_number_words(it, folder)), _ROW).collect()]
    rows = texts.mapInArrow(lambda it: C.lean(_count(it, order, folder, buckets, shares)), _ROW)
    for level in range(order, 1, -1):
        rows = by_bucket(rows).mapInArrow(lambda it, level=level: C.lean(_merge(it, level, folder, buckets, shares)), _ROW)
    done = by_bucket(rows).mapInArrow(lambda it: C.lean(_merge_words(it, folder, buckets)), _ROW)
    notes += [json.loads(bytes(r.payload)) for r in done.collect()]
    add = lambda k: sum(x.get(k, 0) for x in notes)
    vector = lambda k, some: [sum(x[k][i] for x in some if k in x) for i in range(4)]
    names = [f"{kind}{k}" for kind in ("gram", "context") for k in range(2, order + 1)]
    held = {name: frozenset(b for x in notes for b in x.get(name, ())) for name in names}
    words = vector("words", notes)
    of = {1: discounts(words)} | {k: discounts(vector("counts", [x for x in notes if x.get("level") == k])) for k in range(2, order + 1)}
    d = of[1]
    rest = (d[0] * words[0] + d[1] * words[1] + d[2] * add("high")) / max(1, add("contexts"))
    return Model(folder, order, buckets, shares, held, add("tokens"), add("types"), add("contexts"), of, rest)


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in _blocks(batches, model.order, ["doc_id"]):
        base, count, logs = model.log10(b)
        starts = np.cumsum(b.sizes) - b.sizes
        sums = [np.add.reduceat(x, starts) for x in (base, logs, (count > 0).astype(np.int64))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in b.rows], pa.int64()), pa.array(b.sizes.astype(np.int64)), pa.array(sums[2]), pa.array(sums[0]), pa.array(sums[1])],
            names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
        )


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, n_known, base_score, score)`` for every row of docs.

    Null and empty texts have one token, the end. base_score is the add-one
    unigram's and score the model's log10 probability. Rows with a null or
    repeated id are scored like any other and stay; texts are scored whole,
    however long they are; an empty table gives no rows, and other columns are
    not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(lambda it: C.lean(_score(it, model)), "doc_id long, n_tokens long, n_known long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document scored by a model of those not held out."""
    docs = C.table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    got = score(docs, model)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
