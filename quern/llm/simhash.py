"""SimHash near-duplicates through an inverted index on byte positions.

A fingerprint has eight bytes. Two that differ in at most four bits differ in
at most four bytes, so they share at least four of the eight (position, byte)
entries: the guaranteed minimum of the count filter. (At this bound the filter is
implied by the verification and refuses nothing by itself: what it gives is the
guarantee by which lists are chosen.) A list for one
(position, byte) holds 1/256 of a corpus, too many to pair, so lists are keyed
by three positional bytes at once: ``TRIPLES`` is a set of 20 position triples
of which every four positions contain one whole. Pairs within a list are
tallied (positional bytes in common), kept if the tally reaches the minimum,
and verified by their differing bits. Where three bytes no longer tell enough
fingerprints apart, lists are keyed by all 70 sets of four: either way every
pair within reach meets, and a list's length by chance stays bounded.

Only distinct fingerprints are indexed, so copies cost one entry. Lists are
worked through in blocks of bounded size, and what leaves a block is a star of
links for each group found, never its pairs.

The pipeline stage fingerprints sets of five-word shingles and gathers
candidates by the same index with a wider bound of its own: at most six
differing bits, so at least two shared bytes, and lists for all 28 pairs of
positions. At a Jaccard similarity of 0.8 fingerprints differ in some ten bits;
what lies beyond the bound is gathered by bands of min-hashes beside it. Every
candidate, of either kind, is checked by its sets (``alike``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common as C

POSITIONS, MIN_SHARED, MAX_BITS = 8, 4, 4
_PARTS = ((0, 1, 2), (3, 4, 5), (6, 7))
#: Triples inside a part, and two positions of a part with one of the next.
TRIPLES = tuple(
    sorted(
        {t for p in _PARTS for t in combinations(p, 3)}
        | {tuple(sorted((*two, one))) for i, p in enumerate(_PARTS) for two in combinations(p, 2) for one in _PARTS[(i + 1) % 3]}
    )
)
FOURS = tuple(combinations(range(POSITIONS), MIN_SHARED))
#: Distinct fingerprints up to which lists are keyed by three bytes: some dozens a list by chance.
MANY = 1 << 29
#: The stage's bound: so many bits differ at most, so two bytes are shared at least, and some list has both.
STAGE_BITS, STAGE_SHARED = 6, 2
TWOS = tuple(combinations(range(POSITIONS), STAGE_SHARED))
BLOCK = 4096
_CHUNK, _ROWS = 1 << 15, 512
#: The stage: words a shingle, least Jaccard similarity (a fraction), bands of min-hashes and hashes a band.
#: A pair at 0.8 shares a band with a chance of 1 - (1 - 0.8^5)^20 = 0.9996, one at 0.85 with 0.99999.
STAGE_SHINGLE, ALIKE, BANDS, BAND_ROWS = 5, (4, 5), 20, 5
#: Shingles of a block of sets, each set counting as ``SET_WEIGHT`` more.
BLOCK_SHINGLES, SET_WEIGHT = 1 << 21, 512
#: Keys of candidates (32 bytes each) up to which they are sent to all tasks instead of the texts to them.
FEW_KEYS = 1 << 20


def _majority(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each row's fingerprint: the majority of each bit over its hashes, zero where it has none."""
    ones = np.zeros((len(sizes), 64), dtype=np.int64)
    owner, flat = np.repeat(np.arange(len(sizes)), sizes), flat.view(np.uint8).reshape(-1, 8)
    for at in range(0, len(flat), _CHUNK):
        own = owner[at : at + _CHUNK]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        bits = np.unpackbits(flat[at : at + _CHUNK], axis=1, bitorder="little")
        ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.int64).ravel()


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The majority of each bit over a row's hashes, some rows at a time."""
    for b in (x.slice(at, _ROWS) for x in batches for at in range(0, x.num_rows, _ROWS)):
        lists = b.column("hashes")
        value = _majority(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False), np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), pa.array(value, pa.int64())], names=["doc_id", "row_key", "fp"])


def _shingles(text: Column, shingle: int) -> Column:
    """The hashes of a text's shingles; a shorter text is one, and one without words has none."""

    def hashed(w):
        run = F.transform(F.sequence(F.lit(0), F.size(w) - shingle), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + j) for j in range(shingle)])))
        return (
            F.when(F.size(w) == 0, F.array().cast("array<bigint>"))
            .when(F.size(w) < shingle, F.array(F.xxhash64(F.array_join(w, " "))))
            .otherwise(run)
        )

    return C.let(C.words(C.ascii_lower(text)), hashed)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``(doc_id, row_key, fp)`` for every row of ``docs``, fp as a signed long.

    Shingles are hashed by Spark's own XXH64 (seed 42); null text counts as
    empty, and a text without words has fingerprint zero.
    """
    ident, text = F.col(id_col).cast("long"), F.col(text_col)
    rows = docs.select(ident.alias("doc_id"), C.row_key(ident, text).alias("row_key"), _shingles(text, shingle).alias("hashes"))
    return rows.mapInArrow(lambda it: C.lean(_fold(it)), "doc_id long, row_key long, fp long")


def _close(v: np.ndarray, others: np.ndarray, least: int = MIN_SHARED, bits: int = MAX_BITS) -> np.ndarray:
    """Which of others share enough positional bytes with v and differ in few bits."""
    differ = others ^ v
    shared = (differ.view(np.uint8).reshape(-1, POSITIONS) == 0).sum(axis=1)
    return (shared >= least) & (np.bitwise_count(differ) <= bits)


def _stars(batches: Iterator[pa.RecordBatch], least: int, bits: int) -> Iterator[pa.RecordBatch]:
    for t, starts in C.whole_groups(batches, ["k", "lo", "hi"]):
        fp = t.column("fp").to_numpy().view(np.uint64)
        a, b = [], []
        for s, e in zip(starts, [*starts[1:], t.num_rows], strict=True):
            left = fp[s:e]
            while len(left) > 1:
                root, left = left[0], left[1:]
                queue = [root]
                while queue and len(left):
                    hit = _close(queue.pop(), left, least, bits)
                    if hit.any():
                        new, left = left[hit], left[~hit]
                        queue.extend(new)
                        a.extend(new.tolist())
                        b.extend([int(root)] * len(new))
        yield pa.RecordBatch.from_arrays([pa.array(np.array(x, dtype=np.uint64).view(np.int64), pa.int64()) for x in (a, b)], names=["a", "b"])


def links(fps: DataFrame, sets: tuple[tuple[int, ...], ...] = TRIPLES, block: int = BLOCK, least: int = MIN_SHARED, bits: int = MAX_BITS) -> DataFrame:
    """Links ``(a, b)`` that join exactly the distinct ``fp`` within reach of each other.

    Within reach are those that share ``least`` bytes and differ in at most
    ``bits`` bits; ``sets`` has one within every ``least`` positions.
    """

    def key(n: int, positions: tuple[int, ...]) -> Column:
        out = F.lit(n)
        for p in positions:
            out = F.shiftleft(out.cast("long"), 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)))
        return out

    posting = F.explode(F.array(*[key(n, s) for n, s in enumerate(sets)]))
    return C.blocked(fps.select("fp", posting.alias("k")), F.col("fp"), block).select("k", "lo", "hi", "fp").mapInArrow(lambda it: C.lean(_stars(it, least, bits)), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``(doc_id, row_key, fp, root, component_id)`` for every row of ``docs``.

    component_id is the least doc_id reachable by links. Repeated rows stay
    repeated. Rows with a null id are linked like others but name a component
    only if it has no other id (then null). An empty table gives no rows. Texts
    count whole, however long they are; of ties the least id names a component.
    """
    rows = C.durable(fingerprints(docs, id_col, text_col, shingle))
    classes = C.durable(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    joined = C.components(links(classes.select("fp"), TRIPLES if classes.count() <= MANY else FOURS))
    rooted = classes.join(joined, classes.fp == joined.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    names = names.select(C.apart(F.col("root")).alias("k"), "component_id")
    named = C.durable(rooted.withColumn("k", C.apart(F.col("root"))).join(names, "k").select(F.col("fp").alias("fp_"), "root", "component_id"))
    return rows.join(named, rows.fp == named.fp_).drop("fp_")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: fingerprint and component of every document."""
    got = near_duplicates(C.table(spark, sf_dir, "documents"))
    return got.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def _sets(lists: pa.ListArray) -> list[np.ndarray]:
    """Each row's distinct hashes in order."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)
    ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64))
    return [np.unique(flat[s:e]) for s, e in zip(np.r_[0, ends[:-1]], ends, strict=True)]


def _bands(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``BANDS`` keys for each set, none of them empty."""
    rng = np.random.default_rng(42)
    salt, odd, mix = (rng.integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1) for _ in range(3))
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    keys = np.zeros((len(sets), BANDS), np.uint64)
    for i in range(BANDS * BAND_ROWS):
        least = np.minimum.reduceat((flat ^ salt[i]) * odd[i], starts)
        keys[:, i // BAND_ROWS] += (least ^ least >> np.uint64(31)) * mix[i]
    return keys


def _prints(sets: list[np.ndarray]) -> np.ndarray:
    """The fingerprints of sets."""
    return _majority(np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.array([len(s) for s in sets], np.int64))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their set's digest (``cls``, zero for the empty set), fingerprint and bands."""
    import xxhash

    for b in (x.slice(at, _ROWS) for x in batches for at in range(0, x.num_rows, _ROWS)):
        sets = _sets(b.column("hashes"))
        cls = np.array([xxhash.xxh3_64_intdigest(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
        full = [i for i, s in enumerate(sets) if len(s)]
        bands: list[np.ndarray | None] = [None] * len(sets)
        if full:
            for i, keys in zip(full, _bands([sets[i] for i in full]).view(np.int64), strict=True):
                bands[i] = keys
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), pa.array(cls), pa.array(_prints(sets)), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "row_key", "cls", "fp", "bands"])


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (x.slice(at, _ROWS) for x in batches for at in range(0, x.num_rows, _ROWS)):
        sets = [s.view(np.int64) for s in _sets(b.column("hashes"))]
        bands = _bands([s.view(np.uint64) for s in sets]).view(np.int64) if sets else []
        columns = [b.column("k"), b.column("cls"), pa.array(_prints(sets)), pa.array(list(bands), pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int64())), pa.array([len(s) for s in sets], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["k", "cls", "fp", "bands", "hashes", "n"])


def _group(sets: list[np.ndarray], fps: np.ndarray, bands: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that join exactly the sets that are candidates and alike; each pair of candidates is measured by its elements.

    Candidates have fingerprints within reach of each other, or share a band.
    """
    part, whole = ALIKE
    sizes = np.array([len(s) for s in sets])
    left = np.arange(len(sets))
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            v = queue.pop()
            own = sets[v]
            fits = (whole * np.minimum(sizes[left], len(own)) >= part * np.maximum(sizes[left], len(own))) & (_close(fps[v], fps[left], STAGE_SHARED, STAGE_BITS) | (bands[left] == bands[v]).any(axis=1))
            near = np.flatnonzero(fits)
            if not len(near):
                continue
            flat = np.concatenate([sets[i] for i in left[near]])
            inside = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            both = np.add.reduceat(inside, np.r_[0, np.cumsum(sizes[left[near]])[:-1]], dtype=np.int64)
            near = near[whole * both >= part * (sizes[left[near]] + len(own) - both)]
            new = left[near]
            left = np.delete(left, near)
            queue.extend(new)
            yield from ((int(i), int(root)) for i in new)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, starts in C.whole_groups(batches, ["k", "lo", "hi"]):
        cls, fps = t.column("cls").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
        a, b = [], []
        for s, e in zip(starts, [*starts[1:], t.num_rows], strict=True):
            some = t.slice(s, e - s).combine_chunks()
            hashes, bands = (some.column(c).combine_chunks() for c in ("hashes", "bands"))
            sizes = np.cumsum(np.asarray(hashes.value_lengths()).astype(np.int64))
            flat = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)  # sorted as such
            for i, j in _group(np.split(flat, sizes[:-1]), fps[s:e], bands.flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)):
                a.append(cls[s + i])
                b.append(cls[s + j])
        yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in (a, b)], names=["a", "b"])


def candidates(classes: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that join the ``cls`` of ``classes(cls, fp, bands)`` that may be alike.

    By fingerprints through the index of byte positions, and by a shared band
    where those lie beyond its bound. The empty set (no bands) joins nothing.
    """
    full = classes.where("bands is not null")
    prints = full.groupBy("fp").agg(F.min("cls").alias("first"))
    near = links(prints.select("fp"), TWOS, least=STAGE_SHARED, bits=STAGE_BITS).distinct()
    of = lambda side: prints.select(F.col("fp").alias(side), F.col("first").alias(f"{side}_cls"))
    near = near.join(of("a"), "a").join(of("b"), "b").select(F.col("a_cls").alias("a"), F.col("b_cls").alias("b"))
    # A fingerprint that several classes have is one key more beside their bands.
    keys = F.concat("bands", F.array("fp"))
    posting = full.select("cls", F.posexplode(keys).alias("band", "key")).select("cls", F.xxhash64("band", "key").alias("k"))
    lists = posting.groupBy("k").agg(F.min("cls").alias("b"), F.count("*").alias("n")).where("n > 1").select(C.apart(F.col("k")).alias("k"), "b")
    met = posting.withColumn("k", C.apart(F.col("k"))).join(lists, "k").select(F.col("cls").alias("a"), "b")
    return near.unionByName(met)


def alike(docs: DataFrame, shingle: int = STAGE_SHINGLE, block: int = BLOCK_SHINGLES) -> DataFrame:
    """``(first, root)`` for every distinct shingle set of ``docs``: its least row, and the component it belongs to.

    Links are pairs with a Jaccard similarity of 0.8 or more, found by their
    fingerprints or a shared band and checked by their sets. Candidates are
    first joined into components (``candidates``), so that a set travels once (or once a block of a large one).
    """
    ident, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    keyed = docs.select(ident.alias("doc_id"), C.row_key(ident, text).alias("row_key"), text.alias("text"))
    signed = keyed.select("doc_id", "row_key", _shingles(F.col("text"), shingle).alias("hashes")).mapInArrow(lambda it: C.lean(_signed(it)), "doc_id long, row_key long, cls long, fp long, bands array<long>")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
    classes = C.durable(signed.groupBy("cls").agg(first, F.min("fp").alias("fp"), F.min("bands").alias("bands")))
    groups = C.components(candidates(classes)).select(F.col("node").alias("cls"), F.col("root").alias("k"))
    members = C.durable(classes.join(groups, "cls").select("k", "cls", F.col("first.row_key").alias("row_key"), F.col("first.doc_id").alias("id")))
    few = F.broadcast(members) if members.count() <= FEW_KEYS else members
    # Of wholly equal rows one is enough.
    texts = keyed.join(few, (keyed["row_key"] == few["row_key"]) & keyed["doc_id"].eqNullSafe(few["id"])).select("k", "cls", _shingles(F.col("text"), shingle).alias("hashes"))
    made = texts.mapInArrow(lambda it: C.lean(_distinct(it)), "k long, cls long, fp long, bands array<long>, hashes array<long>, n long")
    sets = C.durable(made.dropDuplicates(["cls"]))
    dealt = C.blocked(sets, F.col("cls"), block, F.col("n") + SET_WEIGHT).select("k", "lo", "hi", "cls", "fp", "bands", "hashes")
    joined = C.components(dealt.mapInArrow(lambda it: C.lean(_alike(it)), "a long, b long"))
    return classes.join(joined, classes.cls == joined.node, "left").select("first", F.coalesce("root", "cls").alias("root"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of ``alike`` the row with the least id stays.

    Ids compare with nulls last, then by the row's hash; of wholly equal rows
    one stays. The columns are those of ``docs``.
    """
    kept = alike(docs).groupBy("root").agg(F.min("first").alias("s")).select("s.row_key", F.col("s.doc_id").alias("id"))
    ident = F.col("doc_id").cast("long")
    keyed = docs.select(C.as_row(docs).alias("row"), C.row_key(ident, F.col("text")).alias("row_key"), ident.alias("own"))
    found = keyed.join(kept, (keyed["row_key"] == kept["row_key"]) & keyed["own"].eqNullSafe(kept["id"]), "left_semi")
    return found.dropDuplicates(["row_key", "own"]).select("row.*")
