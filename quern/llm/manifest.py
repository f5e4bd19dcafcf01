"""A Merkle manifest of a dataset: a digest a row, a root a source, a root over all, and a proof a row.

Rows are numbered within their source by a sort that is dealt by range, and cut
into aligned blocks of 3^HEIGHT leaves. Trees grow upwards in passes, one block
of nodes a task, so a pass leaves one node in 729 and the few passes above the
leaves are small. Then authentication paths go down again: each pass gives every
node of a block the path up to the root, and the last pass gives it to rows.

Within a block the paths come from a fractal traversal. The block's tree is a
stack of subtrees of ``SPAN`` levels. For every level of the stack the traversal
keeps the *existing* subtree, which the current leaf's path runs through, and
the *desired* one to its right, which grows by a few leaves a step and takes over
when the path moves on. So successive paths come out in order, and of the
block's nodes only those of two small subtrees a level are held, whatever the
number of leaves. The path above the block is the same for all its leaves: it
is made once, by the pass above, and appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import common as C

#: Children of a node, levels of a block, levels of a subtree.
ARITY, HEIGHT, SPAN = 3, 6, 2
BLOCK = ARITY**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: A path: for each level the place in the run, and the digests of the others there.
Path = list[tuple[int, list[bytes]]]


def joined(digests: list[bytes]) -> bytes:
    """The digest of digests, which are concatenated as hexadecimal text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def fold(digest: bytes, path: Path) -> bytes:
    for place, others in path:
        digest = joined([*others[:place], digest, *others[place:]])
    return digest


def levels(n: int) -> int:
    """The levels above n leaves."""
    up = 0
    while n > 1:
        n, up = -(-n // ARITY), up + 1
    return up


class Grown:
    """A node that grows from leaves one after the other; holds at most two nodes a level."""

    def __init__(self, leaf: Callable[[int], bytes], n: int, level: int, index: int):
        self.leaf, self.level = leaf, level
        self.at = index * ARITY**level
        self.end = min(n, self.at + ARITY**level)
        self.open: list[list[bytes]] = [[] for _ in range(level + 1)]

    def step(self, leaves: int) -> bool:
        """Takes in some leaves; whether the node is done."""
        for _ in range(leaves):
            if self.at >= self.end:
                break
            self._put(0, self.leaf(self.at))
            self.at += 1
        return self.at >= self.end

    def _put(self, level: int, digest: bytes) -> None:
        self.open[level].append(digest)
        if level < self.level and len(self.open[level]) == ARITY:
            run, self.open[level] = self.open[level], []
            self._put(level + 1, joined(run))

    def digest(self) -> bytes:
        """The node, with runs that the leaves' end cut short."""
        self.step(self.end - self.at)
        for level in range(self.level):
            if self.open[level]:
                run, self.open[level] = self.open[level], []
                self._put(level + 1, joined(run))
        return self.open[self.level][0]


class Subtree:
    """Levels ``low`` to ``high`` of the tree below node ``index`` of level ``high``; grows leaf by leaf, then answers."""

    def __init__(self, leaf: Callable[[int], bytes], n: int, low: int, high: int, index: int):
        self.leaf, self.n, self.low, self.high, self.index = leaf, n, low, high, index
        width = ARITY ** (high - low)
        self.first = index * width
        self.last = min(self.first + width, -(-n // ARITY**low))
        self.rows: list[list[bytes]] = [[]]
        self.now: Grown | None = None

    def step(self, leaves: int) -> None:
        """Grows by some leaves' worth of work."""
        while leaves > 0 and self.first + len(self.rows[0]) < self.last:
            if self.now is None:
                self.now = Grown(self.leaf, self.n, self.low, self.first + len(self.rows[0]))
            before = self.now.at
            if self.now.step(leaves):
                leaves -= self.now.at - before
                self.rows[0].append(self.now.digest())
                self.now = None
            else:
                return

    def finish(self) -> Subtree:
        self.step(self.n)
        while len(self.rows) <= self.high - self.low:
            below = self.rows[-1]
            self.rows.append([joined(below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
        return self

    def root(self) -> bytes:
        return self.rows[-1][0]

    def path(self, node: int) -> Path:
        """The path from a node of the lowest level to the root of the subtree."""
        out, at = [], node - self.first
        for row in self.rows[:-1]:
            run = at - at % ARITY
            out.append((at % ARITY, [*row[run:at], *row[at + 1 : run + ARITY]]))
            at //= ARITY
        return out


def traverse(leaf: Callable[[int], bytes], n: int, height: int, span: int = SPAN) -> Iterator[Path]:
    """The paths of leaves 0 to n - 1 of a tree of ``height`` levels, in order, by fractal traversal."""
    if not height:
        yield from ([] for _ in range(n))
        return
    cuts = [*range(0, height, span), height]
    stack = list(zip(cuts[:-1], cuts[1:], strict=True))
    existing = [Subtree(leaf, n, low, high, 0).finish() for low, high in stack]
    # The uppermost level of the stack has one subtree, so nothing is desired there.
    desired: list[Subtree | None] = [Subtree(leaf, n, low, high, 1) if ARITY**high < n else None for low, high in stack[:-1]]
    for i in range(n):
        for s, (low, high) in enumerate(stack[:-1]):
            wide = ARITY**high
            if i and i % wide == 0:
                existing[s] = desired[s].finish()
                right = i // wide + 1
                desired[s] = Subtree(leaf, n, low, high, right) if right * wide < n else None
            if desired[s] is not None:
                desired[s].step(1)  # as many leaves in all as the subtree has until its turn
        yield [step for (low, _), tree in zip(stack, existing, strict=True) for step in tree.path(i // ARITY**low)]


def block_root(digests: list[bytes], height: int) -> bytes:
    """The node ``height`` levels above a block's leaves, holding two nodes a level at most."""
    return Grown(digests.__getitem__, len(digests), height, 0).digest()


def packed(path: Path) -> bytes:
    """A byte for the place and one for the number of the others, then these, level by level."""
    return b"".join(bytes((place, len(others))) + b"".join(others) for place, others in path)


def unpacked(data: bytes) -> Path:
    out, at = [], 0
    while at < len(data):
        place, n = data[at], data[at + 1]
        out.append((place, [data[at + 2 + 32 * i : at + 34 + 32 * i] for i in range(n)]))
        at += 2 + 32 * n
    return out


# -- columns ----------------------------------------------------------------


def _part(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The digest of a row: each value as the length of its UTF-8 bytes, a colon and the bytes; ``-`` for null."""
    return F.unhex(F.sha2(F.concat(*[_part(v) for v in values]), 256))


def _tree_key(source: Column) -> Column:
    """Sorts as sources do, with null first, and is never null."""
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("s"), source))


def _numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``pos``, each row's place within its ``tree`` in ``order``, and ``n_tree``, the rows of the tree.

    Dealt by ranges of tree and order, so a tree of a third of all rows is cut
    into many ranges; only the counts of a tree by range are summed up.
    """
    here = nodes.withColumn("tie", F.monotonically_increasing_id())
    ranged = C.durable(here.repartitionByRange("tree", *order, "tie").sortWithinPartitions("tree", *order, "tie").drop("tie"))
    ranged = ranged.withColumn("row", F.monotonically_increasing_id()).withColumn("range", F.shiftright("row", 33))
    counts = ranged.groupBy("tree", "range").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("tree", "range", (before - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("n_tree"))
    return C.durable(ranged.join(starts, ["tree", "range"]).withColumn("pos", F.col("row") + F.col("shift")).drop("row", "range", "shift"))


# -- passes -----------------------------------------------------------------


def _height(n_tree: int) -> int:
    """Levels that the blocks of a tree of so many nodes have: all of them, unless one block is the tree."""
    return HEIGHT if n_tree > BLOCK else levels(n_tree)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The tables of one block each."""
    for t, starts in C.whole_groups(batches, ["tree", "block"]):
        for s, e in zip(starts, [*starts[1:], t.num_rows], strict=True):
            yield t.slice(int(s), int(e - s))


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"tree": pa.string(), "pos": pa.int64(), "n_tree": pa.int64(), "digest": pa.binary()}
    out: list[tuple] = []
    for t in _groups(batches):
        n = t.column("n_tree")[0].as_py()
        out.append((t.column("tree")[0].as_py(), t.column("block")[0].as_py(), -(-n // BLOCK), block_root(t.column("digest").to_pylist(), _height(n))))
        if len(out) >= BLOCK:
            yield _batch(out, kinds)
            out = []
    if out:
        yield _batch(out, kinds)


def _in_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """All passes' nodes ``(tree, pos, n_tree, digest)`` from the leaves on, and the trees' roots.

    A tree that is done before others keeps its root through their passes.
    """
    passes = [nodes]
    block = F.floor(F.col("pos") / BLOCK).alias("block")
    while True:
        up = C.durable(_in_blocks(passes[-1].select("tree", block, "pos", "n_tree", "digest")).mapInArrow(lambda it: C.lean(_roots(it)), "tree string, pos long, n_tree long, digest binary"))
        if (up.agg(F.max("n_tree")).first()[0] or 1) <= 1:
            return passes, up
        passes.append(up)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(tree, pos, name, path)`` of every node: its own path in the block, then that of the block, which the first row has."""
    kinds = {"tree": pa.string(), "pos": pa.int64(), "name": pa.string(), "path": pa.binary()}
    for t in _groups(batches):
        upper, names = t.column("path")[0].as_py(), t.column("name").to_pylist()[1:]
        tree, pos, n, digests = t.column("tree")[0].as_py(), t.column("pos").to_pylist()[1:], t.column("n_tree")[1].as_py(), t.column("digest").to_pylist()[1:]
        walk = traverse(digests.__getitem__, len(digests), _height(n))
        yield _batch([(tree, p, name, packed(path) + upper) for p, name, path in zip(pos, names, walk, strict=True)], kinds)


def descend(passes: list[DataFrame], heads: DataFrame) -> DataFrame:
    """``(tree, pos, name, path)`` of the nodes of the lowest pass; ``heads(tree, path)``: the path of each tree's root."""
    heads = heads.select("tree", F.lit(0).cast("long").alias("pos"), "path")
    for nodes in reversed(passes):
        name = F.col("name") if "name" in nodes.columns else F.lit(None).cast("string")
        rows = nodes.select("tree", F.floor(F.col("pos") / BLOCK).alias("block"), "pos", "n_tree", "digest", name.alias("name"), F.lit(None).cast("binary").alias("path"))
        first = heads.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("long").alias("n_tree"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("string").alias("name"), "path")
        heads = _in_blocks(rows.unionByName(first)).mapInArrow(lambda it: C.lean(_paths(it)), "tree string, pos long, name string, path binary")
    return heads


ROWS = "doc_id long, leaf binary, subroot binary, root binary, proof_sha256 string, folded_root binary, path binary"


def _rows(batches: Iterator[pa.RecordBatch], keep_path: bool) -> Iterator[pa.RecordBatch]:
    """The manifest's row of every leaf: its path, and the root that its claimed digest folds to."""
    kinds = {"doc_id": pa.int64(), "leaf": pa.binary(), "subroot": pa.binary(), "root": pa.binary(), "proof_sha256": pa.string(), "folded_root": pa.binary(), "path": pa.binary()}
    for t in _groups(batches):
        head = {c: t.column(c)[0].as_py() for c in ("path", "subroot", "root")}
        upper = unpacked(head["path"])
        above = "".join(d.hex() for _, others in upper for d in others)
        ids, digests, claimed = (t.column(c).to_pylist()[1:] for c in ("doc_id", "digest", "claimed"))
        tops: dict[bytes, bytes] = {}  # a block's honest leaves all fold to the same node
        node = None
        out = []
        for i, path in enumerate(traverse(digests.__getitem__, len(digests), _height(t.column("n_tree")[1].as_py()))):
            own = "".join(d.hex() for _, others in path for d in others)
            node = fold(digests[i] if claimed[i] is None else claimed[i], path)
            if node not in tops:
                if len(tops) > 1:  # others are each their own
                    tops.popitem()
                tops[node] = fold(node, upper)
            out.append((ids[i], digests[i], head["subroot"], head["root"], hashlib.sha256((own + above).encode()).hexdigest(), tops[node], packed(path) + head["path"] if keep_path else None))
        yield _batch(out, kinds)


def manifest(docs: DataFrame, claimed: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", keep_path: bool = True) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, path)`` for every row of docs; digests are binary.

    ``claimed`` has columns that stand in for some of the fields: of them the
    leaf is made that folds along the original path to ``folded_root``. It equals
    ``root`` where nothing differs. ``path`` is the proof itself (see ``unpacked``;
    ``fold`` checks it).

    Rows stand by id within their source, null ids first, rows of one id by
    their leaf; wholly equal rows each have a leaf and a path of their own.
    Sources stand in the order of their bytes, null (a source of its own) first.
    Null fields count as ``-`` and differ from empty ones. Texts count whole. A
    row alone in its source is its subroot, and a source alone is the root. An
    empty table gives no rows. Columns not named in ``fields`` are not read.
    """
    claims = leaf(*[(claimed or {}).get(c, F.col(c)) for c in fields])
    rows = docs.select(_tree_key(F.col(source_col).cast("string")).alias("tree"), F.col(id_col).cast("long").alias("doc_id"), leaf(*[F.col(c) for c in fields]).alias("digest"), (claims if claimed else F.lit(None).cast("binary")).alias("claimed"))
    rows = rows.withColumn("claimed", F.when(F.col("claimed") != F.col("digest"), F.col("claimed")))
    # Written first: dealing by range reads its input twice, and this is the only reading of the texts.
    leaves = _numbered(C.durable(rows), ["doc_id", "digest"])
    passes, subroots = climb(leaves)
    named = _numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    top, roots = climb(named)
    root = C.durable(descend(top, roots.select("tree", F.lit(b"").alias("path"))).select(F.col("name").alias("tree"), "path"))
    whole = roots.select(F.col("digest").alias("root"))  # one row
    heads = descend(passes[1:], root).select("tree", F.col("pos").alias("block"), "path") if len(passes) > 1 else root.select("tree", F.lit(0).cast("long").alias("block"), "path")
    first = heads.join(subroots.select("tree", F.col("digest").alias("subroot")), "tree").join(F.broadcast(whole), F.lit(True))
    first = first.select("tree", "block", F.lit(-1).cast("long").alias("pos"), "path", "subroot", "root")
    below = leaves.withColumn("block", F.floor(F.col("pos") / BLOCK))
    dealt = _in_blocks(below.unionByName(first, allowMissingColumns=True))
    return dealt.mapInArrow(lambda it: C.lean(_rows(it, keep_path)), ROWS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: every document's proof, and whether the document as found still folds to the root."""
    docs = C.table(spark, sf_dir, "documents")
    found = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = manifest(docs, {"text": found}, keep_path=False)
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    return got.select("doc_id", hexed("leaf"), hexed("subroot"), hexed("root"), "proof_sha256", hexed("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_leaf(text: str) -> str:
    parts = [("CAST(doc_id AS VARCHAR)"), "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({p}) AS VARCHAR) || ':' || {p}, '-')" for p in parts) + ")"


# The table-free CRC-32 of a decimal number, bit by bit.
_CRC = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(1 AS BIGINT), 1, 1, 1, 1, 1, 1, 1]), lambda d, e: xor(d >> 1, (d & 1) * 3988292384)))"

SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, coalesce('s' || source, '') AS tree, {_sql_leaf("text")} AS leaf,
    CASE WHEN xor({_CRC}, 4294967295) % 2 = 0 THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf("text")} END AS claimed
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n, row_number() OVER () AS row FROM leaves),
nodes AS (
  SELECT tree, 0 AS lvl, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT tree, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, lvl, pos // 3, n),
subroots AS (SELECT tree, h AS subroot, lvl AS height, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
uppers AS (
  SELECT 0 AS lvl, pos, n, subroot AS h FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM uppers WHERE n > 1 GROUP BY lvl, pos // 3, n),
steps AS (
  SELECT p.row, k.lvl, (p.pos // CAST(pow(3, k.lvl) AS BIGINT)) AS own, k.pos, k.h FROM placed p JOIN nodes k ON k.tree = p.tree AND k.n > 1 AND k.pos // 3 = p.pos // CAST(pow(3, k.lvl + 1) AS BIGINT)
  UNION ALL
  SELECT p.row, s.height + u.lvl, s.pos // CAST(pow(3, u.lvl) AS BIGINT), u.pos, u.h FROM placed p JOIN subroots s ON s.tree = p.tree JOIN uppers u ON u.n > 1 AND u.pos // 3 = s.pos // CAST(pow(3, u.lvl + 1) AS BIGINT)),
proofs AS (
  SELECT row, lvl, coalesce(string_agg(h, '' ORDER BY pos) FILTER (pos < own), '') AS before, coalesce(string_agg(h, '' ORDER BY pos) FILTER (pos > own), '') AS after FROM steps GROUP BY row, lvl),
digested AS (SELECT row, sha256(string_agg(before || after, '' ORDER BY lvl)) AS proof_sha256, max(lvl) + 1 AS height FROM proofs GROUP BY row),
folded AS (
  SELECT p.row, 0 AS lvl, p.claimed AS h FROM placed p
  UNION ALL
  SELECT f.row, f.lvl + 1, sha256(q.before || f.h || q.after) FROM folded f JOIN proofs q ON q.row = f.row AND q.lvl = f.lvl)
SELECT p.doc_id, p.leaf, s.subroot, r.h AS root, coalesce(d.proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM placed p JOIN subroots s ON s.tree = p.tree CROSS JOIN (SELECT h FROM uppers WHERE n = 1) r LEFT JOIN digested d ON d.row = p.row JOIN folded f ON f.row = p.row AND f.lvl = coalesce(d.height, 0)
"""
