import hashlib
import weakref
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.llm import manifest as M


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def grow(nodes):
    """All levels of a tree."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def steps(tree, i):
    """(before, after) of the path of node i, level by level."""
    for level in tree[:-1]:
        run = i - i % 3
        yield level[run:i], level[i + 1 : run + 3]
        i //= 3


def row_leaf(r, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)])


def plain(rows):
    """The manifest by whole trees in memory; rows are dicts."""
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, row_leaf(r, r["text"]), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: grow([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    top = grow([trees[s][-1][0] for s in sources])
    out = []
    for at, s in enumerate(sources):
        for i, (_, _, leaf, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            path = [*steps(trees[s], i), *steps(top, at)]
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
            h = row_leaf(r, r["text"].replace("\n", "")) if tampered else leaf
            for before, after in path:
                h = H(*before, h, *after)
            out.append((r["doc_id"], leaf, trees[s][-1][0], top[-1][0], H(*[x for before, after in path for x in (*before, *after)]), h, h == top[-1][0]))
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


def got(spark, df, tmp_path):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, M.query(spark, str(tmp_path)).collect()), key=key)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 80, 82, 200])
@pytest.mark.parametrize("span", [1, 2, 3])
def test_paths_in_order_as_from_the_whole_tree(n, span):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    tree = grow([x.hex() for x in leaves])
    paths = list(M.traverse(leaves.__getitem__, n, M.levels(n), span))
    for i, path in enumerate(paths):
        assert [([d.hex() for d in others[:place]], [d.hex() for d in others[place:]]) for place, others in path] == list(steps(tree, i))
        assert M.fold(leaves[i], path).hex() == tree[-1][0]
        assert M.unpacked(M.packed(path)) == path
    assert M.block_root(leaves, M.levels(n)).hex() == tree[-1][0]


def test_a_tall_block_of_few_leaves_ends_in_single_nodes():
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(4)]
    root = M.block_root(leaves, 6)
    assert all(M.fold(leaves[i], p) == root and len(p) == 6 for i, p in enumerate(M.traverse(leaves.__getitem__, 4, 6)))


def test_the_traversal_holds_two_small_subtrees_a_level(monkeypatch):
    n, most, alive = 3**8, 0, weakref.WeakSet()
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    first = M.Subtree.__init__

    def noted(self, *args):
        first(self, *args)
        alive.add(self)

    monkeypatch.setattr(M.Subtree, "__init__", noted)
    for i, _ in enumerate(M.traverse(leaves.__getitem__, n, 8)):
        if i % 50 == 0:
            most = max(most, sum(len(row) for t in alive for row in t.rows))
    assert 0 < most <= 2 * 4 * (9 + 3 + 1)


def test_many_blocks_and_many_sources(spark, tmp_path):
    rows = [{"doc_id": i, "source": "hot", "lang": "en", "n_chars": i, "text": f"line {i}\nand more"} for i in range(1600)]
    rows += [{"doc_id": 5000 + i, "source": f"s{i}é" if i % 2 else f"S{i}", "lang": None, "n_chars": None, "text": f"t{i}" if i % 3 else "\n"} for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert got(spark, df, tmp_path) == sorted(plain(rows), key=key)


def test_every_kind_of_row(spark, dirty, nothing, tmp_path):
    extra = dirty.withColumns({c: F.lit(c) for c in ("tree", "pos", "row", "range", "n_tree", "digest", "claimed", "tie", "first", "shift", "path", "name", "block")})
    rows = [r.asDict() for r in dirty.collect()]
    assert got(spark, extra, tmp_path / "a") == sorted(plain(rows), key=key)
    assert got(spark, nothing, tmp_path / "b") == []
    one = dirty.where("doc_id = 8")
    alone = got(spark, one, tmp_path / "c")
    assert len(alone) == 1 and alone[0][1] == alone[0][2] == alone[0][3] and alone[0][4] == H("")


def test_proofs_are_whole_and_a_changed_row_fails_them(spark, docs):
    rows = M.manifest(docs, {"text": F.concat("text", F.when(F.col("doc_id") == 17, "!").otherwise(""))}).collect()
    assert {r.doc_id for r in rows if r.folded_root != r.root} == {17}
    for r in rows:
        path = M.unpacked(bytes(r.path))
        assert M.fold(bytes(r.leaf), path) == bytes(r.root)
        assert H(*[d.hex() for _, others in path for d in others]) == r.proof_sha256


def test_any_dealing_of_the_rows_gives_the_same(spark, docs):
    a, b = (sorted(map(tuple, M.manifest(docs.repartition(n)).collect())) for n in (1, 7))
    assert a == b


def test_agrees_with_sql(spark, sf001):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf001}/documents.parquet'")
    df = M.query(spark, sf001)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({M.SQL})").fetchall())
    assert {r.verified for r in df.collect()} == {True, False}
