"""Helpers that the text and vector operators of this subpackage share.

Everything here is either a Column builder, a plan builder, or the one
streaming helper that turns a key-sorted partition into whole groups.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of glibc; other C libraries hand memory back by themselves.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: The white space that separates words, as a character class body.
GAP = r"\x20\x09-\x0D"
GAP_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, nothing else; a text of ASCII alone takes the faster way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The runs of non-gap characters; an empty array for null or blank text."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(GAP_CHARS))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"[{GAP}]+")))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{GAP}]+")), F.lit(0)).cast("long")


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart also where an id is null or repeats with other text."""
    return F.xxhash64(doc_id, text)


def as_row(docs: DataFrame, but: tuple[str, ...] = ()) -> Column:
    """The given columns as one struct, so that no name of theirs meets one made inside."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in but])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset, as in tests on one machine, a temporary folder is
    made and removed at exit.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
        if found:
            return os.path.dirname(found.rstrip("/"))
        found = tempfile.mkdtemp(prefix="quern-checkpoint-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found


def durable(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, and a plan that reads them there."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def apart(key: Column) -> Column:
    """A long key for an equi-join in which a hot key must be split.

    Below an aggregation by the same key Spark keeps the rows where they are,
    and then cannot split a partition. This key deals both sides anew: one more
    exchange, of the aggregated side.
    """
    return key.bitwiseXOR(F.lit(0x2545F4914F6CDD1D))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is its component's least node.

    Alternating large-star and small-star rounds: each is a map-side combined
    minimum and an equi-join that can be split where a node has many
    neighbours. No list of neighbours is ever gathered, and each round is cut
    off by a checkpoint, so a lost executor costs one round.
    """
    now = durable(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = least.select(apart(F.col("a")).alias("k"), "m")
        large = both.withColumn("k", apart(F.col("a"))).join(least, "k").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.withColumn("k", apart(F.col("a"))).join(low.select(apart(F.col("a")).alias("k"), "m"), "k")
        now = durable(
            small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        )
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (state.n, state.h) == before:
            break
        before = (state.n, state.h)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def blocked(keyed: DataFrame, item: Column, block: int, weight: Column | None = None) -> DataFrame:
    """Rows of ``keyed(k, ...)`` whose key is shared, dealt so that no group is large.

    Keys that one row has fall away. A key with more than ``block`` rows (or
    more than that in all of ``weight``) is cut into parts by a hash of the row; each pair of parts becomes one group
    ``(k, lo, hi)`` of about two blocks at most, and ``part`` tells a row's own
    part. Each pair of rows of a key meets in some group, and nothing is
    dropped.
    """
    shared = keyed.groupBy("k").agg(F.count("*").alias("n_k"), F.sum(F.lit(1) if weight is None else weight).alias("w_k")).where("n_k > 1")
    parts = F.ceil(F.col("w_k") / block).cast("int")
    shared = shared.select(apart(F.col("k")).alias("k_apart"), "w_k")
    dealt = keyed.withColumn("k_apart", apart(F.col("k"))).join(shared, "k_apart").drop("k_apart").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64(item), F.col("parts")).cast("int")).drop("w_k")
    other = F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    return (
        dealt.withColumn("other", other)
        .withColumn("lo", F.least("part", "other"))
        .withColumn("hi", F.greatest("part", "other"))
        .drop("other", "parts")
        .repartition("k", "lo", "hi")
        .sortWithinPartitions("k", "lo", "hi")
    )


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of a key-sorted partition, with each group's first row.

    Holds one batch and the rows of the last, still open group.
    """
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([rest, now]).combine_chunks() if rest is not None else now
        starts = _starts(now, keys)
        cut = int(starts[-1])
        if cut:
            yield now.slice(0, cut), starts[:-1]
        rest = now.slice(cut)
    if rest is not None:
        rest = rest.combine_chunks()
        yield rest, _starts(rest, keys)


def lean(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; when they end, the worker hands free memory back.

    Workers are kept for the next stage, which else pays for what this one
    once held.
    """
    yield from rows
    pa.default_memory_pool().release_unused()
    gc.collect()
    if _TRIM is not None:
        _TRIM(0)


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)
