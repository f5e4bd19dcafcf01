"""What operators share that work in several steps: rows written between steps, and places in an order."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder is made for a session of one machine;
    on a cluster that is an error, since executors would not find it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    found = spark.sparkContext.getCheckpointDir()
    if found:
        return os.path.dirname(found.rstrip("/"))
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    found = tempfile.mkdtemp(prefix="quern-checkpoint-")
    atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found


def durable(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, and a plan that reads them there."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, folder: str) -> bool:
    path, files = _path(spark, folder)
    return files.exists(path)


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared one, removed when the session ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    path, files = _path(spark, folder)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def few(df: DataFrame, n: int, most: int = 10_000) -> DataFrame:
    """A side of a join of n narrow rows: sent to all tasks up to ``most`` of them."""
    return F.broadcast(df) if n <= most else df


def numbered(rows: DataFrame, by: str, *order: str, name: str = "pos") -> DataFrame:
    """``rows`` with each row's place within its ``by`` in ``order``, from 0; equal rows stand in any order.

    Rows are dealt by ranges, so one value of ``by``, or of ``order`` too, may
    hold any part of them; only counts by range are summed up. ``rows`` should
    be cheap to read, as dealing by range reads them twice.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = durable(tied.repartitionByRange(by, *order, "_tie").sortWithinPartitions(by, *order, "_tie").drop("_tie"))
    ranged = ranged.withColumn("_row", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_row", 33))
    counts = ranged.groupBy(by, "_range").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(by, "_range", (before - F.col("_first")).alias("_shift"))
    return ranged.join(starts, [by, "_range"]).withColumn(name, F.col("_row") + F.col("_shift")).drop("_row", "_range", "_shift")


def filled(rows: DataFrame, by: str, *order: str, value: str, name: str, ahead: bool = False) -> DataFrame:
    """``rows`` with ``name``: the last ``value`` that is not null up to a row, or with ``ahead`` the first from it on.

    Along ``order`` within ``by``. As in ``numbered``, one value of ``by`` may hold
    any part of the rows: each range is filled by itself, and only what
    a range hands on to the others is put in order as a whole.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = durable(tied.repartitionByRange(by, *order, "_tie").sortWithinPartitions(by, *order, "_tie").drop("_tie"))
    ranged = ranged.withColumn("_row", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_row", 33))
    # Ahead is back along the turned order: a frame that grows is summed up once, one that shrinks would be read anew for each row.
    along = (lambda c: F.desc(c)) if ahead else (lambda c: F.asc(c))
    inside = Window.partitionBy(by, "_range").orderBy(along("_row")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy(by).orderBy(along("_range")).rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col(value).isNotNull(), F.col("_row"))
    own, handed = F.last(value, ignorenulls=True).over(inside), F.last("_edge", ignorenulls=True).over(across)
    edge = F.min_by(value, known) if ahead else F.max_by(value, known)
    edges = ranged.groupBy(by, "_range").agg(edge.alias("_edge")).select(by, "_range", handed.alias("_handed"))
    return ranged.withColumn("_own", own).join(edges, [by, "_range"]).withColumn(name, F.coalesce("_own", "_handed")).drop("_row", "_range", "_own", "_handed")
