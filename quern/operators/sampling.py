"""Seeded stratified sampling without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORKLOADS = ("faq", "code", "chat")


class ShortfallError(ValueError):
    """A stratum has fewer candidates than the sample needs."""


def seeded(seed: int, ident: Column) -> Column:
    """A hash that orders rows in a way that only the seed and their id decide."""
    return F.md5(F.concat(F.lit(f"{seed}:"), ident.cast("string")))


def wanted(n: int, ratio: float) -> tuple[int, int]:
    """Positives and negatives of a sample of n; halves round to even."""
    positive = round(n * ratio)
    return positive, n - positive


def stratified(candidates: DataFrame, n: int, seed: int = 42, ratio: float = 0.5, by: str = "workload") -> DataFrame:
    """n candidates of each group with the asked share of label 1, numbered in a seeded order.

    Anything but label 1 counts as negative. ``candidates``: the group, a
    source_pair_id, label and more. Raises where a group has too few of either.
    The candidates of a stratum that cannot be chosen leave before any order
    is made: only hashes below a bound found by counting are ranked.
    """
    positive, negative = wanted(n, ratio)
    rows = candidates.withColumn("stratum", (F.col("label") == 1).cast("int")).withColumn("stratum", F.coalesce("stratum", F.lit(0))).withColumn("_h", seeded(seed, F.col("source_pair_id")))
    have = {(r[by], r["stratum"]): r["count"] for r in rows.groupBy(by, "stratum").count().collect()}
    for group in {g for g, _ in have}:
        for stratum, need in ((1, positive), (0, negative)):
            if have.get((group, stratum), 0) < need:
                raise ShortfallError(f"{group}: {need} rows with label {stratum} asked for, {have.get((group, stratum), 0)} there")
    need = F.when(F.col("stratum") == 1, positive).otherwise(negative)
    prefix = F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")  # of 4096 bins
    bins = rows.groupBy(by, "stratum", prefix.alias("_bin")).count()
    upto = F.sum("count").over(Window.partitionBy(by, "stratum").orderBy("_bin"))
    bound = bins.withColumn("_upto", upto).where(F.col("_upto") - F.col("count") < need).groupBy(by, "stratum").agg(F.max("_bin").alias("_most"))
    few = rows.withColumn("_bin", prefix).join(F.broadcast(bound), [by, "stratum"]).where("_bin <= _most")
    rank = F.row_number().over(Window.partitionBy(by, "stratum").orderBy("_h", "source_pair_id"))
    chosen = few.withColumn("_rank", rank).where(F.col("_rank") <= need)
    order = F.row_number().over(Window.partitionBy(by).orderBy(F.md5(F.concat(F.lit("order:"), "_h")), "source_pair_id"))
    numbered = chosen.withColumn("position", order - 1)
    return numbered.withColumn("pair_id", F.format_string("%s-%04d", F.col(by), F.col("position"))).drop("stratum", "_h", "_bin", "_most", "_rank")


def sample_dataset(sources: dict[str, DataFrame], n: int = 300, seed: int = 42, ratio: float = 0.5) -> DataFrame:
    """One sample over the sources of all workloads; each must be there and hold its own workload."""
    missing = [w for w in WORKLOADS if w not in sources]
    if missing:
        raise ShortfallError(f"no source for {', '.join(missing)}")
    every = None
    for w in WORKLOADS:
        if sources[w].where(F.col("workload") != w).limit(1).count():
            raise ShortfallError(f"the source for {w} holds other workloads")
        every = sources[w] if every is None else every.unionByName(sources[w])
    order = F.element_at(F.create_map(*[x for i, w in enumerate(WORKLOADS) for x in (F.lit(w), F.lit(i))]), F.col("workload"))
    got = stratified(every, n, seed, ratio)
    return got.select(
        "pair_id", "workload", "source_corpus", "source_pair_id", "query_1", "query_2", F.col("label").alias("original_label"), F.lit(None).cast("int").alias("author_label"), F.create_map().cast("map<string,string>").alias("metadata"), (order * 1_000_000_000 + F.col("position")).cast("long").alias("seq"),
    )
