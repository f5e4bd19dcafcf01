"""Row validation of query pairs and of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.columns import blank
from quern.operators.sampling import WORKLOADS


class DatasetError(ValueError):
    """A dataset breaks its schema or its rules."""


def problem() -> Column:
    """The first rule that a pair breaks, or null; labels may come as text."""
    label = lambda c: F.try_to_number(F.col(c).cast("string"), F.lit("S999999999")).cast("int")
    empty = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    return (
        F.when(empty("pair_id"), "pair_id")
        .when(~F.coalesce(F.col("workload").isin(*WORKLOADS), F.lit(False)), "workload")
        .when(empty("source_corpus"), "source_corpus")
        .when(empty("source_pair_id"), "source_pair_id")
        .when(blank(F.col("query_1")), "query_1")
        .when(blank(F.col("query_2")), "query_2")
        .when(~F.coalesce(label("original_label").isin(0, 1), F.lit(False)), "original_label")
        .when(F.col("author_label").isNotNull() & (F.col("author_label").cast("string") != "") & ~F.coalesce(label("author_label").isin(0, 1), F.lit(False)), "author_label")
    )


def violations(pairs: DataFrame) -> DataFrame:
    """``pair_id, problem`` of each invalid pair."""
    return pairs.select("pair_id", problem().alias("problem")).where("problem is not null")


def require(pairs: DataFrame, columns: list[str], where: str) -> None:
    missing = [c for c in columns if c not in pairs.columns]
    if missing:
        raise DatasetError(f"{where}: missing column(s) {', '.join(missing)}")


def strict(pairs: DataFrame, where: str, position: str = "seq", offset: int = 2, unit: str = "") -> DataFrame:
    """The pairs, or an error that names the first invalid one by its place."""
    bad = pairs.withColumn("_problem", problem()).where("_problem is not null").orderBy(position).select(position, "_problem").limit(1).collect()
    if bad:
        n = bad[0][0] + offset
        raise DatasetError(f"{where}:{f'{unit}[{n}]' if unit else n}: invalid {bad[0][1]}")
    return pairs


def request_problem(messages: Column, threshold: Column) -> Column:
    return F.when(F.coalesce(F.size(messages), F.lit(0)) < 1, "messages").when(threshold.isNotNull() & ~threshold.between(0.0, 1.0), "threshold")
