"""Agreement of two annotators: contingency and Cohen's kappa."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.columns import is_close


def contingency(pairs: DataFrame, *by: str, first: str = "original_label", second: str = "author_label") -> DataFrame:
    """``tp, fp, fn, tn, n_annotated, n_excluded``; rows without a second label are only counted as excluded."""
    a, b = F.col(first), F.col(second)
    count = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0)).cast("long")
    return pairs.groupBy(*by).agg(
        count((a == 1) & (b == 1)).alias("tp"),
        count((a != 1) & (b == 1)).alias("fp"),
        count((a == 1) & (b != 1)).alias("fn"),
        count((a != 1) & (b != 1)).alias("tn"),
        count(b.isNotNull()).alias("n_annotated"),
        count(b.isNull()).alias("n_excluded"),
    )


def kappa(counts: DataFrame) -> DataFrame:
    """Observed and expected agreement and kappa; all null without annotated rows."""
    n = F.col("n_annotated").cast("double")
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    some = F.col("n_annotated") > 0
    observed = F.when(some, (tp + tn) / n)
    expected = F.when(some, ((tp + fp) / n) * ((tp + fn) / n) + ((fn + tn) / n) * ((fp + tn) / n))
    with_agreement = counts.withColumn("observed_agreement", observed).withColumn("expected_agreement", expected)
    po, pe = F.col("observed_agreement"), F.col("expected_agreement")
    degenerate = F.when(is_close(po, 1.0), 1.0).otherwise(0.0)
    return with_agreement.withColumn("kappa", F.when(pe.isNull(), None).when(is_close(pe, 1.0), degenerate).otherwise((po - pe) / F.when(pe == 1, None).otherwise(1 - pe)))


def kappa_report(pairs: DataFrame, groups: list[str], by: str = "workload") -> DataFrame:
    """Kappa overall (scope 'overall') and for each of groups, also those without rows."""
    per = contingency(pairs, by).withColumnRenamed(by, "scope")
    whole = contingency(pairs).withColumn("scope", F.lit("overall"))
    scopes = pairs.sparkSession.createDataFrame([(g,) for g in groups], "scope string")
    counts = ["tp", "fp", "fn", "tn", "n_annotated", "n_excluded"]
    listed = scopes.join(per, "scope", "left").select("scope", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])
    return kappa(listed.unionByName(whole.select("scope", *counts)))


def strict_gate(report: DataFrame, threshold: float) -> DataFrame:
    """``failed`` only for a fully annotated scope whose kappa is null or below threshold."""
    low = F.coalesce(F.col("kappa") < threshold, F.lit(True))
    return report.withColumn("failed", (F.col("n_excluded") == 0) & low)
