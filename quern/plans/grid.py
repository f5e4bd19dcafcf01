"""The experiment grid: models, workloads and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.columns import config_id
from quern.operators.sampling import WORKLOADS

MODELS = ("all-MiniLM-L6-v2", "modernbert")
THRESHOLDS = tuple(round(0.70 + 0.05 * i, 2) for i in range(5))


def grid(spark: SparkSession, models: tuple[str, ...] = MODELS, workloads: tuple[str, ...] = WORKLOADS, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """``position, config_id, model, workload, threshold``: every combination, models outermost."""
    rows = [(m, w, t) for m in models for w in workloads for t in thresholds]
    cells = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "position int, model string, workload string, threshold double")
    return cells.select("position", config_id(F.col("model"), F.col("workload"), F.col("threshold")).alias("config_id"), "model", "workload", "threshold")


def subset(cells: DataFrame, models: list[str] | None = None, workloads: list[str] | None = None, thresholds: list[float] | None = None) -> DataFrame:
    """The cells that match; an empty grid is an error."""
    for column, wanted in (("model", models), ("workload", workloads)):
        if wanted:
            cells = cells.where(F.col(column).isin(wanted))
    if thresholds:
        cells = cells.where(F.round("threshold", 2).isin([round(t, 2) for t in thresholds]))
    if not cells.limit(1).count():
        raise ValueError("no configuration is left")
    return cells
