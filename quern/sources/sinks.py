"""Files that results leave in: datasets, experiment results, reports, logs."""

from __future__ import annotations

import csv
import json
import textwrap
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.sources.datasets import COLUMNS

# The columns of the two result files.
RESULT_COLUMNS = [
    "config_id",
    "model",
    "workload",
    "threshold",
    "n",
    "tp",
    "fp",
    "tn",
    "fn",
    "precision",
    "recall",
    "f0_5",
    "fpr",
    "hit_rate",
    "precision_zero_div",
    "recall_zero_div",
    "fpr_zero_div",
]
DECISION_COLUMNS = [
    "config_id",
    "model",
    "workload",
    "threshold",
    "pair_id",
    "decision",
    "source",
    "similarity",
    "label",
    "outcome",
]


def _fixed(c: str, digits: int) -> Column:
    return F.when(F.col(c).isNull(), "").otherwise(F.format_string(f"%.{digits}f", F.col(c).cast("double"))).alias(c)


def result_rows(evaluated: DataFrame) -> DataFrame:
    """Evaluations as text, in the result file's columns."""
    form = {"threshold": _fixed("threshold", 2)} | {c: _fixed(c, 6) for c in ("precision", "recall", "f0_5", "fpr", "hit_rate")} | {c: F.initcap(F.col(c).cast("string")).alias(c) for c in RESULT_COLUMNS[-3:]}
    return evaluated.select(*[form.get(c, F.col(c).cast("string").alias(c)) for c in RESULT_COLUMNS])


def decision_rows(decisions: DataFrame) -> DataFrame:
    form = {"threshold": _fixed("threshold", 2), "similarity": _fixed("similarity", 6)}
    return decisions.select(*[form.get(c, F.col(c).cast("string").alias(c)) for c in DECISION_COLUMNS])


def _metadata() -> Column:
    """A map as JSON with its keys in order."""
    entries = F.map_from_entries(F.array_sort(F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>")))))
    return F.to_json(entries).alias("metadata")


def pair_rows(pairs: DataFrame) -> DataFrame:
    return pairs.select(*COLUMNS[:6], F.col("original_label").cast("string").alias("original_label"), F.coalesce(F.col("author_label").cast("string"), F.lit("")).alias("author_label"), _metadata(), "seq")


def save_csv(pairs: DataFrame, path: str) -> None:
    """Pairs in order as CSV part files with a header, for data of any size."""
    rows = pair_rows(pairs).repartitionByRange("seq").sortWithinPartitions("seq").drop("seq")
    rows.write.mode("overwrite").options(header=True, escape='"', emptyValue="", nullValue="").csv(path)


def save_json(pairs: DataFrame, path: str) -> None:
    rows = pairs.repartitionByRange("seq").sortWithinPartitions("seq").select(*COLUMNS)
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def _write(path: str, text: str) -> None:
    with _opened(path) as f:
        f.write(text)


def _opened(path: str):
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    return open(path, "w", encoding="utf-8", newline="")


def _csv_file(rows: DataFrame, columns: list[str], path: str, order: list[str]) -> None:
    """One CSV file in order; the driver holds a partition at a time."""
    with _opened(path) as f:
        writer = csv.writer(f)
        writer.writerow(columns)
        for r in rows.orderBy(*order).toLocalIterator():
            writer.writerow([r[c] for c in columns])


def export_csv(pairs: DataFrame, path: str) -> None:
    """Pairs as a single CSV file."""
    _csv_file(pair_rows(pairs), COLUMNS, path, ["seq"])


def export_json(pairs: DataFrame, path: str) -> None:
    """Pairs as a single JSON list, indented; the driver holds a partition at a time."""
    with _opened(path) as f:
        between = "["
        for r in pairs.orderBy("seq").toLocalIterator():
            row = {c: (r[c] or {}) if c == "metadata" else r[c] for c in COLUMNS}
            f.write(f"{between}\n" + textwrap.indent(json.dumps(row, indent=2, ensure_ascii=False), "  "))
            between = ","
        f.write("[]\n" if between == "[" else "\n]\n")


def export_dataset(pairs: DataFrame, csv_path: str, json_path: str) -> None:
    held = pairs.persist()
    export_csv(held, csv_path)
    export_json(held, json_path)
    held.unpersist()


def write_results(evaluated: DataFrame, path: str, order: list[str]) -> None:
    """results.csv; without times, so equal runs give equal bytes."""
    _csv_file(result_rows(evaluated), RESULT_COLUMNS, path, order)


def write_decisions(decisions: DataFrame, path: str, order: list[str]) -> None:
    _csv_file(decision_rows(decisions), DECISION_COLUMNS, path, order)


def write_run_meta(path: str, dataset: str, provider: str, grid: list[dict], identities: dict, elapsed: float) -> None:
    """What may differ between equal runs, kept apart from the results."""
    meta = {
        "dataset_path": dataset,
        "llm_provider": "mock",
        "embedding_provider": provider,
        "n_configurations": len(grid),
        "grid": grid,
        "model_identities": identities,
        "latency": {"total_elapsed_seconds": elapsed, "note": "The backend is simulated; this is no measurement of a provider."},
    }
    _write(path, json.dumps(meta, indent=2) + "\n")


def write_kappa(report: DataFrame, path: str) -> None:
    fields = ("n_annotated", "n_excluded", "observed_agreement", "expected_agreement", "kappa")
    form = lambda r: {k: r[k] for k in fields} | {"confusion": {k: r[k] for k in ("tp", "fp", "fn", "tn")}}
    rows = {r["scope"]: form(r) for r in report.collect()}
    _write(path, json.dumps({"overall": rows.pop("overall", None), "per_workload": dict(sorted(rows.items()))}, indent=2) + "\n")


def append_log(records: DataFrame, path: str) -> None:
    """Log records as text, a JSON object a line."""
    records.select(F.col("record").alias("value")).write.mode("append").text(path)


def save_progress(progress: DataFrame, path: str) -> None:
    """A progress file: a JSON map in order of ids."""
    rows = {r.pair_id: r.label for r in progress.orderBy("pair_id").toLocalIterator()}
    _write(path, json.dumps(rows, indent=2, sort_keys=True))
