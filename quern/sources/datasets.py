"""Query-pair datasets from CSV and JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.validation import DatasetError, require, strict

COLUMNS = ["pair_id", "workload", "source_corpus", "source_pair_id", "query_1", "query_2", "original_label", "author_label", "metadata"]
SCHEMA = "pair_id string, workload string, source_corpus string, source_pair_id string, query_1 string, query_2 string, original_label int, author_label int, metadata map<string,string>, seq long"
_CSV = {"header": True, "escape": '"', "multiLine": True, "enforceSchema": False}


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows numbered from 0 as they stand in their file.

    Pair files are read whole by one task (their records may span lines), so
    the task's own numbering is the file's order.
    """
    return rows.withColumn("seq", F.monotonically_increasing_id())


def _strict_metadata(rows: DataFrame, path: str, offset: int = 2, unit: str = "") -> None:
    """An error that names the first row whose metadata is no JSON object; empty counts as none."""
    text = F.col("metadata")
    kept = F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"})
    wrong = text.isNotNull() & (text != "") & (kept.isNull() | F.try_parse_json(text).isNull() | ~text.rlike(r"^\s*\{"))
    bad = rows.where(wrong).orderBy("seq").select("seq").limit(1).collect()
    if bad:
        n = bad[0].seq + offset
        raise DatasetError(f"{path}:{f'{unit}[{n}]' if unit else n}: invalid metadata")


def _typed(rows: DataFrame) -> DataFrame:
    number = lambda c: F.expr(f"try_cast({c} as int)").alias(c)
    metadata = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return rows.select(*COLUMNS[:6], number("original_label"), number("author_label"), metadata.alias("metadata"), "seq")


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of a CSV file with ``seq``; extra columns are ignored, errors name the line."""
    text = spark.read.options(**_CSV).csv(path)
    require(text, COLUMNS, path)
    rows = _ordered(text.select(*COLUMNS))
    strict(rows, path)
    _strict_metadata(rows, path)
    return _typed(rows)


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of a JSON file that is a list of objects; errors name the item."""
    first = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim("value"), 1, 1).alias("c")).limit(1).collect()
    if not first or first[0].c != "[":
        raise DatasetError(f"{path}: not a list")
    fields = ", ".join(f"{c} string" for c in COLUMNS)
    rows = _ordered(spark.read.schema(fields).option("multiLine", True).option("primitivesAsString", True).json(path))
    strict(rows, path, offset=0, unit="item")
    _strict_metadata(rows, path, offset=0, unit="item")
    return _typed(rows)


def load(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".csv"):
        return load_csv(spark, path)
    if path.endswith(".json"):
        return load_json(spark, path)
    raise DatasetError(f"{path}: neither .csv nor .json")


def load_progress(spark: SparkSession, path: str) -> DataFrame:
    """``(pair_id, label)`` from a progress file, a JSON map; a missing file is empty."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "pair_id string, label int")
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,int>")).alias("pair_id", "label"))


def from_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of a request log, one JSON object a line, by arrival."""
    from quern.operators.serving import LOG_SCHEMA

    rows = spark.read.schema(LOG_SCHEMA).json(path)
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("embedding_model", "threshold").orderBy("arrival_ts", "request_id")))

