"""Candidate pairs from public corpora, in one form: workload, source_corpus, source_pair_id, query_1, query_2, label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.operators.validation import require

_CSV = {"header": True, "escape": '"', "multiLine": True}
CANDIDATES = "workload string, source_corpus string, source_pair_id string, query_1 string, query_2 string, label int"


def _candidates(rows: DataFrame, workload: str, name: str, ident: str, first: str, second: str, label: str, skip_empty: bool) -> DataFrame:
    out = rows.select(
        F.lit(workload).alias("workload"), F.lit(name).alias("source_corpus"), F.col(ident).cast("string").alias("source_pair_id"), F.col(first).alias("query_1"), F.col(second).alias("query_2"), F.col(label).cast("int").alias("label")
    )
    return out.where("coalesce(query_1, '') <> '' and coalesce(query_2, '') <> ''") if skip_empty else out


def question_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated question pairs; rows with an empty question are left out."""
    rows = spark.read.options(**_CSV, sep="\t").csv(path)
    require(rows, ["id", "question1", "question2", "is_duplicate"], path)
    return _candidates(rows, "faq", "quora-qqp", "id", "question1", "question2", "is_duplicate", True)


def duplicate_questions(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated duplicate questions; rows with an empty question are left out."""
    rows = spark.read.options(**_CSV).csv(path)
    require(rows, ["pair_id", "question1", "question2", "is_duplicate"], path)
    return _candidates(rows, "code", "stackoverflow-duplicates", "pair_id", "question1", "question2", "is_duplicate", True)


def utterance_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of utterance pairs; empty ones stay and fail validation later."""
    rows = spark.read.option("multiLine", True).json(path)
    require(rows, ["pair_id", "utterance_1", "utterance_2", "same_intent"], path)
    return _candidates(rows, "chat", "convai2", "pair_id", "utterance_1", "utterance_2", "same_intent", False)


def synthetic(spark: SparkSession, workload: str, n: int = 40, seed: int = 0) -> DataFrame:
    """n generated pairs, every second one labelled 1, the same for the same seed."""
    suffix = (F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(9000)) + 1000).cast("string")
    return spark.range(n).select(
        F.lit(workload).alias("workload"), F.lit("synthetic").alias("source_corpus"), F.format_string("mock-%s-%04d", F.lit(workload), F.col("id")).alias("source_pair_id"),
        F.concat(F.lit(f"{workload} question "), suffix).alias("query_1"), F.concat(F.when(F.col("id") % 2 == 1, F.lit(f"{workload} question again ")).otherwise(F.lit("another matter ")), suffix).alias("query_2"), (F.col("id") % 2).cast("int").alias("label"),
    )


class CandidateSource(DataSource):
    """``spark.read.format("candidates")``: generated pairs as a data source, dealt over ``partitions``."""

    @classmethod
    def name(cls) -> str:
        return "candidates"

    def schema(self) -> str:
        return CANDIDATES

    def reader(self, schema):  # noqa: ANN001, ANN201
        return _CandidateReader(self.options)


class _Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _CandidateReader(DataSourceReader):
    def __init__(self, options):  # noqa: ANN001
        self.workload = options.get("workload", "faq")
        self.n, self.seed, self.parts = (int(options.get(k, d)) for k, d in (("n", 40), ("seed", 0), ("partitions", 4)))

    def partitions(self):  # noqa: ANN201
        step = -(-self.n // self.parts) or 1
        return [_Range(i, min(self.n, i + step)) for i in range(0, self.n, step)]

    def read(self, partition):  # noqa: ANN001, ANN201
        import random

        for i in range(partition.start, partition.end):
            n = random.Random(f"{self.seed}:{i}").randint(1000, 9999)
            yield self.workload, "synthetic", f"mock-{self.workload}-{i:04d}", f"{self.workload} question {n}", f"{self.workload} question again {n}" if i % 2 else f"another matter {n}", i % 2
