"""Blind re-annotation: what is shown, what is answered, what is merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def answer_label(answer: Column) -> Column:
    """1 or 0, else null: a skip, a quit or something unknown."""
    a = F.lower(F.trim(answer))
    return F.when(a == "1", 1).when(a == "0", 0)


def merge_progress(pairs: DataFrame, progress: DataFrame, overwrite: bool = False) -> DataFrame:
    """Pairs with the labels of ``progress(pair_id, label)``; unknown ids are ignored."""
    merged = pairs.join(progress.select("pair_id", F.col("label").cast("int").alias("_label")), "pair_id", "left")
    first, second = ("_label", "author_label") if overwrite else ("author_label", "_label")
    return merged.withColumn("author_label", F.coalesce(first, second)).select(*pairs.columns)


def unlabelled(pairs: DataFrame, overwrite: bool = False) -> DataFrame:
    return pairs if overwrite else pairs.where("author_label is null")


def remaining(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count_if(F.col("author_label").isNull()).alias("remaining"))


def blind_view(pairs: DataFrame, overwrite: bool = False) -> DataFrame:
    """What the annotator sees: the two queries and the id, no label of any kind."""
    return unlabelled(pairs, overwrite).select("pair_id", "query_1", "query_2")


def apply_answers(pairs: DataFrame, answers: DataFrame, overwrite: bool = False) -> DataFrame:
    """Pairs after a session of ``answers(pair_id, position, answer)``.

    A session ends at its first quit: answers from there on do not count. Of
    several answers to a pair the last one before that does.
    """
    quit_at = answers.where(F.lower(F.trim("answer")) == "q").agg(F.min("position").alias("quit_at"))
    valid = answers.crossJoin(F.broadcast(quit_at)).where("quit_at is null or position < quit_at").withColumn("label", answer_label(F.col("answer"))).where("label is not null")
    last = valid.groupBy("pair_id").agg(F.max_by("label", "position").alias("label"))
    open_ids = unlabelled(pairs, overwrite).select("pair_id")
    return merge_progress(pairs, last.join(open_ids, "pair_id", "left_semi"), overwrite=True)


def session_summary(pairs: DataFrame, answers: DataFrame, overwrite: bool = False) -> DataFrame:
    """One row: total_pairs, already_labeled, newly_labeled, skipped, quit_early."""
    asked = unlabelled(pairs, overwrite).select("pair_id")
    quit_at = answers.where(F.lower(F.trim("answer")) == "q").agg(F.min("position").alias("quit_at"))
    heard = answers.join(asked, "pair_id", "left_semi").crossJoin(F.broadcast(quit_at)).where("quit_at is null or position < quit_at")
    label = answer_label(F.col("answer"))
    counted = heard.agg(F.count_if(label.isNotNull()).alias("newly_labeled"), F.count_if(label.isNull()).alias("skipped"))
    total = pairs.agg(F.count("*").alias("total_pairs"), F.count("author_label").alias("already_labeled"))
    early = quit_at.select(F.col("quit_at").isNotNull().alias("quit_early"))
    return total.crossJoin(counted).crossJoin(early)
