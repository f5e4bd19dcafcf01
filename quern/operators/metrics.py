"""Confusion counts, rates and cache counters as conditional aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.columns import ratio
from quern.operators.replay import EXACT, SEMANTIC

RATES = ("precision", "recall", "f0_5", "fpr", "hit_rate")


class SanityError(ValueError):
    """Counts of a configuration do not add up, or a rate lies outside [0, 1]."""


def _long(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")


def confusion(decisions: DataFrame, *by: str) -> DataFrame:
    """``n, tp, fp, tn, fn`` for each group of ``by``."""
    count = lambda x: _long(F.col("outcome") == x)
    return decisions.groupBy(*by).agg(F.count("*").alias("n"), count("TP").alias("tp"), count("FP").alias("fp"), count("TN").alias("tn"), count("FN").alias("fn"))


def rates(counts: DataFrame) -> DataFrame:
    """The counts with rates and flags; a rate with denominator 0 is 0.0 and flagged."""
    c = {k: F.col(k) for k in ("n", "tp", "fp", "tn", "fn")}
    out = counts.withColumns(
        {
            "precision": ratio(c["tp"], c["tp"] + c["fp"]),
            "recall": ratio(c["tp"], c["tp"] + c["fn"]),
            "fpr": ratio(c["fp"], c["fp"] + c["tn"]),
            "hit_rate": ratio(c["tp"] + c["fp"], c["n"]),
            "precision_zero_div": c["tp"] + c["fp"] == 0,
            "recall_zero_div": c["tp"] + c["fn"] == 0,
            "fpr_zero_div": c["fp"] + c["tn"] == 0,
        }
    )
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f0_5", F.when(p + r == 0, 0.0).otherwise(1.25 * p * r / (0.25 * p + r)))


def sanity_violations(evaluated: DataFrame) -> DataFrame:
    """Rows whose counts do not sum to n or that have a rate outside [0, 1]."""
    bad = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn") != F.col("n")
    for name in RATES:
        bad = bad | ~F.coalesce(F.col(name).between(0.0, 1.0), F.lit(False))
    return evaluated.where(bad)


def check_sanity(evaluated: DataFrame) -> DataFrame:
    found = sanity_violations(evaluated).select("config_id").limit(5).collect()
    if found:
        raise SanityError("inconsistent counts or rates in " + ", ".join(r.config_id for r in found))
    return evaluated


def evaluate(decisions: DataFrame) -> DataFrame:
    """One row a configuration: counts, rates, flags."""
    return rates(confusion(decisions, "config_id", "model", "workload", "threshold"))


def counters(requests: DataFrame, *by: str) -> DataFrame:
    """Totals of ``requests(source, tokens, latency_ms)``; failed requests (null source) are left out."""
    done = requests.where("source is not null")
    hit = F.col("source") != "llm"
    return done.groupBy(*by).agg(
        F.count("*").alias("total_requests"),
        _long(F.col("source") == EXACT).alias("exact_hits"),
        _long(F.col("source") == SEMANTIC).alias("semantic_hits"),
        _long(~hit).alias("misses"),
        F.coalesce(F.sum(F.when(hit, F.col("tokens"))), F.lit(0)).cast("long").alias("tokens_saved"),
        F.coalesce(F.sum("latency_ms"), F.lit(0.0)).alias("latency_sum_ms"),
    )


def snapshot(totals: DataFrame) -> DataFrame:
    """Totals with the mean latency and the hit rate in per cent; 0 where nothing was asked."""
    n = F.col("total_requests")
    hits = F.col("exact_hits") + F.col("semantic_hits")
    return totals.withColumn("avg_latency_ms", ratio(F.col("latency_sum_ms"), n)).withColumn("hit_rate_pct", ratio(100.0 * hits, n))


def summary(snap: DataFrame) -> DataFrame:
    """A line of text for each snapshot row."""
    return snap.withColumn(
        "summary",
        F.format_string("requests=%d exact=%d semantic=%d misses=%d hit_rate=%.1f%% tokens_saved=%d avg_latency_ms=%.1f", "total_requests", "exact_hits", "semantic_hits", "misses", "hit_rate_pct", "tokens_saved", "avg_latency_ms"),
    )


def roll_up(totals: DataFrame, *keys: str) -> DataFrame:
    """Totals over all levels of keys; the mean comes from sums, not from means, and hit_rate is a fraction."""
    summed = totals.rollup(*keys).agg(*[F.sum(c).alias(c) for c in ("total_requests", "exact_hits", "semantic_hits", "misses", "tokens_saved", "latency_sum_ms")], *[F.grouping(k).cast("int").alias(f"all_{k}") for k in keys])
    n = F.col("total_requests")
    return summed.withColumn("avg_latency_ms", ratio(F.col("latency_sum_ms"), n)).withColumn("hit_rate", ratio(F.col("exact_hits") + F.col("semantic_hits"), n))


def entry_counts(store: DataFrame, *by: str) -> DataFrame:
    """Entries by the model that embedded them ('unknown' without one)."""
    return store.groupBy(*by, F.coalesce("canonical_name", F.lit("unknown")).alias("canonical_name")).agg(F.count("*").alias("entries"))


def model_breakdown(store: DataFrame, *by: str) -> DataFrame:
    """The entries of the exact store by model, as one map, and the size of the semantic index.

    ``store`` has ``canonical_name``, ``in_exact`` and ``in_semantic``: an entry
    that the exact store has dropped may still be in the index.
    """
    per = store.groupBy(*by, F.coalesce("canonical_name", F.lit("unknown")).alias("canonical_name")).agg(_long(F.col("in_exact")).alias("entries"), _long(F.col("in_semantic")).alias("indexed"))
    listed = F.filter(F.sort_array(F.collect_list(F.struct("canonical_name", "entries"))), lambda e: e["entries"] > 0)
    return per.groupBy(*by).agg(F.map_from_entries(listed).alias("model_breakdown"), F.sum("indexed").alias("index_size"))


def held(stored: DataFrame, cap: int | None, semantic: bool, by: tuple[str, ...] = ("config",)) -> DataFrame:
    """``stored(seq, key, ...)`` with ``in_exact`` (whether the first-in-first-out store still has it) and ``in_semantic``.

    Of a key stored again only the last counts, and of these the last ``cap``.
    """
    newest = stored.groupBy(*by, "key").agg(F.max("seq").alias("seq"))
    if cap is not None:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("seq")))
        newest = newest.withColumn("_place", place).where(F.col("_place") <= max(1, cap)).drop("_place")
    kept = newest.select(*by, "seq", F.lit(True).alias("in_exact"))
    return stored.join(kept, [*by, "seq"], "left").withColumns({"in_exact": F.coalesce("in_exact", F.lit(False)), "in_semantic": F.lit(semantic)})


def clear_report(store: DataFrame, *by: str) -> DataFrame:
    """What a clear of each pool key removes; ``store`` has ``in_exact`` and ``in_semantic``."""
    return store.groupBy(*by).agg(_long(F.col("in_exact")).alias("exact_entries"), _long(F.col("in_semantic")).alias("semantic_entries"))
