import pytest
from pyspark.sql import functions as F

from quern.operators import agreement, metrics


def rated(spark, tp, fp, tn, fn, n=None):
    row = [("m|faq|0.70", n if n is not None else tp + fp + tn + fn, tp, fp, tn, fn)]
    return metrics.rates(spark.createDataFrame(row, "config_id string, n long, tp long, fp long, tn long, fn long"))


def test_rates(spark):
    r = rated(spark, 8, 2, 7, 3).first()
    assert (r.precision, r.recall, r.f0_5, r.fpr, r.hit_rate) == pytest.approx((0.8, 8 / 11, 0.7843137254901961, 2 / 9, 0.5))
    assert not (r.precision_zero_div or r.recall_zero_div or r.fpr_zero_div)


def test_zero_denominators_are_zero_and_flagged(spark):
    r = rated(spark, 0, 0, 10, 5).first()
    assert r.precision == 0 and r.precision_zero_div and not r.recall_zero_div
    r = rated(spark, 0, 0, 0, 0).first()
    assert (r.precision, r.recall, r.f0_5, r.fpr, r.hit_rate) == (0, 0, 0, 0, 0)
    assert r.precision_zero_div and r.recall_zero_div and r.fpr_zero_div


def test_sanity_names_the_configuration(spark):
    assert metrics.sanity_violations(rated(spark, 8, 2, 7, 3)).count() == 0
    with pytest.raises(metrics.SanityError, match="m\\|faq\\|0.70"):
        metrics.check_sanity(rated(spark, 8, 2, 7, 3, n=99))


def test_counters_leave_failed_requests_out(spark):
    rows = [("exact_cache", 5, 1.0), ("semantic_cache", 7, 3.0), ("llm", 9, 8.0), (None, 100, 100.0)]
    snap = metrics.summary(metrics.snapshot(metrics.counters(spark.createDataFrame(rows, "source string, tokens long, latency_ms double")))).first()
    assert (snap.total_requests, snap.exact_hits, snap.semantic_hits, snap.misses, snap.tokens_saved) == (3, 1, 1, 1, 12)
    assert snap.avg_latency_ms == pytest.approx(4.0) and "hit_rate=66.7%" in snap.summary


def test_counters_of_nothing(spark):
    snap = metrics.snapshot(metrics.counters(spark.createDataFrame([], "source string, tokens long, latency_ms double"))).first()
    assert (snap.total_requests, snap.avg_latency_ms, snap.hit_rate_pct) == (0, 0.0, 0.0)


def kappa_of(spark, *rows):
    df = spark.createDataFrame([(a, b) for a, b, k in rows for _ in range(k)], "original_label int, author_label int")
    return agreement.kappa(agreement.contingency(df)).first()


def test_kappa(spark):
    assert kappa_of(spark, (1, 1, 5), (0, 1, 1), (1, 0, 2), (0, 0, 2)).kappa == pytest.approx(0.16 / 0.46)
    assert kappa_of(spark, (1, 1, 1), (0, 1, 1), (1, 0, 1), (0, 0, 1)).kappa == pytest.approx(0.0)
    assert kappa_of(spark, (1, 1, 4)).kappa == 1.0
    none = kappa_of(spark, (1, None, 3))
    assert (none.kappa, none.observed_agreement, none.n_excluded) == (None, None, 3)


def test_kappa_report_lists_empty_groups_and_gate(spark):
    rows = [("faq", 1, 1)] * 3 + [("faq", 0, 0)] * 3 + [("code", 1, 0)] * 2 + [("chat", 1, None)]
    report = agreement.kappa_report(spark.createDataFrame(rows, "workload string, original_label int, author_label int"), ["faq", "code", "chat", "mail"])
    gated = {r.scope: (r.kappa, r.failed) for r in agreement.strict_gate(report, 0.7).collect()}
    assert gated["faq"] == (1.0, False) and gated["code"] == (0.0, True)
    assert gated["chat"] == (None, False) and gated["mail"] == (None, True) and set(gated) == {"overall", "faq", "code", "chat", "mail"}


def test_roll_up_means_come_from_sums(spark):
    rows = [("a", 0.7, 1, 0, 0, 1, 0, 10.0), ("a", 0.8, 3, 3, 0, 0, 9, 6.0)]
    df = spark.createDataFrame(rows, "model string, threshold double, total_requests long, exact_hits long, semantic_hits long, misses long, tokens_saved long, latency_sum_ms double")
    whole = metrics.roll_up(df, "model", "threshold").where((F.col("all_model") == 1) & (F.col("all_threshold") == 1)).first()
    assert whole.avg_latency_ms == pytest.approx(4.0) and whole.hit_rate == pytest.approx(0.75)
