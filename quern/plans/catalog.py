"""The engine's queries over the shared test tables; their SQL is in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.columns import l2_distance, norm, normalised, ratio, similarity, token_count
from quern.operators import agreement, annotation, cells, expiry, ivf, lookup, metrics, nearest, replay, sampling, serving, validation
from quern.operators import embedding as emb
from quern.operators.shared import scratch
from quern.plans import grid as grids
from quern.plans import pairs as P
from quern.plans.oracle import SQL
from quern.sources import datasets, sinks

__all__ = ["QUERIES", "SQL"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _r(c: str, digits: int = 6):
    return F.round(F.col(c).cast("double"), digits).alias(c)


# -- exact lookup -----------------------------------------------------------


def _document_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("text").alias("prompt"), "lang", "source")


@query
def exact_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.exact_replay(_document_requests(spark, sf_dir)).select("seq", "key", "first_seq", "exact_hit")


@query
def exact_hit_rate_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = lookup.exact_replay(_document_requests(spark, sf_dir))
    n = hits.groupBy("lang").agg(F.count("*").alias("requests"), F.count_if("exact_hit").alias("hits"))
    return n.select("lang", "requests", "hits", F.round(ratio(100.0 * F.col("hits"), F.col("requests")), 6).alias("hit_rate_pct"))


@query
def exact_lookup_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of each document stored with a lifetime; every document asks again at a later time."""
    docs = P.read(spark, sf_dir, "documents")
    stored = docs.select(F.sha2("text", 256).alias("key"), F.col("doc_id").cast("string").alias("response_text"), F.col("doc_id").alias("created_at"), F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("doc_id") + 500).alias("expires_at"))
    store = lookup.upsert(stored.limit(0), stored)
    now = F.lit(900)
    got = lookup.lookup(docs.select("doc_id", F.col("text").alias("prompt")), store, now)
    return got.select("doc_id", "exact_hit", "response_text")


@query
def store_upsert_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entries by customer: the latest of each, less those of customers in debt."""
    orders = P.read(spark, sf_dir, "orders")
    entries = orders.select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").alias("created_at"), F.col("o_orderstatus").alias("status"))
    early, late = entries.where("created_at <= 30000"), entries.where("created_at > 30000")
    gone = P.read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("key"))
    return lookup.delete(lookup.upsert(early, late), gone)


# -- vectors ----------------------------------------------------------------


@query
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors scaled by their label and back; label 0 makes zero vectors, which stay."""
    v = P.read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * F.col("label")).alias("v"))
    n = v.select("vec_id", normalised(F.col("v")).alias("u"))
    return n.select("vec_id", F.round(norm(F.col("u")), 6).alias("norm"), (F.round(F.element_at("u", 1), 6) + 0.0).alias("first"), (F.round(F.element_at("u", -1), 6) + 0.0).alias("last"))


def _search_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = P.read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return e.where("vec_id % 20 = 0"), e


@query
def nn_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = nearest.knn(*_search_sides(spark, sf_dir), k=1)
    return got.select("query_id", "neighbour_id", _r("distance"), _r("similarity"))


@query
def nn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = nearest.knn(*_search_sides(spark, sf_dir), k=10)
    return got.select("query_id", F.col("rank").cast("long").alias("rank"), "neighbour_id", _r("distance"), _r("similarity"))


@query
def nn_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest by cells and the triangle inequality, as a store too large to send is searched."""
    got = cells.search(*_search_sides(spark, sf_dir), k=10)[0]
    return got.select("query_id", F.col("rank").cast("long").alias("rank"), "neighbour_id", _r("distance"), _r("similarity"))


@query
def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the inverted file finds at least 0.95 of the ten nearest of every twentieth vector."""
    asked, store = _search_sides(spark, sf_dir)
    found = nearest.search(asked, store, backend="ivf", k=10)
    got = ivf.measured_recall(found, nearest.knn(asked, store, k=10))
    return got.select("queries", "neighbours", (F.col("recall") >= 0.95).alias("reached"))


@query
def semantic_decisions_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = nearest.semantic_decisions(*_search_sides(spark, sf_dir), thresholds=list(P.CALIBRATED))
    return got.select("query_id", "threshold", "hit", "matched_id", _r("similarity"))


@query
def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by hashing; how many of the exact ones it finds is measured in the tests."""
    return nearest.lsh_neighbours(*_search_sides(spark, sf_dir), radius=1.2).select("query_id", "neighbour_id", _r("distance"))


# -- replay -----------------------------------------------------------------


@query
def greedy_semantic_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as one configuration, settled in rounds: no task holds it."""
    e = P.read(spark, sf_dir, "embeddings")
    requests = e.select(F.lit("all").alias("config"), F.col("vec_id").alias("seq"), F.col("vec_id").cast("string").alias("key"), F.col("embedding").alias("vector"), F.lit(0.47).alias("threshold"))
    return replay.replay(requests, hot=0).select("seq", "source", _r("similarity"), "matched_seq", "stored")


@query
def cascade_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, then semantic, then backend, with repeating prompts and a full store."""
    e = P.read(spark, sf_dir, "embeddings")
    requests = e.select(F.col("label").cast("string").alias("config"), F.col("vec_id").alias("seq"), (F.col("vec_id") * 7 % 31).cast("string").alias("key"), F.col("embedding").alias("vector"), F.lit(0.48).alias("threshold"))
    return replay.replay(requests, max_size=8).select(F.col("config").cast("int").alias("label"), "seq", "source", _r("similarity"), "matched_seq", "stored")


@query
def fifo_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = P.read(spark, sf_dir, "documents")
    requests = docs.select(F.col("lang").alias("config"), F.col("doc_id").alias("seq"), F.sha2("text", 256).alias("key"))
    return replay.replay(requests, max_size=50, semantic=False).select(F.col("config").alias("lang"), "seq", "source", "matched_seq", "stored")


@query
def ttl_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = P.read(spark, sf_dir, "events")
    requests = events.select(F.col("user_id").cast("string").alias("config"), F.col("event_id").alias("seq"), F.col("event_type").alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("now"))
    return replay.replay(requests, ttl=86400.0, semantic=False).select(F.col("config").cast("long").alias("user_id"), "seq", "source", "matched_seq")


@query
def expiry_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as requests for their source, a second apart, that live fifty: a source may hold any part of the rows, and none is a task."""
    docs = P.read(spark, sf_dir, "documents")
    requests = docs.select(F.lit("all").alias("config"), F.col("doc_id").alias("seq"), F.coalesce("source", F.lit("")).alias("key"), F.col("doc_id").cast("double").alias("now"))
    return expiry.replayed(requests, 50.0).select("seq", "source", "matched_seq", "stored")


def _sweep(spark: SparkSession, sf_dir: str, thresholds: tuple[float, ...]) -> DataFrame:
    return replay.sweep(P.by_model(P.labelled(spark, sf_dir)), P.grid(spark, thresholds))


@query
def pair_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair's second query against its own first, at each threshold."""
    rows = P.by_model(P.labelled(spark, sf_dir)).select("model", "pair_id", "label", similarity(l2_distance(F.col("vector_1"), F.col("vector_2"))).alias("similarity"))
    t = F.explode(F.array(*[F.lit(x) for x in P.CALIBRATED])).alias("threshold")
    hit = ~(F.col("similarity") < F.col("threshold"))
    return rows.select("*", t).select("model", "pair_id", "threshold", _r("similarity"), replay.outcome(hit, F.col("label")).alias("outcome"))


@query
def sweep_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.decision_rows(_sweep(spark, sf_dir, P.CALIBRATED)).drop("similarity")


@query
def confusion_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: replay over the whole grid, then counts and rates a configuration."""
    got = metrics.evaluate(_sweep(spark, sf_dir, P.CALIBRATED))
    return got.select("config_id", "model", "workload", "threshold", "n", "tp", "fp", "tn", "fn", *[_r(c) for c in metrics.RATES], "precision_zero_div", "recall_zero_div", "fpr_zero_div")


@query
def frozen_grid_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds that nothing meets: every rate is 0 and flagged where its denominator is."""
    return sinks.result_rows(metrics.evaluate(_sweep(spark, sf_dir, P.FROZEN)))


@query
def sanity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluations of the labels with every third count spoilt."""
    joined = P.read(spark, sf_dir, "documents").join(P.read(spark, sf_dir, "labels"), "doc_id")
    rows = joined.select(F.concat_ws("|", "lang", "source").alias("config_id"), replay.outcome(F.col("quality") == 1, 1 - F.col("toxic")).alias("outcome"))
    spoilt = metrics.rates(metrics.confusion(rows, "config_id")).withColumn("n", F.col("n") + F.when(F.col("n") % 3 == 0, 1).otherwise(0))
    return metrics.sanity_violations(spoilt).select("config_id", "n", "tp", "fp", "tn", "fn")


@query
def grid_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.grid(spark)


@query
def grid_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.subset(grids.grid(spark), models=["modernbert"], thresholds=[0.7, 0.9])


# -- agreement and datasets -------------------------------------------------


@query
def kappa_by_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = agreement.kappa_report(P.labelled(spark, sf_dir), ["faq", "code", "chat", "none"])
    return got.select("scope", "tp", "fp", "fn", "tn", "n_annotated", "n_excluded", _r("observed_agreement"), _r("expected_agreement"), _r("kappa"))


@query
def kappa_labels_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = P.read(spark, sf_dir, "labels").join(P.read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    got = agreement.kappa(agreement.contingency(joined, "lang", first="quality", second="toxic"))
    return got.select("lang", "tp", "fp", "fn", "tn", _r("kappa"))


@query
def kappa_strict_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = agreement.kappa_report(P.labelled(spark, sf_dir).withColumn("author_label", F.coalesce("author_label", F.when(F.col("workload") == "faq", None).otherwise(F.col("original_label")))), ["faq", "code", "chat"])
    return agreement.strict_gate(report, 0.9).select("scope", "n_excluded", _r("kappa"), "failed")


@query
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same number of labelled documents of either quality from even and odd ids."""
    joined = P.read(spark, sf_dir, "labels").join(P.read(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    rows = joined.select(F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("workload"), F.col("doc_id").cast("string").alias("source_pair_id"), F.col("quality").alias("label"))
    return sampling.stratified(rows, n=6, seed=42).select("workload", "pair_id", "source_pair_id", "label", F.col("position").cast("long").alias("position"))


@query
def pair_validation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with a fault put in by their number."""
    n = F.col("seq")
    broken = (
        P.dataset(P.labelled(spark, sf_dir))
        .withColumn("workload", F.when(n % 11 == 1, "mail").otherwise(F.col("workload")))
        .withColumn("query_2", F.when(n % 13 == 2, " \t").otherwise(F.col("query_2")))
        .withColumn("original_label", F.when(n % 17 == 3, 2).otherwise(F.col("original_label")))
        .withColumn("source_pair_id", F.when(n % 19 == 4, None).otherwise(F.col("source_pair_id")))
    )
    return validation.violations(broken)


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = P.labelled(spark, sf_dir)
    return pairs.where("pair_no % 4 = 0").select("pair_id", (F.col("pair_no") % 2).cast("int").alias("label")).unionByName(spark.createDataFrame([("unknown-1", 1)], "pair_id string, label int"))


@query
def progress_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = annotation.merge_progress(P.labelled(spark, sf_dir), _progress(spark, sf_dir))
    again = annotation.merge_progress(P.labelled(spark, sf_dir), _progress(spark, sf_dir), overwrite=True)
    return got.select("pair_id", "author_label").join(again.select("pair_id", F.col("author_label").alias("overwritten")), "pair_id")


@query
def blind_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotation.blind_view(P.dataset(P.labelled(spark, sf_dir)))


@query
def annotation_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session that answers the unlabelled pairs in order, skips some and quits."""
    pairs = P.labelled(spark, sf_dir)
    text = F.element_at(F.array(*[F.lit(x) for x in (" 1", "0", "S", "maybe", "1 ")]), (F.col("pair_no") / 5 % 5 + 1).cast("int"))
    answers = pairs.where("author_label is null").select("pair_id", F.col("pair_no").alias("position"), F.when(F.col("pair_no") == 200, "Q").otherwise(text).alias("answer"))
    return annotation.session_summary(pairs, answers)


@query
def remaining_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotation.remaining(P.labelled(spark, sf_dir))


def _round_trip(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    folder = f"{scratch(spark, "pairs")}/pairs"
    pairs = P.dataset(P.labelled(spark, sf_dir))
    if kind == "csv":
        sinks.save_csv(pairs, folder)
        got = datasets.load_csv(spark, folder)
    else:
        sinks.export_json(pairs, f"{folder}.json")
        got = datasets.load_json(spark, f"{folder}.json")
    return got.select(*datasets.COLUMNS[:-1], F.col("metadata")["label"].alias("meta_label"), F.col("metadata")["other"].alias("meta_other"))


@query
def dataset_roundtrip_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "csv")


@query
def dataset_roundtrip_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "json")


# -- serving ----------------------------------------------------------------


@query
def last_message_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.last_prompts(P.read(spark, sf_dir, "conversations"))


@query
def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as requests: those with a system turn ask for a threshold out of range or have no messages."""
    turns = P.read(spark, sf_dir, "conversations").withColumn("message", F.when(F.col("role") != "system", F.struct("role", F.col("text").alias("content"))))
    requests = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("message").isNotNull(), F.struct("turn", "message")))).alias("m"), F.max(F.when(F.col("role") == "system", 1.5)).alias("threshold"))
    shaped = requests.select("conv_id", F.transform("m", lambda x: x["message"]).alias("messages"), "threshold")
    return shaped.select("conv_id", validation.request_problem(F.col("messages"), F.col("threshold")).alias("problem"), F.length(serving.last_message(F.col("messages"))).cast("long").alias("prompt_chars"))


@query
def mock_backend_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = P.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    got = serving.backend(turns)
    return got.select("conv_id", "turn", "answer", F.col("token_usage").cast("long").alias("token_usage"), "response_model", F.substring("prompt", 1, 30).alias("shown"))


def _traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: the type decides where the answer came from."""
    kind = F.col("event_id") % 7
    return P.read(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), "ts", "user_id", "event_type",
        F.when(kind < 2, "exact_cache").when(kind < 3, "semantic_cache").when(kind < 6, "llm").alias("source"), (F.col("event_id") % 97).alias("tokens"), F.col("value").alias("latency_ms"), F.round(F.lit(0.7) + (F.col("user_id") % 3) / 10.0, 1).alias("threshold"),
    )


@query
def metrics_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = metrics.snapshot(metrics.counters(_traffic(spark, sf_dir), "event_type"))
    return snap.select("event_type", "total_requests", "exact_hits", "semantic_hits", "misses", "tokens_saved", _r("avg_latency_ms", 4), _r("hit_rate_pct", 4))


@query
def cache_stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.roll_up(metrics.counters(_traffic(spark, sf_dir), "event_type", "threshold"), "event_type", "threshold")
    return got.select("event_type", "threshold", "all_event_type", "all_threshold", "total_requests", "exact_hits", "semantic_hits", "misses", "tokens_saved", _r("avg_latency_ms", 4), _r("hit_rate", 4))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.read(spark, sf_dir, "documents").select("source", F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("canonical_name"), F.lit(True).alias("in_exact"), (F.col("doc_id") % 3 == 0).alias("in_semantic"))


@query
def model_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stored in exact stores of 40 entries, one a source; a third of them are in the semantic index."""
    docs = P.read(spark, sf_dir, "documents")
    stored = docs.select("source", F.col("doc_id").alias("seq"), F.sha2("text", 256).alias("key"), F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("canonical_name"))
    entries = metrics.held(stored, 40, True, ("source",)).withColumn("in_semantic", F.col("seq") % 3 == 0)
    got = metrics.model_breakdown(entries, "source")
    listed = F.array_join(F.transform(F.map_entries("model_breakdown"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return got.select("source", "index_size", listed.alias("model_breakdown"))


@query
def clear_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.clear_report(_entries(spark, sf_dir), "source")


@query
def budget_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spend in whole cents, ordered by number, days as bins."""
    events = P.read(spark, sf_dir, "events").select("event_id", F.round(F.abs("value") * 100).cast("long").alias("cents"))
    got = serving.budget_guard(events, F.col("cents"), 100_000, ["event_id"], F.expr("event_id div 1000"))
    return got.select("event_id", "cents", F.col("spent_before").cast("long").alias("spent_before"), "sent")


@query
def pool_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = P.read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.lit(None).cast("double").alias("threshold"), F.when(F.col("user_id") % 3 == 0, None).otherwise(F.concat(F.lit("m"), (F.col("user_id") % 20).cast("string"))).alias("embedding_model"))
    routed = serving.route(events, "default", 0.85)
    return serving.admit(routed, ["pool_model", "pool_threshold"], seq="event_id").select("event_id", "pool_model", "pool_threshold", "admitted")


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _traffic(spark, sf_dir).where("source is not null")
    return t.select(
        "seq", F.concat(F.lit("r"), F.col("seq").cast("string")).alias("request_id"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("arrival_ts"), (F.unix_seconds(F.col("ts").cast("timestamp")) + 1).cast("double").alias("completion_ts"),
        F.when(F.col("user_id") % 2 == 0, F.lit("even")).alias("canonical_name"), F.lit("asked").alias("requested_model"), F.lit("backend").alias("response_model"), F.concat(F.lit('say "'), "event_type", F.lit('"')).alias("prompt"), F.col("event_type").alias("answer"),
        F.col("tokens").alias("input_tokens"), (F.col("tokens") * 2).alias("output_tokens"), "source", F.when(F.col("source") == "exact_cache", 1.0).when(F.col("source") == "semantic_cache", 0.875).alias("similarity"), F.lit("default").alias("embedding_model"), "threshold", F.lit(12.5).alias("latency_ms"),
    )


@query
def response_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.responses(_decided(spark, sf_dir)).withColumn("input_tokens", F.col("input_tokens").cast("long")).withColumn("output_tokens", F.col("output_tokens").cast("long"))


@query
def request_log_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions written as log records and read back."""
    log = serving.log_records(_decided(spark, sf_dir).withColumnRenamed("source", "cache_source"))
    return serving.from_log(log)


@query
def log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of prompts drives the cache again."""
    records = P.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.to_json(F.struct(F.col("source").alias("embedding_model"), F.col("text").alias("prompt"), F.col("doc_id").cast("double").alias("arrival_ts"))).alias("record"))
    read = serving.from_log(records)
    return replay.replay(read.select(F.col("embedding_model").alias("config"), F.col("arrival_ts").cast("long").alias("seq"), "prompt"), semantic=False).select(F.col("config").alias("source_name"), "seq", "source", "matched_seq")


@query
def memo_embed_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts of each language were asked for and how many were embedded."""
    docs = P.read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    got = emb.embed(docs, emb.mock_embedder(16), "mock", prefix="search_query: ")
    return got.groupBy("lang").agg(F.count("*").alias("asked"), F.countDistinct("text_hash").alias("embedded"), F.max(F.size("embedding")).cast("long").alias("dimension"), F.round(F.max(norm(F.col("embedding"))), 6).alias("norm"))


@query
def prompt_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions over every document."""
    return P.read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"), token_count(F.col("text")).cast("long").alias("tokens"), F.reverse("lang").alias("reversed"), F.format_string("%s-%04d", "lang", "doc_id").alias("label"))


# -- extensions: measures that studies of such caches report ---------------


@query
def duplication_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = lookup.exact_replay(_document_requests(spark, sf_dir), by=("source",))
    n = hits.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("key").alias("distinct_prompts"))
    return n.select("source", "n", "distinct_prompts", F.round(1 - F.col("distinct_prompts") / F.col("n"), 6).alias("duplication_rate"))


@query
def threshold_hit_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = nearest.semantic_decisions(*_search_sides(spark, sf_dir), thresholds=list(P.CALIBRATED))
    return got.groupBy("threshold").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


@query
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold of best F0.5 for each model and workload; of equals the least."""
    got = metrics.evaluate(_sweep(spark, sf_dir, P.CALIBRATED))
    return got.groupBy("model", "workload").agg(F.max_by("threshold", F.struct(F.round("f0_5", 9), -F.col("threshold"))).alias("threshold"), F.round(F.max("f0_5"), 6).alias("f0_5"))


@query
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda p: F.round(F.percentile("latency_ms", p), 6)
    return _traffic(spark, sf_dir).groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


@query
def similarity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = nearest.knn(*_search_sides(spark, sf_dir), k=10)
    return got.groupBy(F.floor(F.round("similarity", 9) * 100).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query
def cost_vs_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the traffic costs with the cache and would cost without it."""
    t = _traffic(spark, sf_dir).where("source is not null")
    cost = serving.token_cost(F.col("tokens"), F.col("tokens") * 2, 5.0, 25.0)
    return t.groupBy("event_type").agg(F.round(F.sum(cost), 6).alias("baseline_usd"), F.round(F.sum(F.when(F.col("source") == "llm", cost).otherwise(0.0)), 6).alias("cached_usd"))


@query
def two_way_anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of squares of the hit rate by model, workload and what is left, over the grid."""
    got = metrics.evaluate(_sweep(spark, sf_dir, P.CALIBRATED)).select("model", "workload", "hit_rate")
    whole = got.agg(F.avg("hit_rate").alias("mean"))
    parts = got.groupBy("model", "workload").agg(F.avg("hit_rate").alias("cell"), F.count("*").alias("n"), F.sum(F.col("hit_rate") * F.col("hit_rate")).alias("sq"))
    model = got.groupBy("model").agg(F.avg("hit_rate").alias("by_model"))
    workload = got.groupBy("workload").agg(F.avg("hit_rate").alias("by_workload"))
    rows = parts.join(F.broadcast(model), "model").join(F.broadcast(workload), "workload").crossJoin(F.broadcast(whole))
    sq = lambda c: F.round(F.sum(F.col("n") * c * c), 6)
    return rows.agg(
        sq(F.col("by_model") - F.col("mean")).alias("ss_model"),
        sq(F.col("by_workload") - F.col("mean")).alias("ss_workload"),
        sq(F.col("cell") - F.col("by_model") - F.col("by_workload") + F.col("mean")).alias("ss_interaction"),
        F.round(F.sum(F.col("sq") - F.col("n") * F.col("cell") * F.col("cell")), 6).alias("ss_error"),
    )


@query
def session_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds between a user's requests for the same thing: what a lifetime has to bridge."""
    by = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    gap = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lag("ts").over(by).cast("timestamp"))
    gaps = P.read(spark, sf_dir, "events").withColumn("gap", gap).where("gap is not null")
    return gaps.groupBy("event_type").agg(F.count("*").alias("n"), F.max("gap").alias("longest"), F.count_if(F.col("gap") <= 86400).alias("within_day"))
