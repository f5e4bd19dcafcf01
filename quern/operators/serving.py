"""The request path in set form: routing, admission, budget, responses, log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.columns import mock_answer, token_count

POOL_CAP = 8
#: Fixed value: the name under which the deterministic backend answers.
MOCK_MODEL = "mock-v1"
# Error names and their status.
ERRORS = {
    "pool_cap_exceeded": 400,
    "budget_exceeded": 402,
    "invalid_request": 422,
    "unknown_model": 500,
    "provider_refusal": 502,
    "provider_error": 500,
}


def last_message(messages: Column) -> Column:
    """The content of the last of ``array<struct<role, content>>``; null if there is none."""
    return F.get(messages, F.size(messages) - 1)["content"]


def last_prompts(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """The last turn of each conversation; of equal turns the greater text."""
    return turns.groupBy(conv).agg(F.max(F.struct(turn, text)).alias("m")).select(conv, F.col(f"m.{turn}").alias(turn), F.col(f"m.{text}").alias("prompt"))


def backend(requests: DataFrame, prompt: str = "prompt") -> DataFrame:
    """The deterministic backend: an answer and its token usage, which is the words of the answer."""
    answered = requests.withColumn("answer", mock_answer(F.col(prompt)))
    return answered.withColumn("input_tokens", token_count(F.col(prompt))).withColumn("output_tokens", token_count(F.col("answer"))).withColumn("token_usage", F.col("output_tokens")).withColumn("response_model", F.lit(MOCK_MODEL))


def route(requests: DataFrame, model: str, threshold: float) -> DataFrame:
    """The pool key of each request: what it asks for, else the defaults."""
    return requests.withColumn("pool_model", F.coalesce("embedding_model", F.lit(model))).withColumn("pool_threshold", F.coalesce(F.col("threshold").cast("double"), F.lit(threshold)))


def full_at(requests: DataFrame, keys: list[str], cap: int = POOL_CAP, seq: str = "seq"):
    """The arrival at which the pool has ``cap`` keys, None if it never has."""
    first = requests.groupBy(*keys).agg(F.min(seq).alias("_first")).orderBy("_first", *keys).limit(cap).collect()
    return first[-1]["_first"] if len(first) == cap else None


def admit(requests: DataFrame, keys: list[str], cap: int = POOL_CAP, seq: str = "seq") -> DataFrame:
    """Requests with ``admitted``: whether their key is among the first ``cap`` seen.

    A rejected key never enters, so being admitted is a matter of first
    arrival. Only the ``cap`` admitted keys are sent to the tasks.
    """
    first = requests.groupBy(*keys).agg(F.min(seq).alias("_first")).orderBy("_first", *keys).limit(cap).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.lit(True).alias("_in"))
    same = None
    for i, k in enumerate(keys):
        test = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        same = test if same is None else same & test
    return requests.join(F.broadcast(first), same, "left").withColumn("admitted", F.coalesce("_in", F.lit(False))).drop("_in", *[f"_k{i}" for i in range(len(keys))])


def running_sums(rows: DataFrame, values: dict[str, Column], order: list[str], bin: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows with, under each name, the sum of its value over all rows before them in ``order``.

    ``bin`` must not decrease along the order. Each bin is ordered by a task
    of its own, and only the bins' sums are ordered as a whole.
    """
    own = {n: f"_v{i}" for i, n in enumerate(values)}
    binned = rows.withColumn("_bin", bin).withColumns({own[n]: v for n, v in values.items()})
    zero = F.lit(0)
    sums = binned.groupBy(*by, "_bin").agg(*[F.sum(v).alias(f"{v}s") for v in own.values()])
    over = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_bin", *[F.coalesce(F.sum(f"{v}s").over(over), zero).alias(f"{v}b") for v in own.values()])
    inside = Window.partitionBy(*by, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = binned.withColumns({f"{v}i": F.coalesce(F.sum(v).over(inside), zero) for v in own.values()}).join(sums, [*by, "_bin"])
    return summed.withColumns({n: F.col(f"{v}b") + F.col(f"{v}i") for n, v in own.items()}).drop("_bin", *[f"{v}{x}" for v in own.values() for x in ("", "b", "i")])


def running_sum(rows: DataFrame, value: Column, order: list[str], bin: Column, by: tuple[str, ...] = (), name: str = "before") -> DataFrame:
    """One of ``running_sums``."""
    return running_sums(rows, {name: value}, order, bin, by)


def budget_guard(requests: DataFrame, cost: Column, cap: float, order: list[str], bin: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Requests with ``spent_before`` and ``sent``: whether the sum of costs before them is below the cap.

    Costs are not negative, so once the cap is reached it stays reached. With
    ``by`` every key has a budget of its own.
    """
    return running_sum(requests, cost, order, bin, by, name="spent_before").withColumn("sent", F.col("spent_before") < cap)


def token_cost(input_tokens: Column, output_tokens: Column, input_price: float, output_price: float) -> Column:
    """USD by prices a million tokens."""
    return input_tokens / 1e6 * input_price + output_tokens / 1e6 * output_price


def responses(decided: DataFrame) -> DataFrame:
    """Decisions as response rows: a hit has no usage and carries a similarity, a miss has usage and none."""
    hit = F.col("source") != "llm"
    return decided.select(
        F.concat(F.lit("msg_"), "request_id").alias("id"), "request_id",
        F.when(hit, F.coalesce("canonical_name", "requested_model", F.lit("unknown"))).otherwise(F.coalesce("response_model", F.lit("unknown"))).alias("model"),
        "answer",
        F.when(hit, 0).otherwise(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
        F.when(hit, 0).otherwise(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
        F.lit("end_turn").alias("stop_reason"),
        F.when(hit, "HIT").otherwise("MISS").alias("cache_status"),
        F.when(hit, F.col("similarity")).alias("cache_similarity"),
    )


def error_status(error: Column) -> Column:
    out = F.lit(500)
    for name, status in ERRORS.items():
        out = F.when(error == name, status).otherwise(out)
    return F.when(error.isNotNull(), out)


def log_records(decided: DataFrame) -> DataFrame:
    """One JSON record a request, enough to drive the same sequence again."""
    fields = ("request_id", "arrival_ts", "completion_ts", "embedding_model", "threshold", "prompt", "cache_source", "similarity", "latency_ms")
    return decided.select("seq", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("record"))


LOG_SCHEMA = "request_id string, arrival_ts double, completion_ts double, embedding_model string, threshold double, prompt string, cache_source string, similarity double, latency_ms double"


def from_log(log: DataFrame, record: str = "record") -> DataFrame:
    return log.withColumn("r", F.from_json(record, LOG_SCHEMA)).select(*[c for c in log.columns if c != record], "r.*")


def count_usable(requests: DataFrame) -> DataFrame:
    """Refused answers cost money but are never stored."""
    return requests.withColumn("storable", (F.col("source") == "llm") & ~F.coalesce(F.col("refused"), F.lit(False)))
