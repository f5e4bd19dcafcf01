"""Replay of an exact store with a lifetime, in set form: a hot key is no task.

A request finds its key alive if it comes no later than the lifetime after the
last store, and stores it anew otherwise. So the stores of a key are a chain:
from each request a pointer leads to the first one that comes after its lifetime,
and the stores are what the pointers reach from the key's first request. Doubling
the pointers reaches twice as many in each round, so a chain of n stores takes
log n rounds of joins on (key, place), which no key can make uneven. No Python
runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.columns import prompt_key
from quern.operators import replay
from quern.operators.shared import durable, few, filled, numbered


def pointers(placed: DataFrame, ttl: float) -> DataFrame:
    """``(k, pos, next)``: the first request after each one's lifetime, null where there is none.

    Requests and the ends of lifetimes are put in one order of time; what an
    end is followed by is its request.
    """
    came = placed.select("k", F.col("now").alias("at"), F.lit(0).alias("kind"), "pos", F.col("pos").alias("request"))
    ends = placed.select("k", (F.col("now") + ttl).alias("at"), F.lit(1).alias("kind"), "pos", F.lit(None).cast("long").alias("request"))
    # A request at the very end of a lifetime still finds it alive, so it stands before the end.
    return filled(came.unionByName(ends), "k", "at", "kind", "pos", value="request", name="next", ahead=True).where("kind = 1").select("k", "pos", "next")


def chain(nodes: DataFrame) -> DataFrame:
    """``(k, pos)`` of what ``nodes(k, pos, next)`` reach from each key's place 0, by doubling pointers."""
    nodes = durable(nodes)
    # Only places that something points to can be reached.
    ends = nodes.where("next is not null").select("k", F.col("next").alias("pos")).distinct()
    now = durable(nodes.join(ends, ["k", "pos"], "left_semi").where("pos > 0").unionByName(nodes.where("pos = 0")).select("k", "pos", F.col("next").alias("jump"), (F.col("pos") == 0).alias("store")))
    while not now.where("store and jump is not null").isEmpty():
        reached = now.where("store and jump is not null").select("k", F.col("jump").alias("pos"), F.lit(True).alias("hit"))
        onward = now.select("k", F.col("pos").alias("jump"), F.col("jump").alias("further"))
        now = durable(
            now.join(reached, ["k", "pos"], "left").join(onward, ["k", "jump"], "left").select("k", "pos", F.col("further").alias("jump"), (F.col("store") | F.coalesce("hit", F.lit(False))).alias("store"))
        )
    return now.where("store").select("k", "pos")


def replayed(requests: DataFrame, ttl: float) -> DataFrame:
    """``(config, seq, source, similarity, matched_seq, stored)``, equal to ``replay.replay(requests, ttl=ttl, semantic=False)``.

    ``requests``: config, seq (unique within it), prompt or key, and now
    (seconds). Keys whose times run backwards or are missing somewhere have no
    such chain; they, and they alone, are replayed in order. An empty table
    gives no rows.
    """
    if ttl < 0:
        raise ValueError("a lifetime is not negative")
    key = F.col("key") if "key" in requests.columns else prompt_key(F.col("prompt"))
    rows = requests.select(F.col("config").cast("string").alias("config"), F.col("seq").cast("long").alias("seq"), key.alias("key"), F.col("now").cast("double").alias("now"))
    placed = durable(numbered(durable(rows.withColumn("k", F.struct("config", "key"))), "k", "seq"))
    before = placed.select("k", (F.col("pos") + 1).alias("pos"), F.col("now").alias("before"))
    odd = durable(placed.join(before, ["k", "pos"], "left").where("now is null or now < before").select("k").distinct())
    n_odd = odd.count()
    usual = placed.join(few(odd, n_odd), "k", "left_anti") if n_odd else placed
    stores = chain(pointers(usual, ttl))
    marked = usual.join(stores.withColumn("stored", F.lit(True)), ["k", "pos"], "left").withColumn("stored", F.coalesce("stored", F.lit(False))).withColumn("own", F.when(F.col("stored"), F.col("seq")))
    held = filled(marked, "k", "pos", value="own", name="held")
    hit = ~F.col("stored")
    out = held.select(
        "config", "seq", F.when(hit, replay.EXACT).otherwise(replay.LLM).alias("source"), F.when(hit, 1.0).alias("similarity"), F.when(hit, F.col("held")).alias("matched_seq"), "stored",
    )
    if not n_odd:
        return out
    # The order of a whole configuration matters to none of its keys, as nothing is evicted.
    rest = placed.join(few(odd, n_odd), "k", "left_semi").select("config", "seq", "key", "now")
    return out.unionByName(replay.replay(rest, ttl=ttl, semantic=False))
