"""Calls to a paid backend: a budget that gates them, and retries in chains.

A call is sent only if what its pool key has spent before it is known to stay
below the cap. That needs no call to wait for the one before it: as long as the
cap covers what was spent plus a *reserve* for each call before it that is still
out, the call would be sent in order as well. So a round sends the prefix that
the reserve covers, all at once, settles real costs, and goes on. The reserve is
the most that a call can cost by its prompt's bytes and the answer's limit, or
the most that one did cost. Rounds begin small, so a price that was set too low
shows before much is spent.

A call that fails stores nothing, so the next request of that prompt calls again.
These requests form a chain, which one worker walks in order until a call
succeeds: a prompt that always fails takes a few rounds, not one a repeat. As any
of a chain may have to call, the reserve covers them all until one has succeeded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import serving
from quern.operators.shared import durable, filled

#: Calls of the first round of a pool key, and how many times more the next one may send.
FIRST, FASTER = 1, 8
#: Requests of a chain that a worker is given at a time, at first and at most.
CHAIN, LONGEST = 1024, 1 << 17
CALL = "config string, seq long, key string, answer string, response_model string, input_tokens int, output_tokens int, error string"
COLUMNS = [c.split()[0] for c in CALL.split(", ")]


@dataclass(frozen=True)
class Budget:
    """USD that each pool key may spend, prices a million tokens, and what bounds a call's cost."""

    cap: float | None
    input_price: float = 0.0
    output_price: float = 0.0
    max_output_tokens: int = 0
    reserve: float | None = None

    def cost(self) -> Column:
        return serving.token_cost(F.coalesce("input_tokens", F.lit(0)), F.coalesce("output_tokens", F.lit(0)), self.input_price, self.output_price)

    def most(self, size: Column) -> Column:
        """What a call with a prompt of so many bytes can cost: no token is shorter than a byte."""
        if self.reserve is not None:
            return F.lit(float(self.reserve))
        return serving.token_cost(size + 64, F.lit(self.max_output_tokens), self.input_price, self.output_price)

    def free(self) -> bool:
        return self.cap is None


def _bin() -> Column:
    return F.floor(F.col("seq") / 1000)


def settle(calls: DataFrame, budget: Budget) -> DataFrame:
    """Calls with those beyond their pool key's budget, in order, marked as such, at no cost."""
    if budget.free():
        return calls
    guarded = serving.budget_guard(calls, budget.cost(), budget.cap, ["seq"], _bin(), by=("config",))
    none = {c: F.when(F.col("sent"), F.col(c)) for c in ("answer", "response_model", "input_tokens", "output_tokens")}
    return guarded.withColumns(none | {"error": F.when(~F.col("sent"), "budget_exceeded").otherwise(F.col("error"))}).select(*COLUMNS)


def _covered(open_: DataFrame, calls: DataFrame | None, budget: Budget, step: int) -> tuple[DataFrame, DataFrame | None]:
    """(what may be sent now, what may never be sent) of the open requests."""
    if budget.free():
        return open_, None
    zero = F.lit(0.0)
    mine = open_.withColumns({"cost": zero, "held": budget.most(F.col("bytes")), "open": F.lit(1)})
    if calls is None:
        line = mine
    else:
        spent = calls.withColumn("cost", budget.cost())
        dearest = F.broadcast(spent.groupBy("config").agg(F.max("cost").alias("dearest")))  # a row a pool key
        mine = mine.join(dearest, "config", "left").withColumn("held", F.greatest("held", F.coalesce("dearest", zero))).drop("dearest")
        line = mine.unionByName(spent.select("config", "seq", "cost", zero.alias("held"), F.lit(0).alias("open")), allowMissingColumns=True)
    state = serving.running_sums(line, {"spent": F.col("cost"), "reserved": F.col("held"), "ahead": F.col("open")}, ["seq"], _bin(), by=("config",)).where("open = 1")
    state = durable(state.select(*open_.columns, "spent", "reserved", "ahead"))
    over = state.where(F.col("spent") >= budget.cap).select(*open_.columns)
    return state.where((F.col("spent") < budget.cap) & (F.col("spent") + F.col("reserved") < budget.cap) & (F.col("ahead") < step)).select(*open_.columns), over


def chains(requests: DataFrame, asked: DataFrame) -> DataFrame:
    """Requests of a prompt that calls, ``(config, seq, key, segment, bytes)``: the calls ``asked`` for, and those that follow if they fail.

    ``segment`` is the place of the call that a request follows; it ends where the next one is asked for.
    """
    keys = asked.select("config", "key").distinct()
    rows = requests.select("config", "seq", "key", F.octet_length("prompt").alias("bytes")).join(keys, ["config", "key"], "left_semi")
    rows = rows.join(asked.select("config", "seq", F.col("seq").alias("call")), ["config", "seq"], "left").withColumn("k", F.struct("config", "key"))
    return filled(durable(rows), "k", "seq", value="call", name="segment").where("segment is not null").select("config", "seq", "key", "segment", "bytes")


def send(requests: DataFrame, asked: DataFrame, calls: DataFrame | None, backend: Callable[[DataFrame], DataFrame], budget: Budget) -> DataFrame | None:
    """``calls`` with a row for every request of the chains of ``asked(config, seq, key)`` that called or would have.

    ``requests``: config, seq, key, prompt. Of a chain, requests after the first
    that succeeds do not call. ``backend`` gets a row a chain, with the places to
    call for in order as ``seqs``, and returns ``COLUMNS`` for those that called.
    """
    open_ = chains(requests, asked)
    if calls is not None:
        open_ = open_.join(calls.select("config", "seq"), ["config", "seq"], "left_anti")
    open_ = durable(open_)
    step, longest = FIRST, CHAIN
    texts = requests.select("config", F.col("seq").alias("segment"), "prompt")
    while not open_.isEmpty():
        allowed, over = _covered(open_, calls, budget, step)
        place = F.row_number().over(Window.partitionBy("config", "key", "segment").orderBy("seq"))
        some = allowed.withColumn("place", place).where(F.col("place") <= longest)
        given = some.groupBy("config", "key", "segment").agg(F.sort_array(F.collect_list("seq")).alias("seqs"))
        got = backend(given.join(texts, ["config", "segment"])).select(*COLUMNS, "segment")
        if over is not None:
            none = {c: F.lit(None) for c in ("answer", "response_model", "input_tokens", "output_tokens")}
            got = got.unionByName(over.withColumns(none | {"error": F.lit("budget_exceeded")}).select(*COLUMNS, "segment"))
        got = durable(got.selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in CALL.split(", ")], "segment"))
        done = got.where("error is null").select("config", "key", "segment").distinct()
        open_ = durable(open_.join(got.select("config", "seq"), ["config", "seq"], "left_anti").join(done, ["config", "key", "segment"], "left_anti"))
        calls = got.drop("segment") if calls is None else calls.unionByName(got.drop("segment"))
        step, longest = step * FASTER, min(LONGEST, longest * FASTER)
    return calls
