"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold
them). The patterns' tokens flow to the sources' quotas: a pattern can give
its tokens once at no cost and again at a cost that rises with each
repetition, so no document repeats while others that could serve have not been
used. The graph has a node a pattern and a source, never one a document, and
is solved on the driver. What each pattern gives is then turned into
documents: whole rounds of all of them, and of the rest those that come first
in a seeded hash order.

That order is never sorted as a whole: sums by hash bin find the bin in which
the amount is reached, and only that bin's documents are ordered.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quern.llm import common as C

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
SEED = 42
_BIN_BITS = 12
#: Patterns and sources are gathered on the driver; more than this is an error, not a silent limit.
MAX_PATTERNS = 200_000
BROADCAST_PATTERNS = 10_000


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MAX_COPIES) -> dict[str | None, float]:
    """Each source's tokens: ``share`` of all by weight, at most ``most`` times its size.

    Sources take the weights in turn, in order of code points with null last.
    What stands above a limit is shared again by weight until nothing does.
    """
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8", "surrogatepass")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, open_ = share * sum(sizes.values()), set(order)
    while open_:
        total = sum(weight[s] for s in order if s in open_)
        give = {s: left * weight[s] / total for s in order if s in open_}
        full = [s for s in order if s in open_ and give[s] > most * sizes[s]]
        if not full:
            return out | give
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
            open_.remove(s)
    return out


@dataclass
class _Arc:
    to: int
    room: int
    cost: int
    back: int


def min_cost_flow(supply: list[tuple[int, list[int]]], quota: list[int], copies: int = MAX_COPIES) -> list[dict[int, int]]:
    """Tokens from each pattern to each source.

    ``supply``: tokens of a pattern and the sources that it is in. The k-th use
    of a token costs k - 1, a convex cost; of all flows that fill most of the
    quotas one of least cost is found, by augmenting along cheapest paths.
    """
    n, m = len(supply), len(quota)
    source, sink = n + m, n + m + 1
    graph: list[list[_Arc]] = [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, room: int, cost: int) -> None:
        graph[a].append(_Arc(b, room, cost, len(graph[b])))
        graph[b].append(_Arc(a, 0, -cost, len(graph[a]) - 1))

    for p, (tokens, members) in enumerate(supply):
        for k in range(copies):
            arc(source, p, tokens, k)
        for s in members:
            arc(p, n + s, copies * tokens, 0)
    for s, q in enumerate(quota):
        arc(n + s, sink, q, 0)
    while True:
        cost: list[int | None] = [None] * len(graph)
        cost[source], via = 0, {}
        queue, inside = deque([source]), {source}
        while queue:
            a = queue.popleft()
            inside.discard(a)
            for i, e in enumerate(graph[a]):
                if e.room and (cost[e.to] is None or cost[a] + e.cost < cost[e.to]):
                    cost[e.to], via[e.to] = cost[a] + e.cost, (a, i)
                    if e.to not in inside:
                        queue.append(e.to)
                        inside.add(e.to)
        if cost[sink] is None:
            break
        path, at = [], sink
        while at != source:
            a, i = via[at]
            path.append(graph[a][i])
            at = a
        room = min(e.room for e in path)
        for e in path:
            e.room -= room
            graph[e.to][e.back].room += room
    return [{e.to - n: copies * tokens - e.room for e in graph[p] if n <= e.to < n + m and e.room < copies * tokens} for p, (tokens, _) in enumerate(supply)]


def _place(doc_id: Column, text: Column, seed: int) -> Column:
    """Where a row stands in the seeded order: a hash, then id and content."""
    return F.struct(F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 1).alias("u"), doc_id.alias("id"), C.row_key(doc_id, text).alias("key"))


def _bin(place: Column) -> Column:
    return F.shiftright(place["u"], 63 - _BIN_BITS)


def plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, copies: int = MAX_COPIES) -> DataFrame:
    """``(members, source, source_size, target, rounds, edge_bin, edge, edge_taken, edge_rows)``, a row a pattern, from ``sized(members, size, place)``.

    ``rounds``: how often every document is taken; those before ``edge`` in
    the seeded order are taken once more, and so are ``edge_taken`` of the
    ``edge_rows`` wholly equal rows that stand at it. source, its size and
    target are given where a pattern has one source.
    """
    spark = sized.sparkSession
    got = sized.groupBy("members").agg(F.sum("size").alias("tokens")).limit(MAX_PATTERNS + 1).collect()
    if len(got) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    got.sort(key=lambda r: [(s is None, s or "") for s in r.members])
    sizes: dict[str | None, int] = {}
    for r in got:
        for s in r.members:
            sizes[s] = sizes.get(s, 0) + r.tokens
    want = targets(sizes, weights, share, copies)
    names = list(sizes)
    at = {s: i for i, s in enumerate(names)}
    flow = min_cost_flow([(r.tokens, sorted({at[s] for s in r.members})) for r in got], [round(want[s]) for s in names], copies)
    rows = []
    for r, f in zip(got, flow, strict=True):
        given = sum(f.values())
        rounds, rest = divmod(given, r.tokens) if r.tokens else (0, 0)
        one = r.members[0] if len(r.members) == 1 else None
        rows.append((r.members, one, sizes.get(one) if len(r.members) == 1 else None, want.get(one) if len(r.members) == 1 else None, int(rounds), int(rest)))
    given = spark.createDataFrame(rows, "members array<string>, source string, source_size long, target double, rounds int, rest long")
    few = F.broadcast(given) if len(rows) <= BROADCAST_PATTERNS else given
    by_bin = sized.groupBy("members", _bin(F.col("place")).alias("bin")).agg(F.sum("size").alias("tokens"))
    run = Window.partitionBy("members").orderBy("bin")
    summed = by_bin.withColumn("upto", F.sum("tokens").over(run)).join(few.select("members", "rest"), "members")
    edge = C.durable(summed.where("rest > 0 and upto >= rest").groupBy("members").agg(F.min(F.struct("bin", (F.col("upto") - F.col("tokens")).alias("before"), "rest")).alias("e")).select("members", "e.*"))
    few_edges = F.broadcast(edge) if len(rows) <= BROADCAST_PATTERNS else edge
    inside = sized.withColumn("bin", _bin(F.col("place"))).join(few_edges, ["members", "bin"])
    # Wholly equal rows share a place: one row with their number stands for them.
    places = inside.groupBy("members", "place").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    order = Window.partitionBy("members").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    room = F.col("rest") - F.col("before") - F.sum(F.col("n") * F.col("size")).over(order) + F.col("n") * F.col("size")
    # A document is taken if that brings the sum nearer: as sums grow along the order, those taken are its first.
    fit = F.when(F.col("size") > 0, F.least(F.col("n"), F.floor(room / F.col("size") + 0.5))).when(room >= 0, F.col("n"))
    last = places.withColumn("m", fit.cast("long")).where("m >= 1").groupBy("members").agg(F.max(F.struct("place", "m", "n")).alias("e"))
    last = last.select("members", F.col("e.place").alias("edge"), F.col("e.m").alias("edge_taken"), F.col("e.n").alias("edge_rows"))
    return C.durable(given.drop("rest").join(edge.select("members", F.col("bin").alias("edge_bin")), "members", "left").join(last, "members", "left"))


def with_copies(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """``rows(members, place, ...)`` with their pattern's plan and ``copies``: how often each is taken.

    Where only some of the wholly equal rows at a pattern's edge are taken,
    those rows alone are written down and told apart by where they were
    written: counts by task find the task in which the number is reached, and
    only that task's rows are numbered.
    """
    few = planned.count() <= BROADCAST_PATTERNS
    joined = rows.join(F.broadcast(planned) if few else planned, "members")
    place, bin_ = F.col("place"), _bin(F.col("place"))
    at_edge = (bin_ == F.col("edge_bin")) & (place == F.col("edge"))
    first = (bin_ < F.col("edge_bin")) | ((bin_ == F.col("edge_bin")) & (place < F.col("edge"))) | (at_edge & (F.col("edge_taken") == F.col("edge_rows")))
    whole = joined.withColumn("copies", F.col("rounds") + F.when(F.coalesce(first, F.lit(False)), 1).otherwise(0))
    if not planned.where("edge_taken < edge_rows").count():
        return whole
    torn = F.coalesce(at_edge & (F.col("edge_taken") < F.col("edge_rows")), F.lit(False))
    equal = C.durable(joined.where(torn).withColumn("__row", F.monotonically_increasing_id()))
    task = F.shiftright("__row", 33).alias("__task")
    by_task = equal.groupBy("members", "edge_taken", task).agg(F.count("*").alias("__n"))
    run = by_task.withColumn("__upto", F.sum("__n").over(Window.partitionBy("members").orderBy("__task")))
    reached = run.where("__upto >= edge_taken").groupBy("members").agg(F.min(F.struct("__task", (F.col("edge_taken") - F.col("__upto") + F.col("__n")).alias("__more"))).alias("__r")).select("members", "__r.*")
    number = F.row_number().over(Window.partitionBy("members").orderBy("__row"))
    last = equal.select("members", "__row", task).join(F.broadcast(reached) if few else reached, ["members", "__task"]).withColumn("__number", number).where("__number = __more").select("members", F.col("__row").alias("__last"))
    some = equal.join(F.broadcast(last) if few else last, "members").withColumn("copies", F.col("rounds") + F.when(F.col("__row") <= F.col("__last"), 1).otherwise(0))
    return whole.where(~torn).unionByName(some.drop("__row", "__last"))


def _sized(docs: DataFrame, members: Column, seed: int) -> DataFrame:
    ident, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(ident.alias("doc_id"), members.alias("members"), C.word_count(text).alias("size"), _place(ident, text, seed).alias("place"))


def mix(docs: DataFrame, members: Column | None = None, seed: int = SEED, **options) -> DataFrame:
    """``(doc_id, members, size, source_size, target, copies, taken)`` for every row of docs.

    ``members``: the array of sources that hold a document (by default the one
    in ``source``, which may be null: a source of its own). Null text has size
    0; documents of size 0 go with their pattern's rounds at no cost. Ties in
    the seeded order are rows of equal id and text: of those at the edge as
    many are taken once more as bring the pattern nearest to its quota, so some
    of them may have a copy more than others. Very long texts count whole; a
    pattern ends within half a document of its quota. An empty table gives no
    rows. Columns other than doc_id, text and source are not read. The same
    input and seed take as many of each distinct row.
    """
    sized = C.durable(_sized(docs, F.array("source") if members is None else F.array_sort(F.array_distinct(members)), seed))
    got = with_copies(sized, plan(sized, **options))
    return got.select("doc_id", "members", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: how much of every document the mix takes."""
    got = mix(C.table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", "taken", "copies")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it (not at all, once or twice)."""
    ident, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    planned = plan(C.durable(_sized(docs, F.array("source"), SEED))).drop("source", "source_size", "target")
    own = [F.col(c).alias(f"__c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*own, F.array("source").alias("members"), _place(ident, text, SEED).alias("place"))
    back = [F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return with_copies(rows, planned).withColumn("__n", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*back)
