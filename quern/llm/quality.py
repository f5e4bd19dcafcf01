"""Quality rules: a decision list learned by sequential covering.

Every text is reduced to a row of counts by built-in functions. On labelled
rows, rules are learned one after the other: a rule grows by the threshold
condition with the best information gain on two thirds of the rows, is pruned
back on the other third, and is kept if it is precise there; rows that it
covers then leave. A rule that is not precise there is given up: its first
condition opens no rule any more, and the next best one is tried. Each step is one aggregation into (feature, bin) counts, so
what reaches the driver is bounded by features x bins and all labelled rows
take part. The result is an ordered conditional expression that Spark
evaluates like any other column. No Python runs on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common as C

SYMBOLS = "#*$%&|<>"
BINS = 32
BASE_MIN_WORDS = 50
BASE_MAX_REPEAT = 50  # per cent
#: Labelled texts from which the pipeline's stage learns, at most, chosen by a hash of their id.
LABELLED = 50_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits")


def _repeat_words(w: Column) -> Column:
    """Words that lie in a three-word window which the text has twice or more.

    Windows are hashed; only where some hash repeats are they sorted with
    their places, so that equal ones are neighbours: n log n for any text,
    however often a window repeats.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def twice(s: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.get(p, k + 1) - x)), F.lit(0), lambda a, x: a + x)

    def some(h: Column) -> Column:
        placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(C.let(C.let(F.sort_array(placed), twice), covered))

    return F.when(F.size(w) < 4, F.lit(0)).otherwise(C.let(hashes, some)).cast("long")


def counts(text: Column) -> Column:
    """A struct of the counts in ``COUNTS`` for a whole text (null: empty)."""
    t = F.coalesce(text, F.lit(""))
    count = lambda chars: F.coalesce(F.regexp_count(t, F.lit(f"[{chars}]")), F.lit(0)).cast("long")
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(C.GAP_CHARS)) != "")
    return C.let(
        C.words(t),
        lambda w: C.let(
            lines,
            lambda x: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                count(SYMBOLS).alias("n_symbols"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                _repeat_words(w).alias("n_repeat_words"),
                F.size(x).cast("long").alias("n_lines"),
                count("A-Z").alias("n_upper"),
                count("!?").alias("n_marks"),
                count("0-9").alias("n_digits"),
            ),
        ),
    )


def features(c: Column | None = None) -> dict[str, Column]:
    """What rules may test, from count columns or from a struct of them; never null."""
    get = (lambda n: F.col(n)) if c is None else (lambda n: c[n])
    rate = lambda a, b: get(a) / F.greatest(get(b), F.lit(1)).cast("double")
    return {
        "words": get("n_words").cast("double"),
        "mean_word": rate("word_chars", "n_words"),
        "symbols": rate("n_symbols", "n_words"),
        "dup_lines": rate("n_dup_lines", "n_lines"),
        "repeats": rate("n_repeat_words", "n_words"),
        "line_words": rate("n_words", "n_lines"),
        "upper": rate("n_upper", "word_chars"),
        "marks": rate("n_marks", "n_words"),
        "digits": rate("n_digits", "word_chars"),
    }


def base_failed(c: Column | None = None) -> Column:
    get = (lambda n: F.col(n)) if c is None else (lambda n: c[n])
    return (get("n_words") < BASE_MIN_WORDS) | (100 * get("n_repeat_words") > BASE_MAX_REPEAT * get("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, f: dict[str, Column]) -> Column:
        return f[self.feature] > self.threshold if self.above else f[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def rejected(rules: list[Rule], f: dict[str, Column]) -> Column:
    """The decision list as one ordered conditional: the number of the first rule that covers a row, else 0."""
    out = None
    for n, rule in enumerate(rules, 1):
        test = _all(rule, f)
        out = F.when(test, n) if out is None else out.when(test, n)
    return F.lit(0) if out is None else out.otherwise(0)


def _all(rule: Rule, f: dict[str, Column]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column(f)
    return out


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(
    labelled: DataFrame, *, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.95, min_support: int = 5, grown: float = 0.98, max_failures: int = 8
) -> list[Rule]:
    """Rules for ``bad`` rows from ``labelled(bad boolean, part 0/1/2, one column a feature)``.

    min_precision is what a rule must reach on the rows held out for pruning,
    and min_support the bad rows that it must cover there. Of conditions of
    equal gain the first counts, by feature in the order of the columns, then
    by threshold, at most before above. ``max_failures`` rules may be given up.
    Without rows of both kinds there are no rules.
    """
    names = [c for c in labelled.columns if c not in ("bad", "part")]
    at = [i / BINS for i in range(1, BINS)]
    # Cuts are taken within each class, so that they also fall where a rare class lies.
    cut_rows = labelled.groupBy("bad").agg(*[F.percentile_approx(n, at, 10_000).alias(n) for n in names]).collect()
    if len(cut_rows) < 2:
        return []
    values = {n: sorted({float(x) for r in cut_rows for x in r[n]}) for n in names}
    cuts = {n: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for n, v in values.items()}  # midway, so a rule stands off from good rows
    bin_of = lambda n: F.size(F.filter(F.array(*[F.lit(x) for x in cuts[n]]).cast("array<double>"), lambda t: t < F.col(n)))  # noqa: E731  cuts below the value
    cells = C.durable(labelled.select("bad", (F.col("part") > 0).alias("grow"), *[bin_of(n).alias(n) for n in names]).groupBy("bad", "grow", *names).agg(F.count("*").alias("n")))
    # In cells a feature is its bin: value > cuts[i] is bin > i, and value <= cuts[i] is bin <= i.
    binned = {n: F.col(n) for n in names}
    index = lambda r: tuple(Condition(c.feature, c.above, float(cuts[c.feature].index(c.threshold))) for c in r)
    # One grouping set a feature: what leaves a task is a row a bin. A rule that was given up leaves the rows as they were, so the counts that open the next one are kept.
    bins = lambda df: (df.groupingSets([[F.col(n)] for n in names], *names).agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("q")).collect())
    total = lambda df: (df.agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("n")).first())
    rules: list[Rule] = []
    rest = cells
    given_up: set[Condition] = set()
    opening: tuple | None = None
    while len(rules) < max_rules and len(given_up) <= max_failures:
        rule: Rule = ()
        grow = rest.where("grow")
        if opening is None:
            p0, n0 = (x or 0 for x in total(grow))
            if p0 < min_support:
                break
            opening = p0, n0, bins(grow)
        p0, n0, got = opening
        while len(rule) < max_conditions and p0 / (p0 + n0) < grown:
            if rule:
                got = bins(grow.where(_all(index(rule), binned)))
            best, found = 1e-9, None
            for n in names:
                p = q = 0
                by = {r[n]: (r.p, r.q) for r in got if r[n] is not None}
                for i, cut in enumerate(cuts[n]):
                    p, q = p + by.get(i, (0, 0))[0], q + by.get(i, (0, 0))[1]
                    for above, pp, qq in ((False, p, q), (True, p0 - p, n0 - q)):
                        if (pp, qq) != (p0, n0) and (g := _gain(pp, qq, p0, n0)) > best and (rule or Condition(n, above, cut) not in given_up):
                            best, found = g, (Condition(n, above, cut), pp, qq)
            if found is None:
                break
            rule, p0, n0 = (*rule, found[0]), found[1], found[2]
        if not rule:
            break
        held = rest.where("not grow")
        sums = [F.sum(F.when(_all(index(rule[:k]), binned) & (F.col("bad") == bad), F.col("n")).otherwise(0)).alias(f"{side}{k}") for k in range(1, len(rule) + 1) for side, bad in (("p", True), ("n", False))]
        seen = held.agg(*sums).first()
        worth = {k: (seen[f"p{k}"] or 0, seen[f"n{k}"] or 0) for k in range(1, len(rule) + 1)}
        k = max(worth, key=lambda k: ((worth[k][0] - worth[k][1]) / max(1, sum(worth[k])), -k))
        p, n = worth[k]
        if p < min_support or p < min_precision * (p + n):
            given_up.add(rule[0])
            continue
        rules.append(rule[:k])
        rest, opening = rest.where(~_all(index(rule[:k]), binned)), None
    return rules


def stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``COUNTS`` for every row of ``docs``."""
    return docs.select(F.col(id_col).alias("doc_id"), counts(F.col(text_col)).alias("c")).select("doc_id", *[F.col("c")[n].alias(n) for n in COUNTS])


def learn_from(counted: DataFrame, labels: DataFrame) -> list[Rule]:
    """The decision list from counted texts and ``labels(doc_id, quality)``.

    A text labelled twice counts with its lower label; null labels and ids are
    left out, and so are texts that the base rules reject anyway.
    """
    once = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("part")
    return learn(counted.where(~base_failed()).join(once, "doc_id").select((F.col("quality") == 0).alias("bad"), part, *[v.alias(k) for k, v in features().items()]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: counts and verdicts for every document.

    Null text counts as empty (0 words, so base_failed), and so does an empty
    one. Rows with a null or repeated id are judged like any other and stay rows
    of their own. Very long texts count whole. Without documents there are no
    rows; without labels no rules, and the base decides alone.
    """
    counted = C.durable(stats(C.table(spark, sf_dir, "documents")))
    rules = learn_from(counted, C.table(spark, sf_dir, "labels"))
    rule = rejected(rules, features())
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
        (~base_failed() & (rule == 0)).alias("kept"), rule.alias("rule"),
    )


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the base rules or the learned list reject go.

    The list is learned from ``LABELLED`` of the labels of sf_dir at most, so
    only their texts are counted for it; the verdict is then part of the scan
    of docs, without a join. Rows with a null or repeated id are judged like
    any other; null text counts as empty and is rejected.
    """
    labels = C.table(spark, sf_dir, "labels").where("doc_id is not null and quality is not null")
    few = C.durable(labels.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED))
    known = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id", "left_semi")
    rules = learn_from(C.durable(stats(known)), labels)
    # One expression, so that the counts of a text are made once however often the verdict refers to them.
    good = C.let(counts(F.col("text")), lambda c: ~base_failed(c) & (rejected(rules, features(c)) == 0))
    return docs.where(good)
