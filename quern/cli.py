"""Command line: sample, annotate, kappa, export, experiments.

    python -m quern.cli sample --out-csv d.csv --out-json d.json
    python -m quern.cli experiments --dataset d.csv --out-dir out
"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import agreement, annotation, embedding, metrics, replay, sampling
from quern.operators.validation import DatasetError
from quern.plans import grid as grids
from quern.sources import corpora, datasets, sinks


def session() -> SparkSession:
    return SparkSession.builder.appName("quern").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def sample(spark: SparkSession, args: argparse.Namespace) -> int:
    given: dict[str, tuple[str | None, Callable[[SparkSession, str], DataFrame]]] = {
        "faq": (args.faq, corpora.question_pairs),
        "code": (args.code, corpora.duplicate_questions),
        "chat": (args.chat, corpora.utterance_pairs),
    }
    sources = {w: read(spark, path) if path else corpora.synthetic(spark, w, 4 * args.n, args.seed) for w, (path, read) in given.items()}
    pairs = sampling.sample_dataset(sources, args.n, args.seed, args.positive_ratio)
    sinks.export_dataset(pairs, args.out_csv, args.out_json)
    return 0


def annotate(spark: SparkSession, args: argparse.Namespace, ask: Callable[[str], str] = input) -> int:
    """Shows one open pair after the other; each answer is saved before the next is asked."""
    progress = {r.pair_id: r.label for r in datasets.load_progress(spark, args.progress).collect()}
    known = lambda: spark.createDataFrame(list(progress.items()), "pair_id string, label int")
    pairs = annotation.merge_progress(datasets.load(spark, args.dataset), known(), args.overwrite)
    for r in annotation.blind_view(pairs, args.overwrite).toLocalIterator():
        try:
            answer = ask(f"\n{r.pair_id}\n1: {r.query_1}\n2: {r.query_2}\nsame? [1/0/s/q] ").strip().lower()
        except EOFError:
            break
        if answer == "q":
            break
        if answer in ("0", "1"):
            progress[r.pair_id] = int(answer)
            sinks.save_progress(known(), args.progress)
    if args.out_csv and args.out_json:
        sinks.export_dataset(annotation.merge_progress(datasets.load(spark, args.dataset), known(), args.overwrite), args.out_csv, args.out_json)
    return 0


def kappa(spark: SparkSession, args: argparse.Namespace) -> int:
    report = agreement.kappa_report(datasets.load(spark, args.dataset), list(sampling.WORKLOADS))
    if args.out_json:
        sinks.write_kappa(report, args.out_json)
    rows = agreement.strict_gate(report, args.threshold).collect()
    for r in rows:
        print(f"{r.scope}: kappa {'none' if r.kappa is None else f'{r.kappa:.4f}'} of {r.n_annotated} annotated, {r.n_excluded} not")
    return int(args.strict and any(r.failed for r in rows if r.scope == "overall"))


def export(spark: SparkSession, args: argparse.Namespace) -> int:
    sinks.export_dataset(datasets.load(spark, args.dataset), args.out_csv, args.out_json)
    return 0


def sweep_inputs(spark: SparkSession, pairs: DataFrame, cells: DataFrame, dimension: int) -> DataFrame:
    """Pairs with both queries' vectors for every model of the grid; each distinct text is embedded once."""
    out = None
    for (name,) in cells.select("model").distinct().collect():
        model = embedding.resolve(name)
        texts = pairs.select(F.explode(F.array("query_1", "query_2")).alias("text")).distinct()
        vectors = embedding.embed(texts, embedding.mock_embedder(dimension), model.canonical_name, prefix=model.prefix).select("text", "embedding")
        one = (
            pairs.join(vectors.select(F.col("text").alias("query_1"), F.col("embedding").alias("vector_1")), "query_1")
            .join(vectors.select(F.col("text").alias("query_2"), F.col("embedding").alias("vector_2")), "query_2")
            .select(F.lit(name).alias("model"), "workload", "pair_id", "seq", F.sha2("query_1", 256).alias("key_1"), F.sha2("query_2", 256).alias("key_2"), "vector_1", "vector_2", F.coalesce("author_label", "original_label").alias("label"))
        )
        out = one if out is None else out.unionByName(one)
    return out


def experiments(spark: SparkSession, args: argparse.Namespace) -> int:
    start = time.time()
    try:
        cells = grids.subset(grids.grid(spark), args.models, args.workloads, args.thresholds)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    decisions = replay.sweep(sweep_inputs(spark, datasets.load(spark, args.dataset), cells, args.dimension), cells.drop("position", "config_id"), max_size=args.max_size).persist()
    order = cells.select("config_id", "position")
    counted = decisions.select("config_id", "outcome").unionByName(cells.select("config_id", F.lit(None).cast("string").alias("outcome")))
    evaluated = metrics.rates(metrics.confusion(counted, "config_id").withColumn("n", F.col("n") - 1)).join(cells, "config_id")
    try:
        metrics.check_sanity(evaluated)
    except metrics.SanityError as e:
        print(e, file=sys.stderr)
        return 1
    sinks.write_results(evaluated, f"{args.out_dir}/results.csv", ["position"])
    sinks.write_decisions(decisions.join(order, "config_id"), f"{args.out_dir}/decisions.csv", ["position", "seq"])
    used = [r.asDict() for r in cells.orderBy("position").select("model", "workload", "threshold").collect()]
    names = {r["model"] for r in used}
    identities = {n: {"canonical_name": m.canonical_name, "checkpoint": m.checkpoint, "dimension": args.dimension} for n in sorted(names) for m in [embedding.resolve(n)]}
    sinks.write_run_meta(f"{args.out_dir}/run_meta.json", args.dataset, "mock", used, identities, time.time() - start)
    decisions.unpersist()
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quern")
    commands = p.add_subparsers(dest="command", required=True)

    def command(f: Callable, **options) -> argparse.ArgumentParser:
        c = commands.add_parser(f.__name__)
        c.set_defaults(run=f)
        for name, spec in options.items():
            c.add_argument(f"--{name.replace('_', '-')}", **spec)
        return c

    path, out = {"required": True}, {"default": None}
    command(sample, faq=out, code=out, chat=out, n={"type": int, "default": 300}, seed={"type": int, "default": 42}, positive_ratio={"type": float, "default": 0.5}, out_csv=path, out_json=path)
    command(annotate, dataset=path, progress=path, overwrite={"action": "store_true"}, out_csv=out, out_json=out)
    command(kappa, dataset=path, out_json=out, strict={"action": "store_true"}, threshold={"type": float, "default": 0.7})
    command(export, dataset=path, out_csv=path, out_json=path)
    command(experiments, dataset=path, out_dir=path, models={"nargs": "*"}, workloads={"nargs": "*"}, thresholds={"nargs": "*", "type": float}, dimension={"type": int, "default": embedding.DIMENSION}, max_size={"type": int, "default": 1000})
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(spark or session(), args)
    except (DatasetError, sampling.ShortfallError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
