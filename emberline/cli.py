"""Command lines: ``python -m emberline.cli <command> --help``.

``aggregate`` and ``lifespan`` reduce raw files, ``train`` and ``predict`` work on what they left, ``run`` does all.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from emberline.plans import stages
from emberline.plans.training import Options
from emberline.schema import CLUSTERS


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="emberline", description="Job telemetry to checked failure scores.")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        own = commands.add_parser(name, help=text, description=text)
        own.add_argument("--output", required=True, help="folder for all that is made")
        own.add_argument("--clusters", nargs="+", choices=CLUSTERS, default=list(CLUSTERS))
        own.add_argument("--force", action="store_true", help="make again what is there")
        return own

    for name, text in (("aggregate", "One record per job from raw hourly files."), ("lifespan", "Whole-life spans of jobs. Opt-in: not early information.")):
        own = command(name, text)
        own.add_argument("--source", required=True)
        own.add_argument("--name", default="train", choices=("train", "valid", "judge"), help="which release the files are")
        own.add_argument("--from-month")
        own.add_argument("--to-month")
        if name == "aggregate":
            own.add_argument("--sample", help="a sample submission; its jobs that the strict window missed are filled in")
    for name, text in (("train", "One model per cluster."), ("predict", "Scores for the jobs of a sample submission."), ("run", "All stages.")):
        own = command(name, text)
        own.add_argument("--window-minutes", type=float, default=30.0)
        own.add_argument("--lifespan", action="store_true", help="use whole-life spans. Opt-in: not early information")
        if name != "train":
            own.add_argument("--sample", required=True)
        if name == "run":
            own.add_argument("--training", required=True)
            own.add_argument("--validation")
            own.add_argument("--judged", required=True)
            own.add_argument("--stages", nargs="+", choices=stages.STAGES, default=[])
        if name != "predict":
            own.add_argument("--holdout-months", type=int, default=Options.holdout)
            own.add_argument("--max-rows", type=int, default=Options.most_rows)
            own.add_argument("--max-holdout-rows", type=int, default=Options.most_holdout)
            own.add_argument("--identity-dropout", choices=("auto", "on", "off"), default=Options.dropout)
            own.add_argument("--seeds", type=int, default=Options.seeds)
            own.add_argument("--seed", type=int, default=Options.seed)
            own.add_argument("--rounds", type=int, default=60)
    return out


def options_of(args: argparse.Namespace) -> Options:
    return Options(rounds={"gbt": args.rounds, "forest": args.rounds}, seeds=args.seeds, holdout=args.holdout_months, seed=args.seed, most_rows=args.max_rows, most_holdout=args.max_holdout_rows, dropout=args.identity_dropout)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> object:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("emberline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    clusters = tuple(args.clusters)
    layout = stages.Layout(getattr(args, "training", ""), getattr(args, "judged", ""), getattr(args, "sample", None) or "", args.output, getattr(args, "validation", None))
    if args.command in ("aggregate", "lifespan"):
        months, out = (args.from_month, args.to_month), {}
        for c in clusters:
            if args.command == "lifespan":
                out[c] = stages.spans(spark, args.source, layout.spans(args.name), c, months, args.force)
            else:
                out[c] = stages.accumulate_source(spark, args.source, layout.accumulators(args.name), c, months, args.force)
                if args.sample and out[c]:
                    stages.fill_missing(spark, args.source, layout.accumulators(args.name), c, stages.wanted_jobs(spark, args.sample, c), args.force)
        return out
    seconds = args.window_minutes * 60
    if args.command == "train":
        return {c: stages.fit(spark, layout, c, seconds, options_of(args), args.lifespan, args.force) for c in clusters}
    if args.command == "predict":
        return stages.predict(spark, layout, seconds, args.lifespan, clusters)
    return stages.run(spark, layout, tuple(args.stages), args.lifespan, seconds, options_of(args), args.force, clusters)


if __name__ == "__main__":
    main()
