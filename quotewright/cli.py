"""Command line: each command is one operator or pipeline over Parquet paths.

    python -m quotewright.cli build-bars --ticks PATH --bar-set quote-bars-v2 --output PATH
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .contracts import HORIZONS, WalkForwardPlan
from .operators import bars as B
from .operators import features as W
from .operators import labels as L
from .operators import quality as Q
from .plans import pipeline, records
from .sources import ticks as T
from .sources.sinks import contract_of, read_table, write_table


def _ticks(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    rows = spark.read.parquet(args.ticks)
    rows = T.canonical_ticks(rows if "seq" in rows.columns else T.ticks_from_events(rows))
    return T.scan_range(rows, end=args.end_exclusive)


def _plan(args: argparse.Namespace) -> WalkForwardPlan:
    return WalkForwardPlan(args.train_start, args.first_validation, args.end, step=args.step)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quotewright")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        for o in options:
            p.add_argument(f"--{o}", required=True)
        return p

    for name in ("audit-ticks", "build-bars", "run-development"):
        p = command(name, "ticks", *(("output",) if name != "audit-ticks" else ()))
        p.add_argument("--end-exclusive", type=int)
        if name != "audit-ticks":
            p.add_argument("--bar-set", choices=("quote-bars-v1", "quote-bars-v2"), default="quote-bars-v1")
        if name == "run-development":
            p.add_argument("--family", choices=("ridge", "trees"), default="ridge")
    for name in ("build-validation", "run-development"):
        p = commands.choices[name] if name in commands.choices else command(name, "output")
        for o in ("train-start", "first-validation", "end"):
            p.add_argument(f"--{o}", type=int, required=True)
        p.add_argument("--step", type=int)
    command("build-features", "bars", "output")
    p = command("build-labels", "bars", "output")
    p.add_argument("--horizons-minutes", type=int, nargs="+", default=list(HORIZONS))
    p.add_argument("--minimum-return-bps", type=float, default=0.0)
    command("manifest", "source")
    return top


def main(argv: list[str] | None = None) -> int:
    """Exit code 0, or 2 where a research run is not accepted."""
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quotewright").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    match args.command:
        case "audit-ticks":
            for row in Q.tick_audit(_ticks(spark, args)).toJSON().collect():
                print(row)
        case "build-bars":
            build = B.quote_bars_v2 if args.bar_set == "quote-bars-v2" else B.quote_bars_v1
            write_table(build(_ticks(spark, args)), args.output, args.bar_set)
        case "build-features":
            bars = spark.read.parquet(args.bars)
            bar_set = contract_of(bars).get("contract", "")
            v2 = bar_set == "quote-bars-v2"
            write_table((W.features_v2 if v2 else W.features_v1)(bars), args.output, "causal-v2" if v2 else "causal-v1", bars=bar_set)
        case "build-labels":
            bars = read_table(spark, args.bars)
            write_table(L.executable_labels(bars, tuple(args.horizons_minutes), args.minimum_return_bps), args.output, "executable-v1", bars=contract_of(bars).get("contract", ""))
        case "build-validation":
            print(records.write_immutable_json(args.output, pipeline.validation_manifest(_plan(args))))
        case "manifest":
            print(json.dumps(T.dataset_manifest(spark, args.source), sort_keys=True))
        case "run-development":
            record = pipeline.run_development(spark, _ticks(spark, args), args.output, pipeline.ResearchConfig(_plan(args), args.bar_set, args.family), args.ticks)
            print(json.dumps(record, sort_keys=True, default=str))
            return 0 if record["accepted"] else 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
