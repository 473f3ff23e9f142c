"""python -m cloakwork mask|generate|evaluate: the engine over files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from cloakwork.operators import evaluation, generation
from cloakwork.plans.catalog import ConfigError
from cloakwork.plans.engine import Engine
from cloakwork.sources import tables
from cloakwork.sources.config import read_config


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("cloakwork", description=__doc__)
    p.add_argument("--config", help="YAML configuration; the built-in one without")
    p.add_argument("--system", help="whose profile and types count")
    commands = p.add_subparsers(dest="command", required=True)
    mask = commands.add_parser("mask", help="text files to JSON lines (path, masked, entities)")
    mask.add_argument("source")
    mask.add_argument("target")
    make = commands.add_parser("generate", help="a labelled corpus as JSON lines")
    make.add_argument("target")
    make.add_argument("--per-category", type=int, default=60)
    make.add_argument("--negatives", type=int, default=20)
    make.add_argument("--seed", type=int, default=42)
    judge = commands.add_parser("evaluate", help="quality over labelled JSON lines, as Markdown; fails below --least-f1")
    judge.add_argument("source")
    judge.add_argument("--least-f1", type=float, default=0.95)
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    try:
        engine = Engine(read_config(a.config) if a.config else None)
    except (ConfigError, OSError) as e:
        print(f"configuration: {e}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("cloakwork").getOrCreate()
    if a.command == "mask":
        engine.mask(tables.read_texts(spark, a.source), a.system).select("path", "masked", "entities").write.json(a.target)
        return 0
    if a.command == "generate":
        tables.write_golden(generation.generate(spark, a.per_category, a.negatives, a.seed), a.target)
        return 0
    totals, by_type, failures = evaluation.evaluate(engine, tables.read_golden(spark, a.source), a.system)
    rows = [r.asDict() for r in by_type.collect()]  # one a type
    print(evaluation.markdown(totals.first().asDict(), rows, [r.asDict() for r in failures.collect()]))
    return 0 if evaluation.passes(rows, a.least_f1) else 1


if __name__ == "__main__":
    sys.exit(main())
