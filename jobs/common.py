"""What the jobs share: configuration, logging and the command line."""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def configuration(spark: SparkSession, path: str, known: dict) -> dict:
    """The settings of a JSON file over their defaults; one that isn't known is an error. The path may be any that Spark reads."""
    found = spark.read.option("multiLine", True).json(path).first()
    given = {k: v for k, v in (found.asDict(recursive=True) if found else {}).items() if v is not None}
    if strange := set(given) - set(known):
        raise ValueError(f"{path}: unknown settings {sorted(strange)}")
    return known | given


def main(job: Callable, known: dict, paths: list[str], argv: list[str] | None = None) -> None:
    """Run a job from the command line: its paths, and a configuration file if there is one."""
    parser = argparse.ArgumentParser(description=job.__doc__)
    for name in paths:
        parser.add_argument(name)
    parser.add_argument("--config", default=None, help="a JSON file with settings")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s", stream=sys.stderr)
    import netloom

    spark = SparkSession.builder.appName(Path(sys.argv[0]).stem).getOrCreate()
    try:
        netloom.reachable(spark)
        settings = configuration(spark, args.config, known) if args.config else known
        job(spark, *(getattr(args, p) for p in paths), **settings)
    finally:
        spark.stop()
