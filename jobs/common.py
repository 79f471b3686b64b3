"""What the jobs share: sessions, configuration, tables that may not be there yet, counted writes."""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("cellweave.jobs")


def config(path: str | None, default: str) -> dict:
    """The settings in a JSON file, those of the file ``default`` beside the jobs where it names none."""
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), default)) as f:
        settings = json.load(f)
    if path:
        with open(path) as f:
            given = json.load(f)
        if unknown := set(given) - set(settings):
            raise ValueError(f"{path}: unknown settings {', '.join(sorted(unknown))}; known are {', '.join(sorted(settings))}")
        settings |= given
    return settings


def stored(spark: SparkSession, path: str, schema: str, *parts: str, form: str = "parquet") -> DataFrame:
    """The table at ``path``, partitioned by ``parts``; where there is none yet, an empty one is made there."""
    spark.createDataFrame([], schema).write.format(form).mode("ignore").partitionBy(*parts).save(path)
    return spark.read.schema(schema).format(form).load(path)


def put(rows: DataFrame, path: str, *parts: str, form: str = "parquet") -> int:
    """Write the partitions that ``rows`` have, in place of what those held; others stay. Returns the rows written.

    Rows are dealt by partition first, so that a partition has few files; Spark splits large ones and joins small ones.
    """
    seen = Observation()
    counted = rows.hint("rebalance", *parts).observe(seen, F.count(F.lit(1)).alias("n"))
    counted.write.format(form).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).save(path)
    n = seen.get["n"]
    log.info("wrote %d rows to %s by %s", n, path, ", ".join(parts))
    return n


def command(name: str, about: str, paths: dict[str, str], run: Callable[..., dict]) -> None:
    """The command line: paths as options, a settings file, a session made here and stopped here."""
    parser = argparse.ArgumentParser(prog=name, description=about)
    for option, text in paths.items():
        parser.add_argument(f"--{option}", required=True, help=text)
    parser.add_argument("--config", help="JSON file of settings that differ from the default's")
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        print(json.dumps(run(spark, **{k.replace("-", "_"): getattr(given, k.replace("-", "_")) for k in paths}, settings=given.config)))
    finally:
        spark.stop()
