"""Brings a gridded hazard archive up to date with the observations that arrived since the last run.

    python -m jobs.hazard_update --observations PATH --out PATH [--config FILE]

Observations are any Parquet table that the settings' SQL expressions map to (arrived, day, cell_row, cell_col, mm);
``arrived`` is a number that grows from delivery to delivery, and all rows of one number are delivered together. A run
takes the rows over its high-water mark and leaves under ``out``

- ``cell_day/year=/since=``: the daily cell maxima of what each run took; ``since`` is the mark it started from. A day's
  maximum is the largest of its rows, so late observations of old days need no rewrite;
- ``annual_max/year=``: annual cell maxima, made again for the years that got rows, from those years' partitions only;
- ``level/rp=``: return levels of every fitted cell, made again from all annual maxima;
- ``run/since=``: a row a run with its counts, the levels that fall below those of a shorter period, and the new mark, written
  last.

A run that dies leaves its mark unwritten; the next starts from the same mark, takes at least the same rows and overwrites
the same partitions. A run that finds nothing new writes nothing. One run at a time may write to an ``out``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.functions.quality import is_bad, sanitize
from cellweave.operators import climate, extremes
from jobs.common import command, config, log, put, stored

CELL_DAY = "day date, cell_row int, cell_col int, mm double, year int, since long"
ANNUAL = "cell_row int, cell_col int, mm double, year int"
LEVEL = "cell_row int, cell_col int, mm double, rp int"
RUN = "mark long, n_rows long, n_bad long, n_cell_days long, n_annual long, n_levels long, n_falls long, since long"


def observed(rows: DataFrame, settings: dict) -> DataFrame:
    """(arrived, day, cell_row, cell_col, raw): the settings' expressions; rows without arrival, day or cell have no place
    in the archive."""
    named = rows.select(*(F.expr(settings[c]).alias(c) for c in ("arrived", "day", "cell_row", "cell_col")), F.expr(settings["mm"]).cast("double").alias("raw"))
    return named.select(F.col("arrived").cast("long").alias("arrived"), F.col("day").cast("date").alias("day"), F.col("cell_row").cast("int").alias("cell_row"), F.col("cell_col").cast("int").alias("cell_col"), "raw").dropna(subset=["arrived", "day", "cell_row", "cell_col"])


def high_water_mark(spark: SparkSession, out: str) -> int | None:
    """The last arrival that finished runs have taken; None before the first."""
    return stored(spark, f"{out}/run", RUN, "since", form="json").agg(F.max("mark")).first()[0]


def cell_days(spark: SparkSession, out: str) -> DataFrame:
    """(day, cell_row, cell_col, mm, year): the archive's daily maxima, over all runs."""
    return stored(spark, f"{out}/cell_day", CELL_DAY, "year", "since").groupBy("day", *climate.CELL, "year").agg(F.max("mm").alias("mm"))


def falls(levels: DataFrame, tolerance: float = 0.5) -> int:
    """Levels that lie by more than ``tolerance`` mm under the cell's level of the next shorter period."""
    before = F.lag("mm").over(Window.partitionBy(*climate.CELL).orderBy("rp"))
    return levels.withColumn("_before", before).agg(F.count_if(F.col("mm") < F.col("_before") - tolerance)).first()[0]


def run(spark: SparkSession, observations: str, out: str, settings: str | None = None) -> dict:
    """One update; returns what the run's row holds, ``n_rows`` 0 where nothing is new."""
    chosen = config(settings, "hazard_update.json")
    mark = high_water_mark(spark, out)
    rows = observed(spark.read.parquet(observations), chosen)
    new = rows if mark is None else rows.where(F.col("arrived") > mark)
    found = new.agg(F.max("arrived").alias("mark"), F.count(F.lit(1)).alias("n_rows"), F.count_if(is_bad(F.col("raw"))).alias("n_bad"), F.collect_set(F.year("day")).alias("years")).first()
    log.info("read %s over mark %s: %d new rows, %d out of range, of %d years", observations, mark, found.n_rows, found.n_bad, len(found.years))
    if not found.n_rows:
        return {"mark": mark, "n_rows": 0}
    since = -1 if mark is None else mark
    days = climate.cell_day_max(new.where(F.col("arrived") <= found["mark"]).withColumn("mm", sanitize(F.col("raw"))), F.col("day")).where("mm > 0")
    counts = {"n_cell_days": put(days.withColumn("year", F.year("day")).withColumn("since", F.lit(since).cast("long")), f"{out}/cell_day", "year", "since")}
    touched = cell_days(spark, out).where(F.col("year").isin(found.years))
    counts["n_annual"] = put(climate.annual_max(touched), f"{out}/annual_max", "year")
    annual = stored(spark, f"{out}/annual_max", ANNUAL, "year")
    n_years = annual.agg(F.count_distinct("year")).first()[0]
    fitted = extremes.cell_parameters(annual, n_years, F.expr(chosen["region"]), chosen["threshold_mm"])
    levels = extremes.return_levels(fitted, tuple(chosen["periods"])).withColumn("mm", F.round("mm", 6))  # sums differ in their last digits with the order of rows
    counts["n_levels"] = put(levels, f"{out}/level", "rp")
    counts["n_falls"] = falls(stored(spark, f"{out}/level", LEVEL, "rp"))
    if counts["n_falls"]:
        log.warning("%d levels fall with the period", counts["n_falls"])
    row = {"mark": found["mark"], "n_rows": found.n_rows, "n_bad": found.n_bad, **counts, "since": since}
    put(spark.createDataFrame([tuple(row.values())], RUN), f"{out}/run", "since", form="json")
    return row


def output(spark: SparkSession, out: str) -> DataFrame:
    """(what, at, cell_row, cell_col, mm): daily and annual maxima by day and year, levels by return period."""
    one = lambda rows, what, at: rows.select(F.lit(what).alias("what"), F.col(at).cast("string").alias("at"), *climate.CELL, "mm")
    days = one(cell_days(spark, out).where("mm > 0"), "day", "day")
    return days.unionByName(one(stored(spark, f"{out}/annual_max", ANNUAL, "year"), "year", "year")).unionByName(one(stored(spark, f"{out}/level", LEVEL, "rp"), "level", "rp"))


if __name__ == "__main__":
    command("hazard_update", __doc__.split("\n")[0], {"observations": "Parquet table of observations", "out": "folder of the archive"}, run)
