"""Climatology: annual maxima, occurrence, day-of-year means, hail days, percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = ["cell_row", "cell_col"]


def cell_day_max(obs: DataFrame, day) -> DataFrame:
    """Daily cell maxima of timesteps; max is associative, so it is combined before the shuffle."""
    return obs.withColumn("day", day).groupBy("day", *CELL).agg(F.max("mm").alias("mm"))


def block_max(cells: DataFrame, block: int = 5) -> DataFrame:
    """Maxima of block x block cells."""
    rows = cells.withColumn("cell_row", F.floor(F.col("cell_row") / block).cast("int")).withColumn("cell_col", F.floor(F.col("cell_col") / block).cast("int"))
    return rows.groupBy("day", *CELL).agg(F.max("mm").alias("mm"))


def annual_max(cell_day: DataFrame) -> DataFrame:
    return cell_day.groupBy(F.year("day").alias("year"), *CELL).agg(F.max("mm").alias("mm"))


def years_of(cell_day: DataFrame) -> DataFrame:
    """One row: the number of years that have data; the denominator of every per-year rate."""
    return cell_day.agg(F.count_distinct(F.year("day")).alias("n_years"))


def occurrence(annual: DataFrame, years: DataFrame, thresholds) -> DataFrame:
    """Share of years in which a cell's maximum is over 0 (p_occ) and reaches each threshold (p_0, p_1, ...)."""
    counts = annual.groupBy(*CELL).agg(F.count_if(F.col("mm") > 0).alias("n"), *(F.count_if(F.col("mm") >= t).alias(f"n{i}") for i, t in enumerate(thresholds)))
    n_years = years.scalar()
    return counts.select(*CELL, (F.col("n") / n_years).alias("p_occ"), *((F.col(f"n{i}") / n_years).alias(f"p_{i}") for i in range(len(thresholds))))


def doy_means(cell_day: DataFrame) -> DataFrame:
    """Mean of a cell on a day of the year over all days with data, absent cells counting 0."""
    days = cell_day.select("day").distinct().groupBy(F.dayofyear("day").alias("doy")).agg(F.count(F.lit(1)).alias("n_days"))
    sums = cell_day.groupBy(F.dayofyear("day").alias("doy"), *CELL).agg(F.sum("mm").alias("total"))
    return sums.join(F.broadcast(days), "doy").select("doy", *CELL, (F.col("total") / F.col("n_days")).alias("mean_mm"))


def annual_means(cell_day: DataFrame) -> DataFrame:
    """Mean over all days (a file a day) and days with signal a calendar year: two denominators."""
    files = cell_day.agg(F.count_distinct("day")).scalar()
    sums = cell_day.groupBy(*CELL).agg(F.sum("mm").alias("total"), F.count_if(F.col("mm") > 0).alias("days"))
    return sums.select(*CELL, (F.col("total") / files).alias("mean_mm"), (F.col("days") / years_of(cell_day).scalar()).alias("days_per_year"))


def hail_day_counts(cell_day: DataFrame, thresholds) -> DataFrame:
    """Days a cell, year and month reaches each threshold."""
    return cell_day.groupBy(*CELL, F.year("day").alias("year"), F.month("day").alias("month")).agg(*(F.count_if(F.col("mm") >= t).alias(f"days_{i}") for i, t in enumerate(thresholds)))


def percentile_table(rows: DataFrame, group: list[str], value: str, percentiles) -> DataFrame:
    """n, mean, max and exact percentiles of each group; ``percentile`` interpolates linearly."""
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"), *(F.percentile(value, F.lit(p / 100.0)).alias(f"p{p}") for p in percentiles))


def ecdf(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """``rows`` with the share of their group at or below their value; ranks come from counts by value."""
    from cellweave.operators.ranks import value_ranks

    shares = value_ranks(rows, group, value).select(*group, value, ((F.col("before") + F.col("n")) / F.col("total")).alias("ecdf"))
    return rows.join(shares, [*group, value]).select(*rows.columns, "ecdf")
