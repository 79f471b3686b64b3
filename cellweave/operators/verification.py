"""Ground reports against the grid: pairing, calibration, contingency, bias. Reports never change grid values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.climate import CELL

KEY = ["day", *CELL]
SIZE_BINS = ((0.0, 0.75), (0.75, 1.0), (1.0, 1.5), (1.5, 2.0), (2.0, 3.0), (3.0, 4.0), (4.0, 99.0))


def correlation(x, y):
    """Pearson correlation, null where either side doesn't vary (the built-in one divides by zero there)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def largest_reports(reports: DataFrame) -> DataFrame:
    """The largest report of each day and cell, the first one on ties."""
    best = F.max_by(F.struct("size_in", "hour", "report_id"), F.struct("size_in", -F.col("report_id")))
    return reports.groupBy(*KEY).agg(best.alias("b")).select(*KEY, "b.*")


def report_pairs(reports: DataFrame, cell_day: DataFrame) -> DataFrame:
    """Reports with their cell's value; a day without any data has no pairs, an absent cell is 0."""
    days = cell_day.select("day").distinct()
    return largest_reports(reports).join(days, "day", "left_semi").join(cell_day, KEY, "left").withColumn("mm", F.coalesce("mm", F.lit(0.0)))


def size_bins(spark, bins=SIZE_BINS) -> DataFrame:
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("bin"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for i, (a, b) in enumerate(bins))))
    return spark.range(1).select(rows.alias("x")).select("x.*")


def calibration(pairs: DataFrame, bins: DataFrame, hit_mm: float = 25.4) -> DataFrame:
    """Per size bin, empty ones kept: n, means, bias, RMSE, MAE, probability of detection."""
    rows = pairs.join(F.broadcast(bins), (F.col("size_in") >= F.col("lo")) & (F.col("size_in") < F.col("hi")))
    d = F.col("mm") / 25.4 - F.col("size_in")
    stats = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("size_in").alias("mean_report"), F.avg(F.col("mm") / 25.4).alias("mean_grid"), F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.avg((F.col("mm") >= hit_mm).cast("int")).alias("pod"))
    return bins.join(stats, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def contingency(pairs: DataFrame, cell_day: DataFrame, size: float = 1.0, hit_mm: float = 25.4) -> DataFrame:
    """Hits, misses and false alarms of severe reports; denominators at least 1."""
    severe, seen = F.col("size_in") >= size, F.col("mm") >= hit_mm
    counts = pairs.agg(F.count_if(severe & seen).alias("hits"), F.count_if(severe & ~seen).alias("misses"), F.count_if(~severe & seen).alias("false_alarms"))
    h, m, f = (F.col(c) for c in ("hits", "misses", "false_alarms"))
    one = F.lit(1)
    return counts.select(h, m, f, (h / F.greatest(h + m, one)).alias("pod"), (f / F.greatest(h + f, one)).alias("far"), (h / F.greatest(h + m + f, one)).alias("csi"))


def without_report(cell_day: DataFrame, reports: DataFrame, least: float = 29.0) -> DataFrame:
    return cell_day.where(F.col("mm") >= least).join(reports, KEY, "left_anti")


def capped_sample(rows: DataFrame, group: str, most: int, order) -> DataFrame:
    """At most ``most`` rows of each group, by a stable pseudo-random order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def range_centers(edges: tuple[float, ...]) -> list[float]:
    return [(a + b) / 2 for a, b in zip(edges, edges[1:], strict=False)]


def range_debias(pairs: DataFrame, edges: tuple[float, ...], reference_km: float = 125.0, least: int = 30, least_in: float = 1.0, least_mm: float = 5.0) -> DataFrame:
    """(source, bin, n, factor) of pairs (source, km, size_in, mm): the median ratio of report to grid by range bin, 1
    where pairs are few, relative to the bin nearest ``reference_km`` and clipped to 0.45..1.15. Diagnostic only.

    Every bin has a factor, so the interpolation between bins happens where factors are applied.
    """
    centers = range_centers(edges)
    reference = min(range(len(centers)), key=lambda i: abs(centers[i] - reference_km))
    from cellweave.functions.grid import edge_bin

    ratio = F.col("size_in") * 25.4 / F.col("mm")
    inside = F.col("km").between(edges[0], edges[-1]) & (F.col("km") < edges[-1])
    fits = pairs.where((F.col("mm") >= least_mm) & (F.col("size_in") >= least_in) & inside).groupBy("source", edge_bin(F.col("km"), edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.median(ratio).alias("m"))
    every = pairs.select("source").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(len(centers) - 1))))
    rows = every.join(fits, ["source", "bin"], "left").withColumn("f", F.when(F.col("n") >= least, F.col("m")).otherwise(1.0))
    at = F.max(F.when(F.col("bin") == reference, F.col("f"))).over(Window.partitionBy("source"))
    return rows.select("source", "bin", F.coalesce("n", F.lit(0)).alias("n"), F.least(F.greatest(F.col("f") / at, F.lit(0.45)), F.lit(1.15)).alias("factor"))


def apply_range_debias(cells: DataFrame, factors: DataFrame, edges: tuple[float, ...]) -> DataFrame:
    """``cells`` (source, km, mm) times the factor interpolated between bin centres, clamped beyond the first and last."""
    from cellweave.operators.ingest import interpolate

    listed = factors.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "factor"))), lambda x: x["factor"]).alias("_f"))
    centers = F.array(*map(F.lit, range_centers(edges)))
    rows = cells.join(F.broadcast(listed), "source", "left")  # a row a source
    return rows.withColumn("mm", F.col("mm") * F.coalesce(interpolate(F.col("km"), centers, F.col("_f")), F.lit(1.0))).drop("_f")
