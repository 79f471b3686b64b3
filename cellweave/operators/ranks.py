"""Exact ranks and quantiles of few, large groups, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def value_ranks(rows: DataFrame, group: list[str], value: str, parts: int = 64) -> DataFrame:
    """(group, value, n, before, total): each distinct value, how often it is there, and how many rows are below it.

    Rows are counted by value before they move. Values fall into ``parts`` ranges a unit, so a task sums the values of a
    range; the sums of ranges, a few a group, are summed along the group.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n")).withColumn("_b", F.floor(F.col(value) * parts))
    ranges = counts.groupBy(*group, "_b").agg(F.sum("n").alias("_m"))
    along = Window.partitionBy(*group)
    ranges = ranges.select(*group, "_b", F.coalesce(F.sum("_m").over(along.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.sum("_m").over(along).alias("total"))
    inside = Window.partitionBy(*group, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return placed.join(ranges, [*group, "_b"]).select(*group, value, "n", (F.col("_base") + F.col("_in")).alias("before"), "total")


def quantiles(rows: DataFrame, group: list[str], value: str, probabilities: list[float], parts: int = 64) -> DataFrame:
    """(group, k, q): the exact quantile at probabilities[k], interpolated between neighbouring ranks."""
    ranked = value_ranks(rows, group, value, parts)
    asked = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p")) for k, p in enumerate(probabilities))))
    place = (F.col("total") - 1) * F.col("_x.p")
    # a value serves the ranks from before to before + n - 1
    serves = lambda r: (F.col("before") <= r) & (r < F.col("before") + F.col("n"))
    hits = ranked.withColumn("_x", asked).withColumn("_h", place).where(serves(F.floor("_h")) | serves(F.ceil("_h")))
    low, high = F.max(F.when(serves(F.floor("_h")), F.col(value))), F.max(F.when(serves(F.ceil("_h")), F.col(value)))
    ends = hits.groupBy(*group, F.col("_x.k").alias("k")).agg(low.alias("_lo"), high.alias("_hi"), F.max("_h").alias("_h"))
    return ends.select(*group, "k", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_h") - F.floor("_h"))).alias("q"))
