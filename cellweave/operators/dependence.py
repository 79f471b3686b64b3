"""Dependence between cells: random pairs of all cells, rank correlations of a bounded set, and a Gaussian copula of it."""

from __future__ import annotations

from math import erf, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.operators.climate import CELL
from cellweave.operators.simulation import uniform

#: Cells of the copula at most: the side of the only matrix that the driver holds.
MOST_CELLS = 800


def indexed(cells: DataFrame, *order, most: int | None = None) -> DataFrame:
    """(i, cell): the distinct cells numbered from 1 in an order; the first ``most`` of them. A row a cell of the grid."""
    some = cells.select(*CELL).distinct()
    some = some if most is None else some.orderBy(*order, *CELL).limit(most)
    return some.withColumn("i", F.row_number().over(Window.orderBy(*order, *CELL)).cast("long"))


def draw_sql(pair: str, side: int, n: str) -> str:
    """SQL text of the cell, from 1, that a pair draws of n for its side 1 or 2."""
    return f"(CAST(least(floor({uniform(pair, str(side), 31)} * {n}), {n} - 1) AS BIGINT) + 1)"


def drawn_pairs(spark: SparkSession, n_cells: int, draws: int = 5000) -> DataFrame:
    """(pair, i, j): draws of two cells of ``n_cells`` each, by counter, so any task makes any of them; those of a cell with itself
    are left out, and a pair may be drawn twice."""
    pairs = spark.range(1, draws + 1 if n_cells else 1).select(F.col("id").alias("pair"))
    return pairs.select("pair", F.expr(draw_sql("pair", 1, str(n_cells or 1))).alias("i"), F.expr(draw_sql("pair", 2, str(n_cells or 1))).alias("j")).where("i <> j")


def planar_km(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Distances on a plane that is true at the mean latitude."""
    x, y = lon * 111.0 * np.cos(np.radians(lat.mean() if len(lat) else 0.0)), lat * 111.0
    return np.hypot(x[:, None] - x, y[:, None] - y)


def rank_matrix(values: DataFrame, n_cells: int) -> np.ndarray:
    """Spearman correlations of cells (i, year, mm) over the years, absent values 0: ``n_cells`` squared numbers come back."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Correlation

    held = values.groupBy("year").agg(F.map_from_entries(F.collect_list(F.struct("i", "mm"))).alias("m"))
    rows = held.select(array_to_vector(F.transform(F.sequence(F.lit(1), F.lit(n_cells)), lambda i: F.coalesce(F.col("m")[i.cast("long")], F.lit(0.0)))).alias("v"))
    return Correlation.corr(rows, "v", "spearman").first()[0].toArray()


def fitted_length(km: np.ndarray, rho: np.ndarray, low: float = 10.0, high: float = 2000.0) -> float:
    """The length of exp(-km / length) that is nearest to the correlations of all pairs, undefined ones left out."""
    at = np.triu_indices(len(km), 1)
    d, r = km[at], rho[at]
    d, r = d[np.isfinite(r)], r[np.isfinite(r)]
    cost = lambda length: float(((np.exp(-d / length) - r) ** 2).sum())
    grid = np.geomspace(low, high, 120)
    k = int(np.argmin([cost(g) for g in grid]))
    a, b, ratio = grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)], (5**0.5 - 1) / 2
    for _ in range(60):
        c, e = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, e) if cost(c) < cost(e) else (c, b)
    return float((a + b) / 2)


def copula_peaks(spark: SparkSession, factor: np.ndarray, years: int, events: int, seed: int = 42, block: int = 8) -> DataFrame:
    """(sim_year, i, u): each cell's largest probability over a year's ``events`` correlated normal fields.

    A value rises with its probability, so a year's largest value is that of the largest probability, and only those leave
    the task. Years are drawn in blocks, a matrix product each; a year's draws depend on the seed and the year only.
    """
    n = len(factor)

    def run(batches):
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for a in range(0, len(numbers), block):
                part = numbers[a : a + block]
                raw = np.concatenate([np.random.default_rng([seed, int(y)]).standard_normal((events, n)) for y in part])
                top = (raw @ factor.T).reshape(len(part), events, n).max(1)
                u = np.array([(1 + erf(x / sqrt(2))) / 2 for x in top.ravel().tolist()])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, n)), pa.array(np.tile(np.arange(1, n + 1), len(part))), pa.array(u)], names=["sim_year", "i", "u"])

    parts = max(1, min(years // block, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spark.range(1, years + 1, 1, parts).select(F.col("id").alias("sim_year")).mapInArrow(run, "sim_year long, i long, u double")


def quantiles_of(peaks: DataFrame, values: DataFrame, n_events: int) -> DataFrame:
    """``peaks`` (.., i, u) with ``mm``: the value of the probability among the ``n_events`` values of the cell, of which ``values``
    (i, mm) has those over 0; between the places k / (n + 1) it is interpolated, and 0 up to the share of zeros.

    A cell's values meet its probabilities in the tasks; none passes the driver.
    """
    names = [c for c in peaks.columns if c != "mm"]

    def look_up(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(held["mm"].to_numpy(float))
        zeros = n_events - len(v)
        at = np.arange(zeros, n_events + 1) / (n_events + 1)
        u = asked["u"].to_numpy()
        mm = np.where(u > zeros / n_events, np.interp(u, at, np.concatenate([[0.0], v])), 0.0) if len(v) else np.zeros(len(u))
        return asked[names].assign(mm=mm)

    schema = ", ".join(f"{c} {t}" for c, t in peaks.select(*names).dtypes) + ", mm double"
    return peaks.groupBy("i").cogroup(values.where("mm > 0").select("i", "mm").groupBy("i")).applyInPandas(look_up, schema)


def annual_aggregates(found: DataFrame, group: list[str], damage: float = 25.4) -> DataFrame:
    """(group, aggregate, footprint): the sum of the cells' largest values, and how many reach ``damage``."""
    return found.groupBy(*group).agg(F.sum("mm").alias("aggregate"), F.count_if(F.col("mm") >= damage).alias("footprint"))
