"""Generalized-Pareto fits by maximum likelihood: all groups and candidates in one aggregation, or pooled in space by tiles.

With theta = xi / scale the likeliest xi is the mean of ln(1 + theta x), so a profile over theta needs only the sums of these
logarithms at some thetas of the group's own range: they are aggregated like any other statistic, and the maximum is then
found from a few dozen numbers a group.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions import grid
from cellweave.operators.climate import CELL

#: Thetas under 0, as parts of -1 / (largest x), where the range ends: dense towards it and towards 0.
UNDER = [1 / (1 + math.exp(-9 + 14 * i / 44)) for i in range(45)]
#: Thetas over 0, as multiples of 1 / (mean x), in geometric steps.
OVER = [0.005 * 3000 ** (i / 34) for i in range(35)]
ZERO = len(UNDER)


def log_sums(x: Column, mean: Column, top: Column) -> list[Column]:
    """Aggregates of ln(1 + theta x) for each theta but 0, in order."""
    return [F.sum(F.log1p(x * (-c) / top)) for c in UNDER] + [F.sum(F.log1p(x * c / mean)) for c in OVER]


def fitted(n: np.ndarray, mean: np.ndarray, top: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shapes and scales of n excesses with a mean, a largest one and log sums (rows, thetas but 0).

    The theta of least cost ln(xi / theta) + xi + 1 is refined by the parabola through its neighbours; at 0 the fit is
    exponential. Thetas of a shape under -1, where the likelihood has no maximum, are left out.
    """
    theta = np.column_stack([-np.array(UNDER) / top[:, None], np.zeros(len(n)), np.array(OVER) / mean[:, None]])
    z = np.insert(sums / n[:, None], ZERO, 0.0, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        cost = np.log(np.where(theta == 0, mean[:, None], z / np.where(theta == 0, 1, theta))) + z + 1
    cost = np.where((z >= -1) & np.isfinite(cost), cost, np.inf)
    best = cost.argmin(1)
    at = np.clip(best, 1, theta.shape[1] - 2)[:, None] + np.arange(-1, 2)
    c, v, t = (np.take_along_axis(x, at, 1) for x in (cost, z, theta))
    with np.errstate(invalid="ignore"):
        bend = c[:, 0] - 2 * c[:, 1] + c[:, 2]
        inside = (best == at[:, 1]) & np.isfinite(bend) & (bend > 0)
    step = np.where(inside, c[:, 0] - c[:, 2], 0) / 2 / np.where(inside, bend, 1)
    along = lambda f: f[:, 1] + step * (f[:, 2] - f[:, 0]) / 2 + step * step / 2 * (f[:, 0] - 2 * f[:, 1] + f[:, 2])
    rows = np.arange(len(best))
    xi, th = np.where(inside, along(v), z[rows, best]), np.where(inside, along(t), theta[rows, best])
    flat = np.abs(th) * mean < 1e-9
    return xi, np.where(flat, mean, xi / np.where(flat, 1, th))


def gpd_likelihood(over: DataFrame, group: list[str]) -> DataFrame:
    """(group, n, mean, xi, scale) of the excesses ``x`` over 0 of every group: one aggregation gives the ranges, one the log
    sums. Null keys are a group; a group without an excess has no row."""

    @F.pandas_udf("struct<xi: double, scale: double>")
    def fit(n: pd.Series, mean: pd.Series, top: pd.Series, sums: pd.Series) -> pd.DataFrame:
        if not len(n):
            return pd.DataFrame({"xi": np.zeros(0), "scale": np.zeros(0)})
        xi, scale = fitted(*(x.to_numpy(float) for x in (n, mean, top)), np.stack(list(sums)))
        return pd.DataFrame({"xi": xi, "scale": scale})

    rows = over.where(F.col("x") > 0).select(*group, F.col("x").cast("double").alias("x"))
    stats = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.max("x").alias("top")).select(*(F.col(g).alias(f"_{g}") for g in group), "n", "mean", "top")
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    joined = rows.join(stats, same)
    sums = joined.groupBy(*group).agg(F.max("n").alias("n"), F.max("mean").alias("mean"), F.max("top").alias("top"), F.array(*log_sums(F.col("x"), F.col("mean"), F.col("top"))).alias("sums"))
    return sums.withColumn("_fit", fit("n", "mean", "top", "sums")).select(*group, "n", "mean", "_fit.xi", "_fit.scale")


def pooled_tails(cells: DataFrame, radius_km: float, half: int, lat: Column, lon: Column) -> DataFrame:
    """(cell_row, cell_col, n_over, xi, scale): the likeliest tail of the excesses of all cells within ``radius_km`` and ``half``
    rows and columns of each; ``cells`` (cell_row, cell_col, excesses) hold their own. xi and scale are null without any.

    A task has a tile of side 2 * ``half`` with a rim of ``half`` cells, so a cell moves four times at most and no pair of cells is
    a row; the tile's memory is bounded by its cells and years.
    """
    side = 2 * half
    tile = lambda c: F.floor(c / side).cast("int")
    corners = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-half, half) for c in (-half, half)))
    placed = cells.select(*CELL, lat.alias("lat"), lon.alias("lon"), "excesses")
    spread = placed.withColumn("_d", F.explode(corners)).select(tile(F.col("cell_row") + F.col("_d.r")).alias("_tr"), tile(F.col("cell_col") + F.col("_d.c")).alias("_tc"), *CELL, "lat", "lon", "excesses").dropDuplicates(["_tr", "_tc", *CELL])

    def tails(part: pd.DataFrame) -> pd.DataFrame:
        r, c, phi, lam = (part[x].to_numpy() for x in ("cell_row", "cell_col", "lat", "lon"))
        phi, lam = np.radians(phi), np.radians(lam)
        sizes = np.array([0 if x is None else len(x) for x in part["excesses"]])
        flat, owner = np.concatenate([np.zeros(0), *(x for x in part["excesses"] if x is not None)]), np.repeat(np.arange(len(part)), sizes)
        own = np.flatnonzero((r // side == part["_tr"].iloc[0]) & (c // side == part["_tc"].iloc[0]))
        stats, sums = np.zeros((len(own), 3)), np.zeros((len(own), len(UNDER) + len(OVER)))
        for k, i in enumerate(own):
            h = np.sin((phi - phi[i]) / 2) ** 2 + np.cos(phi[i]) * np.cos(phi) * np.sin((lam - lam[i]) / 2) ** 2
            km = np.round(2 * grid.EARTH_KM * np.arcsin(np.sqrt(np.clip(h, 0, 1))), 6)
            x = flat[((km <= radius_km) & (np.abs(r - r[i]) <= half) & (np.abs(c - c[i]) <= half))[owner]]
            if len(x):
                stats[k] = len(x), x.mean(), x.max()
                theta = np.concatenate([-np.array(UNDER) / stats[k, 2], np.array(OVER) / stats[k, 1]])
                for a in range(0, len(x), 4096):
                    sums[k] += np.log1p(np.outer(theta, x[a : a + 4096])).sum(1)
        out = np.full((len(own), 2), np.nan)
        some = stats[:, 0] > 0
        out[some] = np.column_stack(fitted(*stats[some].T, sums[some])) if some.any() else 0
        return pd.DataFrame({"cell_row": r[own], "cell_col": c[own], "n_over": stats[:, 0].astype(int), "xi": out[:, 0], "scale": out[:, 1]})

    found = spread.groupBy("_tr", "_tc").applyInPandas(tails, "cell_row int, cell_col int, n_over long, xi double, scale double")
    return found.select(*CELL, "n_over", F.nanvl("xi", F.lit(None)).alias("xi"), F.nanvl("scale", F.lit(None)).alias("scale"))


def pooled_likelihood(sums: DataFrame, tails: DataFrame, u: float, least: int = 10, least_over: int = 5, smallest: float = 1.27, default: float = 12.7) -> DataFrame:
    """(cell_row, cell_col, p_occ, mu, sigma, xi, scale, u) of every cell from pooled sums (weighted ny, n, s1, s2; plain n_nz) and
    ``pooled_tails``.

    Cells of under ``least`` pooled nonzero years, counted or by weight, have none. Occurrence, mean and deviation (variance at
    least 1e-6) are weighted; the tail of ``least_over`` excesses or more is their likeliest, xi clipped to 0.5 and scale at
    least ``smallest``; with fewer it is exponential with scale ``default``.
    """
    rows = sums.where((F.col("n_nz") >= least) & (F.col("n") >= least)).join(tails, CELL, "left")
    own = (F.col("n_over") >= least_over) & F.col("xi").isNotNull()
    mu = F.col("s1") / F.col("n")
    xi = F.when(own, F.least(F.greatest("xi", F.lit(-0.5)), F.lit(0.5))).otherwise(0.0)
    scale = F.when(own, F.greatest("scale", F.lit(smallest))).otherwise(default)
    return rows.select(*CELL, (F.col("n") / F.col("ny")).alias("p_occ"), mu.alias("mu"), F.sqrt(F.greatest(F.col("s2") / F.col("n") - mu * mu, F.lit(1e-6))).alias("sigma"), xi.alias("xi"), scale.alias("scale"), F.lit(u).alias("u"))


def fits_sql(name: str, source: str, group: str) -> str:
    """Common table expressions that give ``name`` (group, n, mean, xi, scale) from the excesses of ``source`` (group, x)."""
    names = [g.strip() for g in group.split(",")]
    keys, same = ", ".join(f"b.{g}" for g in names), lambda x: " AND ".join(f"b.{g} = {x}.{g}" for g in names)
    along = lambda f: f"CASE WHEN step IS NULL THEN {f} ELSE {f} + step * (h{f} - l{f}) / 2 + step * step / 2 * (l{f} - 2 * {f} + h{f}) END"
    listed = ", ".join([*(f"({k}, {-c!r}::DOUBLE, 0e0)" for k, c in enumerate(UNDER)), *(f"({ZERO + 1 + k}, 0e0, {c!r}::DOUBLE)" for k, c in enumerate(OVER))])
    return f"""{name}_t(k, under, over_) AS (VALUES {listed}),
  {name}_g AS MATERIALIZED (SELECT {group}, count(*) AS n, avg(x) AS mean, max(x) AS top FROM {source} WHERE x > 0 GROUP BY ALL),
  {name}_l AS (SELECT {group}, n, mean, k, under / top + over_ / mean AS theta, sum(ln(1 + x * (under / top + over_ / mean))) AS s FROM {source} JOIN {name}_g USING ({group}), {name}_t WHERE x > 0 GROUP BY ALL),
  {name}_z AS (SELECT {group}, k, theta, n, mean, s / n AS z FROM {name}_l UNION ALL SELECT {group}, {ZERO}, 0e0, n, mean, 0e0 FROM {name}_g),
  {name}_c AS MATERIALIZED (SELECT *, CASE WHEN z < -1 OR (theta <> 0 AND z / theta <= 0) THEN 'Infinity'::DOUBLE WHEN theta = 0 THEN ln(mean) + 1 ELSE ln(z / theta) + z + 1 END AS cost FROM {name}_z),
  {name}_b AS (SELECT * FROM {name}_c QUALIFY row_number() OVER (PARTITION BY {group} ORDER BY cost, k) = 1),
  {name}_s AS (SELECT {keys}, b.n, b.mean, b.z, b.theta, l.z AS lz, h.z AS hz, l.theta AS ltheta, h.theta AS htheta,
    CASE WHEN isfinite(l.cost) AND isfinite(h.cost) AND l.cost - 2 * b.cost + h.cost > 0 THEN (l.cost - h.cost) / 2 / (l.cost - 2 * b.cost + h.cost) END AS step
    FROM {name}_b b LEFT JOIN {name}_c l ON {same('l')} AND l.k = b.k - 1 LEFT JOIN {name}_c h ON {same('h')} AND h.k = b.k + 1),
  {name}_f AS (SELECT {group}, n, mean, {along('z')} AS xi, {along('theta')} AS t FROM {name}_s),
  {name} AS (SELECT {group}, n, mean, xi, CASE WHEN abs(t) * mean < 1e-9 THEN mean ELSE xi / t END AS scale FROM {name}_f)"""
