"""The first version's statistics: county matching and adjustment, composite quantiles, population debias, smoothing,
rank-correlation decay, and a copula of annual aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.specfun import lit, normal_cdf, normal_quantile
from cellweave.operators.climate import CELL
from cellweave.operators.legacy import clean_county, spearman


def county_lookup(counties: DataFrame) -> DataFrame:
    """(county, state, geoid) of (geoid, county_name, state): one geoid a cleaned name, a county (geoid % 1000 < 500)
    before an independent city, then the least."""
    rows = counties.withColumn("county", clean_county(F.col("county_name")))
    order = Window.partitionBy("county", "state").orderBy((F.col("geoid") % 1000 >= 500).cast("int"), "geoid")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("county", "state", "geoid")


def match_counties(reports: DataFrame, lookup: DataFrame, aliases: DataFrame) -> DataFrame:
    """``reports`` (county_name, state, ...) with geoid, null where unknown; aliases (alias, county) rename first."""
    rows = reports.withColumn("county", clean_county(F.col("county_name"))).join(aliases.withColumnRenamed("county", "_to"), F.col("county") == F.col("alias"), "left")
    rows = rows.withColumn("county", F.coalesce("_to", "county")).drop("_to", "alias")
    return rows.join(lookup, ["county", "state"], "left")


def adjusted_counts(panel: DataFrame, group: str, reference: int, least: int = 5) -> DataFrame:
    """(group, year, beta, adjusted, per_capita) of (group, year, total, population): counts over what a log-log line
    on population predicts, 1 in the reference year where that is there. Groups of under ``least`` usable years and
    counts of 0 have none."""
    rows = panel.where("total > 0 and population > 0").withColumn("_x", F.ln("population")).withColumn("_y", F.ln("total"))
    fits = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.regr_slope("_y", "_x").alias("beta"), F.regr_intercept("_y", "_x").alias("_a")).where((F.col("_n") >= least) & F.col("beta").isNotNull())
    index = rows.join(fits, group).withColumn("_i", F.col("total") / F.exp(F.col("_a") + F.col("beta") * F.col("_x")))
    at = F.coalesce(F.max(F.when(F.col("year") == reference, F.col("_i"))).over(Window.partitionBy(group)), F.lit(1.0))
    return index.select(group, "year", "beta", (F.col("_i") / at).alias("adjusted"), (F.col("total") / F.col("population") * 100000.0).alias("per_capita"))


def broken_stick(rows: DataFrame, group: str, years: tuple[int, int] = (1980, 2023), base: int = 1980, knots: tuple[int, ...] = (1990, 2000, 2010, 2020)) -> DataFrame:
    """(group, year, trend): least squares of log population on a line with knots, for every year of the span.

    Under three positive years the trend is their geometric mean, under as many years as coefficients a plain line. A
    group has a row a year, so it fits a task.
    """
    span = np.arange(years[0], years[1] + 1)
    design = lambda y: np.column_stack([np.ones(len(y)), y - base, *(np.maximum(0.0, y - k) for k in knots)])

    def fit(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part[part["population"] > 0].sort_values("year")
        x, y = part["year"].to_numpy(float), np.log(part["population"].to_numpy(float))
        if len(x) < 3:
            trend = np.full(len(span), np.exp(y.mean()) if len(y) else np.nan)
        else:
            n = 2 if len(x) < len(knots) + 2 else len(knots) + 2
            coefficients = np.linalg.lstsq(design(x)[:, :n], y, rcond=None)[0]
            trend = np.exp(design(span.astype(float))[:, :n] @ coefficients)
        return pd.DataFrame({group: [key[0]] * len(span), "year": span.astype(np.int32), "trend": trend})

    kind = rows.schema[group].dataType.simpleString()
    return rows.select(group, "year", "population").groupBy(group).applyInPandas(fit, f"{group} {kind}, year int, trend double")


def composite_level(rp: str, p: str, mu: str, sigma: str, xi: str, scale: str, u: str, rate: str, top: float = 508.0) -> str:
    """SQL text of the first version's level at ``rp``: a lognormal body, above ``u`` its rest times the tail's
    probability times the exceedance rate, inverted; 0 where the event doesn't occur so often, null over ``top``."""
    q = f"(1 - 1 / ({rp} * {p}))"
    f_u = normal_cdf(f"((ln({u}) - {mu}) / {sigma})")
    g = f"(({q} - ({f_u})) / ((1 - ({f_u})) * {rate}))"
    body = f"exp({mu} + {sigma} * ({normal_quantile(q)}))"
    tail = f"CASE WHEN {g} >= 1 THEN NULL WHEN abs({xi}) < {lit(1e-6)} THEN {u} - {scale} * ln(1 - {g}) ELSE {u} + {scale} / {xi} * (pow(1 - {g}, -{xi}) - 1) END"
    value = f"CASE WHEN {q} <= ({f_u}) OR {scale} IS NULL OR {rate} <= 0 THEN {body} ELSE {tail} END"
    return f"CASE WHEN {p} <= 0 OR 1 / ({rp} * {p}) >= 1 THEN {lit(0.0)} WHEN {value} > {lit(top)} THEN NULL ELSE {value} END"


def nearest_centroid(cells: DataFrame, centroids: DataFrame, lat: Column, lon: Column, most: int = 10_000) -> DataFrame:
    """``cells`` with the name of the nearest of (name, lat, lon) by squared degrees, the first by name on ties. The
    centroids, whose number is checked, are held by each task."""
    rows = [tuple(r) for r in centroids.select("name", "lat", "lon").orderBy("name").limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} centroids")
    names, clat, clon = np.array([r[0] for r in rows]), *(np.array([r[i] for r in rows], float) for i in (1, 2))

    @F.pandas_udf("string")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        out = [names[((a.to_numpy(float)[i : i + 256, None] - clat) ** 2 + (b.to_numpy(float)[i : i + 256, None] - clon) ** 2).argmin(1)] for i in range(0, len(a), 256)]
        return pd.Series(np.concatenate(out) if out else [])

    return cells.withColumn("name", near(lat, lon))


def population_debias(cells: DataFrame, population: DataFrame, betas: DataFrame, reference: int) -> DataFrame:
    """``cells`` (name, year, mm, ...) times (reference population / the year's) ** beta of their county; 1 for years
    without population, a population of 0, and counties without beta."""
    at = population.where(F.col("year") == reference).select("name", F.col("population").alias("_ref"))
    factor = population.join(at, "name").join(betas, "name").select("name", "year", F.when(F.col("population") > 0, F.pow(F.col("_ref") / F.col("population"), F.col("beta"))).otherwise(1.0).alias("_f"))
    return cells.join(factor, ["name", "year"], "left").withColumn("mm", F.col("mm") * F.coalesce("_f", F.lit(1.0))).drop("_f")


def pair_correlations(cells: DataFrame, pairs: DataFrame, least: int = 5) -> DataFrame:
    """(pair, n, rho) of event values (event_id, i, mm) for (pair, i, j): Spearman over the events where either is
    positive, absent ones 0; pairs of under ``least`` such events are left out."""
    one = pairs.select("pair", F.col("i").alias("i")).join(cells, "i").select("pair", "event_id", F.col("mm").alias("x"), F.lit(0.0).alias("y"))
    two = pairs.select("pair", F.col("j").alias("i")).join(cells, "i").select("pair", "event_id", F.lit(0.0).alias("x"), F.col("mm").alias("y"))
    both = one.unionByName(two).groupBy("pair", "event_id").agg(F.max("x").alias("x"), F.max("y").alias("y")).where("x > 0 or y > 0")
    return spearman(both, ["pair"], "x", "y", least)


def binned_correlation(rows: DataFrame, width: float = 100.0, most: float = 2000.0, least: int = 3) -> DataFrame:
    """(km_mid, n, mean, p25, p75) of correlations (km, rho) by distance bin of ``least`` or more; undefined ones left out."""
    some = rows.where(F.col("rho").isNotNull() & ~F.isnan("rho") & (F.col("km") < most))
    q = lambda p: F.percentile("rho", F.lit(p))
    out = some.groupBy(F.floor(F.col("km") / width).alias("_b")).agg(F.count(F.lit(1)).alias("n"), F.avg("rho").alias("mean"), q(0.25).alias("p25"), q(0.75).alias("p75"))
    return out.where(F.col("n") >= least).select(((F.col("_b") + 0.5) * width).alias("km_mid"), "n", "mean", "p25", "p75")


def decay_length(km: np.ndarray, rho: np.ndarray, low: float = 1.0, high: float = 2000.0) -> float:
    """The length that fits rho = exp(-km / length) by least squares; a few numbers, as of distance bins."""
    km, rho = np.asarray(km, float), np.clip(np.asarray(rho, float), 0, 1)
    cost = lambda length: ((np.exp(-km / length) - rho) ** 2).sum()
    grid = np.geomspace(low, high, 200)
    at = int(np.argmin([cost(g) for g in grid]))
    a, b = grid[max(at - 1, 0)], grid[min(at + 1, 199)]
    ratio = (5**0.5 - 1) / 2
    for _ in range(80):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if cost(c) < cost(d) else (c, b)
    return float((a + b) / 2)


def correlation_factor(km: np.ndarray, length: float) -> np.ndarray:
    """Lower Cholesky factor of exp(-km / length), its negative eigenvalues raised to 1e-8 first. For the bounded set of
    cells that the copula has."""
    if not len(km):
        return np.zeros((0, 0))
    model = np.exp(-km / length)
    np.fill_diagonal(model, 1.0)
    values, vectors = np.linalg.eigh(model)
    if values.min() < 1e-8:
        model = vectors @ np.diag(np.maximum(values, 1e-8)) @ vectors.T
        model /= np.sqrt(np.outer(np.diag(model), np.diag(model)))
    return np.linalg.cholesky(model + 1e-12 * np.eye(len(model)))


def inside_polygon_sql(lat: str, lon: str, corners: tuple[tuple[float, float], ...]) -> str:
    """SQL text of whether a point is inside a polygon of (lat, lon) corners: a ray to the east crosses an odd number of
    edges; an edge has its lower end."""
    parts = []
    for (a, b), (c, d) in zip(corners, corners[1:] + corners[:1], strict=True):
        if a != c:
            parts.append(f"CASE WHEN ({lat} >= {min(a, c)!r}e0 AND {lat} < {max(a, c)!r}e0) AND {lon} < {b!r}e0 + ({lat} - {a!r}e0) * ({d - b!r}e0) / ({c - a!r}e0) THEN 1 ELSE 0 END")
    return f"(({' + '.join(parts)}) % 2 = 1)"


def city_curves(levels: DataFrame, cities: DataFrame) -> DataFrame:
    """(city, rp, probability, mm) of levels (rp, cell, mm) at the cities' cells (city, cell): 1 / rp against the level, only
    positive ones."""
    return levels.join(cities, CELL).where("mm > 0").select("city", "rp", (F.lit(1.0) / F.col("rp")).alias("probability"), "mm")
