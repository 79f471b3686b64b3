"""Extreme values: body and tail fits, L-moments, threshold scan, return periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions import specfun
from cellweave.operators.climate import CELL
from cellweave.operators.likelihood import gpd_likelihood
from cellweave.operators.ranks import quantiles, value_ranks


def lognormal_fit(annual: DataFrame, least: int = 3) -> DataFrame:
    """Mean and sample deviation of log maxima of cells with ``least`` or more nonzero years."""
    logs = F.ln("mm")
    return annual.where("mm > 0").groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.avg(logs).alias("mu"), F.stddev_samp(logs).alias("sigma")).where(F.col("n") >= least)


def l_moments(rows: DataFrame, group: list[str], value: str, wide: bool = False) -> DataFrame:
    """Probability-weighted moments b0, b1, b2 and the L-moment ratios, from ranks within a group.

    ``wide`` groups, few and large, are ranked by counts of their values, so that no task holds one: the ranks a to
    a + m - 1 of m equal values add up in closed form.
    """
    v = F.col(value)
    if wide:
        a, m, n = F.col("before"), F.col("n").cast("double"), F.col("total").cast("double")
        end = a + m
        first, second = m * a + m * (m - 1) / 2, (end * (end - 1) * (end - 2) - a * (a - 1) * (a - 2)) / 3
        sums = value_ranks(rows, group, value).where("total >= 3").groupBy(*group).agg(F.max("total").alias("n"), (F.sum(v * m) / F.max(n)).alias("b0"), (F.sum(v * first / (n - 1)) / F.max(n)).alias("b1"), (F.sum(v * second / ((n - 1) * (n - 2))) / F.max(n)).alias("b2"))
    else:
        w = Window.partitionBy(*group)
        ranked = rows.withColumn("_j", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
        j, n = F.col("_j"), F.col("_n")
        sums = ranked.where("_n >= 3").groupBy(*group).agg(F.max("_n").alias("n"), F.avg(v).alias("b0"), F.avg(v * j / (n - 1)).alias("b1"), F.avg(v * j * (j - 1) / ((n - 1) * (n - 2))).alias("b2"))
    l1, l2, l3 = F.col("b0"), F.col("b1") * 2 - F.col("b0"), F.col("b2") * 6 - F.col("b1") * 6 + F.col("b0")
    return sums.select(*group, "n", l1.alias("l1"), l2.alias("l2"), (l2 / F.when(l1 != 0, l1)).alias("l_cv"), (l3 / F.when(l2 != 0, l2)).alias("l_skew"))


def gpd_from_l_moments(moments: DataFrame) -> DataFrame:
    """Shape and scale of a generalized Pareto by Hosking and Wallis (1997); xi > 0 is a heavy tail."""
    k = (F.lit(1.0) - F.col("l_skew") * 3) / (F.col("l_skew") + 1)
    return moments.withColumn("xi", -k).withColumn("scale", F.col("l2") * (k + 1) * (k + 2))


def regional_gpd(annual: DataFrame, region, u: float, least_region: int = 50, least_years: int = 5, least_cell: int = 5) -> DataFrame:
    """Per cell: p_occ's count, threshold, shape of its region, scale from its own or its region's excesses.

    A region with too few excesses has shape 0; shapes are clipped to 0.5. Cells with under ``least_years`` nonzero
    years have no fit.
    """
    rows = annual.where("mm > 0").withColumn("region", region)
    over = rows.where(F.col("mm") > u).withColumn("x", F.col("mm") - u)
    shape = gpd_from_l_moments(l_moments(over, ["region"], "x", wide=True))
    regional = shape.select("region", F.when(F.col("n") >= least_region, F.least(F.greatest("xi", F.lit(-0.5)), F.lit(0.5))).otherwise(0.0).alias("xi"), F.col("l1").alias("mean_excess"))
    cells = rows.groupBy("region", *CELL).agg(F.count(F.lit(1)).alias("n_years_hail"), F.count_if(F.col("mm") > u).alias("n_exc"), F.avg(F.when(F.col("mm") > u, F.col("mm") - u)).alias("own_excess"))
    joined = cells.where(F.col("n_years_hail") >= least_years).join(F.broadcast(regional), "region", "left").withColumn("xi", F.coalesce("xi", F.lit(0.0)))
    excess = F.when(F.col("n_exc") >= least_cell, F.col("own_excess")).when(F.col("n_exc") >= 1, F.col("mean_excess"))
    return joined.select("region", *CELL, "n_exc", "xi", F.lit(u).alias("u"), (excess * (F.lit(1.0) - F.col("xi"))).alias("scale"))


def cell_parameters(annual: DataFrame, n_years: int, region, u: float) -> DataFrame:
    """p_occ, mu, sigma and tail of every cell with a body fit."""
    body = lognormal_fit(annual)
    tail = regional_gpd(annual, region, u).drop("region", "n_exc")
    both = body.join(tail, CELL, "left")
    return both.withColumn("p_occ", F.col("n") / n_years).withColumn("sigma", F.greatest("sigma", F.lit(1e-3))).withColumn("xi", F.coalesce("xi", F.lit(0.0))).withColumn("u", F.coalesce("u", F.lit(u)))


def return_levels(parameters: DataFrame, periods: tuple[int, ...], cap: float = 0.9999, most: float = 300.0) -> DataFrame:
    """(rp, cell, mm): the parameters' quantiles, all in generated code; the tail's probability at most ``cap``."""
    f_u = specfun.normal_cdf("((ln(u) - mu) / sigma)")
    rows = parameters.withColumn("f_u", F.expr(f_u)).withColumn("rp", F.explode(F.array(*map(F.lit, periods))))
    return rows.select("rp", *CELL, F.expr(specfun.return_level("rp", "p_occ", "mu", "sigma", "xi", "scale", "u", "f_u", cap, most)).alias("mm"))


def ks_distance(over: DataFrame, group: list[str]) -> DataFrame:
    """Kolmogorov-Smirnov distance of excesses ``x`` from the group's generalized Pareto (xi, scale), over distinct values
    and their counts."""
    fits = over.groupBy(*group).agg(F.max("xi").alias("xi"), F.max("scale").alias("scale"))
    rows = value_ranks(over.select(*group, "x"), group, "x").join(F.broadcast(fits), group)  # a row a candidate
    x = F.col("x") / F.col("scale")
    cdf = F.when(F.abs("xi") < 1e-6, F.lit(1.0) - F.exp(-x)).otherwise(F.lit(1.0) - F.pow(F.greatest(F.lit(1.0) + F.col("xi") * x, F.lit(1e-12)), F.lit(-1.0) / F.col("xi")))
    low, high = F.col("before") / F.col("total"), (F.col("before") + F.col("n")) / F.col("total")
    return rows.withColumn("_d", F.greatest(high - cdf, cdf - low)).groupBy(*group).agg(F.max("_d").alias("ks"))


def residual_life(fits: DataFrame) -> DataFrame:
    """(region, u, mrl): how far from a line the mean excesses (region, u, l1) at u and the later candidates are: the RMSE
    of the least-squares line over their mean, 1 where they are under three."""
    later = fits.select("region", F.col("u").alias("_v"), F.col("l1").alias("_m"))
    rows = fits.select("region", "u").join(later, "region").where(F.col("_v") >= F.col("u")).groupBy("region", "u")
    n, mean = F.count(F.lit(1)), F.avg("_m")
    miss = F.regr_syy("_m", "_v") - F.pow(F.regr_sxy("_m", "_v"), F.lit(2.0)) / F.regr_sxx("_m", "_v")
    return rows.agg(F.when(n >= 3, F.sqrt(F.greatest(miss, F.lit(0.0)) / n) / F.greatest(mean, F.lit(1e-6))).otherwise(1.0).alias("mrl"))


def threshold_scan(values: DataFrame, percentiles: tuple[int, ...] = tuple(range(50, 95, 5)), least: int = 10, least_values: int = 20, default: float = 50.8, fit: str = "likelihood") -> DataFrame:
    """Scores of threshold candidates u (percentiles of a region's values): fit, mean residual life, stability, count.

    Per candidate with ``least`` or more excesses: shape (within 0.5 of 0) and scale, the likeliest or, where ``fit`` is
    "moments", those of the L-moments, all regions and candidates in one aggregation; KS distance, residual-life
    score, change of shape from the last candidate and 1 / sqrt(n); each scaled to 0..1 within the region (constant: 0,
    missing: 1), score their mean; the least is selected. A region of under ``least_values`` values, or without a
    candidate, has one row: ``default``.
    """
    values = values.where(F.col("mm") > 0)
    points = values.groupBy("region").agg(F.count(F.lit(1)).alias("_n"))
    us = quantiles(values, ["region"], "mm", [p / 100 for p in percentiles]).select("region", F.col("q").alias("u")).distinct()
    candidates = us.join(points.where(F.col("_n") >= least_values), "region").select("region", "u")
    over = values.join(F.broadcast(candidates), "region").where("mm > u").withColumn("x", F.col("mm") - F.col("u"))
    if fit == "moments":
        fits = gpd_from_l_moments(l_moments(over, ["region", "u"], "x", wide=True))
    else:
        fits = gpd_likelihood(over, ["region", "u"]).withColumn("scale", F.greatest("scale", F.lit(1e-6))).withColumnRenamed("mean", "l1")
    fits = fits.where(F.col("n") >= least).select("region", "u", "n", F.least(F.greatest("xi", F.lit(-0.5)), F.lit(0.5)).alias("xi"), "scale", "l1")
    ks = ks_distance(over.join(F.broadcast(fits), ["region", "u"]), ["region", "u"])
    rows = fits.join(ks, ["region", "u"]).join(residual_life(fits), ["region", "u"])
    rows = rows.withColumn("stability", F.abs(F.col("xi") - F.lag("xi").over(Window.partitionBy("region").orderBy("u")))).withColumn("penalty", F.lit(1.0) / F.sqrt("n"))
    w = Window.partitionBy("region")

    def scaled(c):
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return F.when(F.col(c).isNull(), 1.0).when(hi == lo, 0.0).otherwise((F.col(c) - lo) / (hi - lo))

    rows = rows.select("*", ((scaled("ks") + scaled("mrl") + scaled("stability") + scaled("penalty")) / 4).alias("score"))
    first = F.row_number().over(w.orderBy("score", "u"))
    scored = rows.withColumn("selected", (first == 1).cast("int")).select("region", "u", "n", "xi", "ks", "mrl", "score", "selected")
    other = points.join(fits.select("region").distinct(), "region", "left_anti").select("region")
    none = values.join(other, "region").groupBy("region").agg(F.count_if(F.col("mm") > default).alias("n"))
    nothing = [F.lit(None).cast("double").alias(c) for c in ("ks", "mrl", "score")]
    return scored.unionByName(none.select("region", F.lit(default).alias("u"), "n", F.lit(0.0).alias("xi"), *nothing, F.lit(1).alias("selected")))


def pooled_parameters(sums: DataFrame, shapes: DataFrame, region, u: float, least: int = 10, least_over: int = 5) -> DataFrame:
    """Parameters of every cell from pooled sums (weighted ny, n, s1, s2; plain n_nz, n_over, over, x1, x2).

    Cells of under ``least`` pooled nonzero years have none. Occurrence, mean and deviation (variance at least 1e-6) are
    weighted; the tail's scale is the plain mean excess times 1 - xi where ``least_over`` excesses are pooled, else the
    plain deviation, at least 1; xi is the region's (region, xi), 0 without one.
    """
    rows = sums.where(F.col("n_nz") >= least).withColumn("region", region).join(shapes.select("region", "xi"), "region", "left").withColumn("xi", F.coalesce("xi", F.lit(0.0)))
    mu = F.col("s1") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("x2") / F.col("n_nz") - F.pow(F.col("x1") / F.col("n_nz"), F.lit(2.0)), F.lit(0.0)))
    scale = F.when((F.col("n_over") >= least_over) & (F.col("xi") < 1), F.col("over") / F.col("n_over") * (F.lit(1.0) - F.col("xi"))).otherwise(F.greatest(spread, F.lit(1.0)))
    return rows.select(*CELL, (F.col("n") / F.col("ny")).alias("p_occ"), mu.alias("mu"), F.sqrt(F.greatest(F.col("s2") / F.col("n") - mu * mu, F.lit(1e-6))).alias("sigma"), "xi", scale.alias("scale"), F.lit(u).alias("u"))
