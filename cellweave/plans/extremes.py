"""Queries over fits and return periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions import specfun
from cellweave.operators import climate, extremes, likelihood
from cellweave.plans.climate import ANNUAL, YEARS, r6
from cellweave.plans.registry import query
from cellweave.sources.shared import keep
from cellweave.sources.tables import CELL_DAY

U = 50.8
PERIODS = (10, 25, 50, 100, 250, 1000, 10000)

BODY = "body AS (SELECT cell_row, cell_col, count(*) AS n, avg(ln(mm)) AS mu, stddev_samp(ln(mm)) AS sigma FROM annual WHERE mm > 0 GROUP BY ALL HAVING count(*) >= 3)"


def moments_sql(name: str, source: str, group: str, value: str) -> str:
    return f"""{name}_r AS (SELECT {group}, {value} AS v, row_number() OVER (PARTITION BY {group} ORDER BY {value}) - 1 AS j, count(*) OVER (PARTITION BY {group}) AS n FROM {source}),
  {name}_b AS (SELECT {group}, max(n) AS n, avg(v) AS b0, avg(v * j / (n - 1)) AS b1, avg(v * j * (j - 1) / ((n - 1) * (n - 2))) AS b2 FROM {name}_r WHERE n >= 3 GROUP BY {group}),
  {name} AS (SELECT {group}, n, b0 AS l1, 2 * b1 - b0 AS l2, (2 * b1 - b0) / nullif(b0, 0) AS l_cv, (6 * b2 - 6 * b1 + b0) / nullif(2 * b1 - b0, 0) AS l_skew FROM {name}_b)"""


XI = "-((1 - 3 * l_skew) / (1 + l_skew))"
SCALE = "l2 * ((1 - 3 * l_skew) / (1 + l_skew) + 1) * ((1 - 3 * l_skew) / (1 + l_skew) + 2)"
TAIL = f"""over AS (SELECT cell_row % 6 AS region, mm - {U}e0 AS x FROM annual WHERE mm > {U}e0), {moments_sql('lm', 'over', 'region', 'x')},
  regional AS (SELECT region, CASE WHEN n >= 50 THEN least(greatest({XI}, -0.5e0), 0.5e0) ELSE 0 END AS xi, l1 AS mean_excess FROM lm),
  tail AS (SELECT region, cell_row, cell_col, n_exc, coalesce(xi, 0) AS xi, {U}e0 AS u,
    CASE WHEN n_exc >= 5 THEN own WHEN n_exc >= 1 THEN mean_excess END * (1 - coalesce(xi, 0)) AS scale
    FROM (SELECT cell_row % 6 AS region, cell_row, cell_col, count(*) AS n, count(*) FILTER (WHERE mm > {U}e0) AS n_exc, avg(CASE WHEN mm > {U}e0 THEN mm - {U}e0 END) AS own FROM annual WHERE mm > 0 GROUP BY ALL)
    LEFT JOIN regional USING (region) WHERE n >= 5)"""
PARAMETERS = f"""parameters AS (SELECT cell_row, cell_col, n / n_years AS p_occ, mu, greatest(sigma, 1e-3) AS sigma, coalesce(xi, 0) AS xi, scale, coalesce(u, {U}e0) AS u
  FROM body LEFT JOIN tail USING (cell_row, cell_col), years)"""


def region():
    """Stand-in regions: rows modulo 6."""
    return F.col("cell_row") % 6


def annual(t):
    return climate.annual_max(t.cell_day())


def parameters(t):
    days = t.cell_day()
    n_years = climate.years_of(days).scalar()
    return extremes.cell_parameters(climate.annual_max(days), n_years, region(), U)


def levels_sql(periods) -> str:
    value = specfun.return_level("rp", "p_occ", "mu", "sigma", "xi", "scale", "u", "f_u")
    f_u = specfun.normal_cdf("((ln(u) - mu) / sigma)")
    return f"levels AS (SELECT rp, cell_row, cell_col, {value} AS mm FROM (SELECT *, {f_u} AS f_u, unnest({list(periods)}) AS rp FROM parameters))"


CHAIN = (CELL_DAY, ANNUAL, YEARS, BODY, TAIL, PARAMETERS)


@query(CELL_DAY, ANNUAL, BODY, sql="SELECT cell_row, cell_col, n, round(mu, 6) AS mu, round(sigma, 6) AS sigma FROM body")
def lognormal_fit(t):
    return extremes.lognormal_fit(annual(t)).select(*climate.CELL, "n", *r6("mu", "sigma"))


@query(CELL_DAY, ANNUAL, moments_sql("lm", "(SELECT * FROM annual WHERE mm > 0)", "cell_row, cell_col", "mm"), sql="SELECT cell_row, cell_col, n, round(l1, 6) AS l1, round(l2, 6) AS l2, round(l_cv, 6) AS l_cv, round(l_skew, 6) AS l_skew FROM lm")
def lmoment_ratios(t):
    out = extremes.l_moments(annual(t).where("mm > 0"), climate.CELL, "mm")
    return out.select(*climate.CELL, "n", *r6("l1", "l2", "l_cv", "l_skew"))


@query(CELL_DAY, ANNUAL, f"over AS (SELECT cell_row % 6 AS region, mm - {U}e0 AS x FROM annual WHERE mm > {U}e0)", moments_sql("lm", "over", "region", "x"), sql=f"SELECT region, n, round({XI}, 6) AS xi, round({SCALE}, 6) AS scale FROM lm")
def gpd_lmoment_fit(t):
    over = annual(t).where(F.col("mm") > U).select(region().alias("region"), (F.col("mm") - U).alias("x"))
    return extremes.gpd_from_l_moments(extremes.l_moments(over, ["region"], "x", wide=True)).select("region", "n", *r6("xi", "scale"))


@query(CELL_DAY, ANNUAL, TAIL, sql="SELECT region, cell_row, cell_col, n_exc, round(xi, 6) AS xi, round(scale, 6) AS scale FROM tail")
def regional_gpd(t):
    return extremes.regional_gpd(annual(t), region(), U).select("region", *climate.CELL, "n_exc", *r6("xi", "scale"))


@query(*CHAIN, levels_sql(PERIODS), sql="SELECT rp, cell_row, cell_col, round(mm, 4) AS mm FROM levels")
def return_periods(t):
    return extremes.return_levels(parameters(t), PERIODS).select("rp", *climate.CELL, F.round("mm", 4).alias("mm"))


@query(*CHAIN, levels_sql(PERIODS), sql="SELECT rp, round(max(mm), 4) AS max_mm, round(avg(mm), 4) AS mean_mm, count(*) FILTER (WHERE mm >= 25.4) AS damage_cells FROM levels GROUP BY rp")
def return_period_summary(t):
    levels = extremes.return_levels(parameters(t), PERIODS)
    return levels.groupBy("rp").agg(F.round(F.max("mm"), 4).alias("max_mm"), F.round(F.avg("mm"), 4).alias("mean_mm"), F.count_if(F.col("mm") >= 25.4).alias("damage_cells"))


@query(*CHAIN, levels_sql(PERIODS), sql="SELECT count(*) AS pairs, count(*) FILTER (WHERE hi < lo - 0.5) AS falls, CASE WHEN count(*) FILTER (WHERE hi < lo - 0.5) > 0 THEN 'fail' ELSE 'pass' END AS status FROM (SELECT max(mm) AS hi, lag(max(mm)) OVER (ORDER BY rp) AS lo FROM levels GROUP BY rp) WHERE lo IS NOT NULL")
def rp_monotonicity(t):
    from pyspark.sql import Window

    peaks = extremes.return_levels(parameters(t), PERIODS).groupBy("rp").agg(F.max("mm").alias("hi"))
    pairs = peaks.withColumn("lo", F.lag("hi").over(Window.orderBy("rp"))).where("lo is not null")
    falls = F.count_if(F.col("hi") < F.col("lo") - 0.5)
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), falls.alias("falls"), F.when(falls > 0, "fail").otherwise("pass").alias("status"))


CANDIDATES = f"""vals AS (SELECT cell_row % 6 AS region, mm FROM annual WHERE mm > 0),
  cands AS (SELECT DISTINCT region, u FROM (SELECT region, unnest(quantile_cont(mm, [{', '.join(str(p / 100) for p in range(50, 95, 5))}])) AS u FROM vals GROUP BY region HAVING count(*) >= 20)),
  over AS (SELECT region, u, mm - u AS x FROM vals JOIN cands USING (region) WHERE mm > u)"""
MOMENT_FITS = f"""{moments_sql('lm', 'over', 'region, u', 'x')},
  fits AS (SELECT region, u, n, least(greatest({XI}, -0.5e0), 0.5e0) AS xi, {SCALE} AS scale, l1 FROM lm WHERE n >= 10)"""
LIKELY_FITS = f"""{likelihood.fits_sql('ml', 'over', 'region, u')},
  fits AS (SELECT region, u, n, least(greatest(xi, -0.5e0), 0.5e0) AS xi, greatest(scale, 1e-6) AS scale, mean AS l1 FROM ml WHERE n >= 10)"""
SCORES = f"""cdfs AS (SELECT region, u, row_number() OVER w AS i, count(*) OVER (PARTITION BY region, u) AS n,
    CASE WHEN abs(xi) < 1e-6 THEN 1 - exp(-x / scale) ELSE 1 - pow(greatest(1 + xi * x / scale, 1e-12), -1 / xi) END AS f FROM over JOIN fits USING (region, u) WINDOW w AS (PARTITION BY region, u ORDER BY x)),
  kss AS (SELECT region, u, max(greatest(i / n - f, f - (i - 1) / n)) AS ks FROM cdfs GROUP BY region, u),
  mrls AS (SELECT a.region, a.u, CASE WHEN count(*) >= 3 THEN sqrt(greatest(regr_syy(b.l1, b.u) - pow(regr_sxy(b.l1, b.u), 2) / regr_sxx(b.l1, b.u), 0) / count(*)) / greatest(avg(b.l1), 1e-6) ELSE 1 END AS mrl FROM fits a JOIN fits b ON a.region = b.region AND b.u >= a.u GROUP BY ALL),
  parts AS (SELECT *, abs(xi - lag(xi) OVER (PARTITION BY region ORDER BY u)) AS stability, 1 / sqrt(n) AS penalty FROM fits JOIN kss USING (region, u) JOIN mrls USING (region, u)),
  scored AS (SELECT *, ({' + '.join(f"CASE WHEN {c} IS NULL THEN 1 WHEN max({c}) OVER r = min({c}) OVER r THEN 0 ELSE ({c} - min({c}) OVER r) / (max({c}) OVER r - min({c}) OVER r) END" for c in ('ks', 'mrl', 'stability', 'penalty'))}) / 4 AS score FROM parts WINDOW r AS (PARTITION BY region))"""


SCANNED = "SELECT region, round(u, 4) AS u, n, round(xi, 4) AS xi, round(ks, 4) AS ks, round(mrl, 4) AS mrl, round(score, 4) AS score, CAST(row_number() OVER (PARTITION BY region ORDER BY score, u) = 1 AS INTEGER) AS selected FROM scored UNION ALL SELECT region, 50.8, count(*) FILTER (WHERE mm > 50.8), 0, NULL, NULL, NULL, 1 FROM vals WHERE region NOT IN (SELECT region FROM fits) GROUP BY region"


def scanned(t, fit):
    out = extremes.threshold_scan(keep(annual(t).where("mm > 0").select(region().alias("region"), "mm"), "values"), fit=fit)
    r4 = [F.round(c, 4).alias(c) for c in ("u", "xi", "ks", "mrl", "score")]
    return out.select("region", r4[0], "n", *r4[1:], "selected")


@query(CELL_DAY, ANNUAL, CANDIDATES, LIKELY_FITS, SCORES, sql=SCANNED)
def threshold_scan(t):
    """Threshold candidates of every region with their likeliest fits."""
    return scanned(t, "likelihood")


@query(CELL_DAY, ANNUAL, CANDIDATES, MOMENT_FITS, SCORES, sql=SCANNED)
def threshold_scan_moments(t):
    """The same with fits by L-moments."""
    return scanned(t, "moments")


@query(CELL_DAY, ANNUAL, f"over AS (SELECT cell_row % 6 AS region, mm - {U}e0 AS x FROM annual WHERE mm > {U}e0)", likelihood.fits_sql("ml", "over", "region"), sql="SELECT region, n, round(mean, 4) AS mean, round(xi, 4) AS xi, round(scale, 4) AS scale FROM ml")
def gpd_profile_fit(t):
    """Likeliest tails of the regions, from one aggregation."""
    over = annual(t).where(F.col("mm") > U).select(region().alias("region"), (F.col("mm") - U).alias("x"))
    return likelihood.gpd_likelihood(over, ["region"]).select("region", "n", *(F.round(c, 4).alias(c) for c in ("mean", "xi", "scale")))
