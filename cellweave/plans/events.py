"""Queries over sites, overlaps, events and pooling."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions import grid, specfun
from cellweave.operators import climate, events, extremes, likelihood, nearest, spatial
from cellweave.plans.climate import ANNUAL, YEARS, r6
from cellweave.plans.extremes import PERIODS, TAIL, U, levels_sql, region
from cellweave.plans.registry import query
from cellweave.sources.shared import keep
from cellweave.sources.tables import CELL_DAY, CELL_DAY_FINE, SITE



def center():
    """Latitude and longitude of a row's cell."""
    return grid.cell_center(F.col("cell_row"), F.col("cell_col"))


LAT_SQL, LON_SQL = "(50.005e0 - (cell_row + 0.5e0) * 0.05e0)", "(-125.005e0 + (cell_col + 0.5e0) * 0.05e0)"
BUFFER, AREA = 4, 23.5


def active(t):
    return t.cell_day().where(F.col("mm") >= grid.EVENT_MM)


@query(CELL_DAY_FINE, SITE, "cells AS (SELECT DISTINCT cell_row, cell_col FROM cell_day_fine)", f"d AS (SELECT cell_row, cell_col, site_idx, round({grid.haversine_sql(LAT_SQL, LON_SQL, 'site_lat', 'site_lon')}, 6) AS km FROM cells, site)", sql="SELECT cell_row, cell_col, arg_min(site_idx, (km, site_idx)) AS site_idx, round(min(km), 2) AS km FROM d GROUP BY ALL")
def nearest_site(t):
    cells = t.cell_day_fine().select(*climate.CELL).distinct()
    return nearest.nearest_site(cells, t.site(), *center(), keep).withColumn("km", F.round("km", 2))


ACTIVE = "act AS (SELECT * FROM cell_day WHERE mm >= 29)"
STEPS = f"""foot AS (SELECT day, max(mm) AS peak, sum({LAT_SQL} * mm) / sum(mm) AS lat, sum({LON_SQL} * mm) / sum(mm) AS lon FROM act GROUP BY day),
  lagged AS (SELECT *, lag(day) OVER w AS prev_day, lag(peak) OVER w AS prev_peak, lag(lat) OVER w AS prev_lat, lag(lon) OVER w AS prev_lon, row_number() OVER w AS rn FROM foot WINDOW w AS (ORDER BY day)),
  steps AS (SELECT *, day - prev_day AS gap, round({grid.haversine_sql('prev_lat', 'prev_lon', 'lat', 'lon')} / greatest(day - prev_day, 1), 6) AS speed, round(greatest(peak, prev_peak) / greatest(least(peak, prev_peak), 1e-6), 6) AS ratio FROM lagged),
  near AS (SELECT DISTINCT a.day FROM steps s JOIN act a ON a.day = s.day JOIN act b ON b.day = s.prev_day WHERE s.gap <= 2 AND abs(a.cell_row - b.cell_row) <= {BUFFER} AND abs(a.cell_col - b.cell_col) <= {BUFFER})"""
GROUPS = """flagged AS (SELECT rn, day, speed, ratio, CASE WHEN gap <= 2 AND day IN (SELECT day FROM near) AND speed <= 150 AND ratio <= 3 THEN 0 ELSE 1 END AS new FROM steps),
  walk AS (SELECT rn, day, day AS start, 0 AS event_id, speed, ratio FROM flagged WHERE rn = 1 UNION ALL
    SELECT f.rn, f.day, CASE WHEN f.new = 1 OR f.day - w.start >= 5 THEN f.day ELSE w.start END, w.event_id + CASE WHEN f.new = 1 OR f.day - w.start >= 5 THEN 1 ELSE 0 END, f.speed, f.ratio FROM walk w JOIN flagged f ON f.rn = w.rn + 1),
  ev AS (SELECT event_id, day, CASE WHEN start <> day THEN speed END AS speed, CASE WHEN start <> day THEN ratio END AS ratio FROM walk),
  ecells AS (SELECT event_id, cell_row, cell_col, max(mm) AS mm FROM act JOIN ev USING (day) GROUP BY ALL)"""


def grouped(t):
    return events.event_days(active(t), *center(), BUFFER)


@query(CELL_DAY, ACTIVE, STEPS, sql="SELECT day FROM near")
def footprint_overlap(t):
    cells = active(t)
    steps = events.day_steps(events.daily_footprints(cells, *center())).where("gap <= 2").select("day", "prev_day")
    return spatial.overlapping_days(cells, steps, BUFFER)


@query(CELL_DAY, ACTIVE, STEPS, GROUPS, sql="SELECT event_id, day, round(speed, 4) AS speed, round(ratio, 4) AS ratio FROM ev")
def event_groups(t):
    return grouped(t).select("event_id", "day", F.round("speed", 4).alias("speed"), F.round("ratio", 4).alias("ratio"))


@query(CELL_DAY, ACTIVE, STEPS, GROUPS, sql="SELECT event_id, cell_row, cell_col, round(mm, 6) AS mm FROM ecells")
def event_cells(t):
    return events.event_cells(grouped(t), active(t)).select("event_id", *climate.CELL, *r6("mm"))


CATALOG = f"""cat AS (SELECT event_id, n_active_cells, peak_hail_mm, mean_hail_mm, centroid_lat, centroid_lon, start_date, end_date, speed AS centroid_speed_km_day, ratio AS max_intensity_jump_ratio, end_date - start_date + 1 AS duration_days, n_active_cells * {AREA}e0 AS footprint_area_km2, dayofyear(start_date) AS doy
  FROM (SELECT event_id, count(*) AS n_active_cells, max(mm) AS peak_hail_mm, avg(mm) AS mean_hail_mm, sum({LAT_SQL} * mm) / sum(mm) AS centroid_lat, sum({LON_SQL} * mm) / sum(mm) AS centroid_lon FROM ecells GROUP BY event_id)
  JOIN (SELECT event_id, min(day) AS start_date, max(day) AS end_date, coalesce(max(speed), 0) AS speed, coalesce(max(ratio), 1) AS ratio FROM ev GROUP BY event_id) USING (event_id))"""


def catalog(t):
    days = grouped(t)
    return events.event_catalog(days, events.event_cells(days, active(t)), *center(), AREA)


@query(CELL_DAY, ACTIVE, STEPS, GROUPS, CATALOG, sql="SELECT event_id, start_date, end_date, duration_days, n_active_cells, footprint_area_km2, round(peak_hail_mm, 4) AS peak_hail_mm, round(mean_hail_mm, 4) AS mean_hail_mm, round(centroid_lat, 4) AS centroid_lat, round(centroid_lon, 4) AS centroid_lon, doy, round(centroid_speed_km_day, 4) AS centroid_speed_km_day, round(max_intensity_jump_ratio, 4) AS max_intensity_jump_ratio, CASE WHEN centroid_speed_km_day <= 150 AND max_intensity_jump_ratio <= 3 THEN 'ok' ELSE 'review' END AS merge_quality_flag FROM cat")
def event_catalog(t):
    r4 = {c: F.round(c, 4).alias(c) for c in ("peak_hail_mm", "mean_hail_mm", "centroid_lat", "centroid_lon", "centroid_speed_km_day", "max_intensity_jump_ratio")}
    out = catalog(t)
    return out.select(*(r4.get(c, F.col(c)) for c in out.columns))


@query(CELL_DAY, ACTIVE, STEPS, GROUPS, CATALOG, sql="SELECT duration_days, count(*) AS n, round(avg(n_active_cells), 6) AS mean_cells, round(median(peak_hail_mm), 6) AS median_peak, round(max(peak_hail_mm), 6) AS max_peak FROM cat GROUP BY duration_days")
def event_summary(t):
    return catalog(t).groupBy("duration_days").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_active_cells"), 6).alias("mean_cells"), F.round(F.median("peak_hail_mm"), 6).alias("median_peak"), F.round(F.max("peak_hail_mm"), 6).alias("max_peak"))


RADIUS, DECAY, HALF = 150.0, 75.0, 29
STATS = "stats AS (SELECT cell_row, cell_col, count(*) * 1e0 AS n, sum(ln(mm)) AS s1, sum(ln(mm) * ln(mm)) AS s2 FROM annual WHERE mm > 0 GROUP BY ALL)"
POOL = f"""pairs AS (SELECT a.cell_row, a.cell_col, b.n, b.s1, b.s2, round({grid.haversine_sql(*(x.replace('cell_', p + '.cell_') for p in ('a', 'b') for x in (LAT_SQL, LON_SQL)))}, 6) AS km
    FROM stats a JOIN stats b ON abs(a.cell_row - b.cell_row) <= {HALF} AND abs(a.cell_col - b.cell_col) <= {HALF}),
  pool AS (SELECT cell_row, cell_col, count(*) AS partners, sum(exp(-km / {DECAY}e0)) AS weight, sum(exp(-km / {DECAY}e0) * n) AS n, sum(exp(-km / {DECAY}e0) * s1) AS s1, sum(exp(-km / {DECAY}e0) * s2) AS s2 FROM pairs WHERE km <= {RADIUS} GROUP BY ALL)"""


def pool(t):
    logs = F.ln("mm")
    stats = climate.annual_max(t.cell_day()).where("mm > 0").groupBy(*climate.CELL).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(logs).alias("s1"), F.sum(logs * logs).alias("s2"))
    return spatial.pooled(stats, RADIUS, DECAY, HALF, *center(), ["n", "s1", "s2"])


@query(CELL_DAY, ANNUAL, STATS, POOL, sql="SELECT cell_row, cell_col, partners, round(s1 / n, 6) AS mu, round(sqrt(greatest(s2 / n - (s1 / n) * (s1 / n), 1e-6)), 6) AS sigma FROM pool")
def pooled_cdf(t):
    """Distance-weighted log-moments of annual maxima within 150 km, variance at least 1e-6."""
    mu = F.col("s1") / F.col("n")
    return pool(t).select(*climate.CELL, "partners", F.round(mu, 6).alias("mu"), F.round(F.sqrt(F.greatest(F.col("s2") / F.col("n") - mu * mu, F.lit(1e-6))), 6).alias("sigma"))


@query(CELL_DAY, ANNUAL, YEARS, STATS, POOL, sql="SELECT cell_row, cell_col, round(n / weight / (SELECT n_years FROM years), 6) AS p_occ FROM pool")
def pooled_occurrence(t):
    return pool(t).select(*climate.CELL, F.round(F.col("n") / F.col("weight") / climate.years_of(t.cell_day()).scalar(), 6).alias("p_occ"))


_PAIR_KM = grid.haversine_sql(*(x.replace('cell_', p + '.cell_') for p in ('a', 'b') for x in (LAT_SQL, LON_SQL)))
POOLED_FIT = f"""pstats AS (SELECT cell_row, cell_col, (SELECT n_years FROM years) * 1e0 AS ny, count(*) * 1e0 AS n, sum(ln(mm)) AS s1, sum(ln(mm) * ln(mm)) AS s2, count(*) FILTER (WHERE mm > {U}) AS n_over, coalesce(sum(mm - {U}) FILTER (WHERE mm > {U}), 0) AS over, sum(mm) AS x1, sum(mm * mm) AS x2 FROM annual WHERE mm > 0 GROUP BY ALL),
  ppairs AS (SELECT a.cell_row, a.cell_col, b.* EXCLUDE (cell_row, cell_col), round({_PAIR_KM}, 6) AS km FROM pstats a JOIN pstats b ON abs(a.cell_row - b.cell_row) <= {HALF} AND abs(a.cell_col - b.cell_col) <= {HALF}),
  psums AS (SELECT cell_row, cell_col, sum(exp(-km / {DECAY}e0) * ny) AS ny, sum(exp(-km / {DECAY}e0) * n) AS n, sum(exp(-km / {DECAY}e0) * s1) AS s1, sum(exp(-km / {DECAY}e0) * s2) AS s2, sum(n) AS n_nz, sum(n_over) AS n_over, sum(over) AS over, sum(x1) AS x1, sum(x2) AS x2 FROM ppairs WHERE km <= {RADIUS} GROUP BY ALL HAVING sum(n) >= 10),
  parameters AS (SELECT cell_row, cell_col, n / ny AS p_occ, s1 / n AS mu, sqrt(greatest(s2 / n - (s1 / n) * (s1 / n), 1e-6)) AS sigma, coalesce(xi, 0) AS xi, {U}e0 AS u,
    CASE WHEN n_over >= 5 AND coalesce(xi, 0) < 1 THEN over / n_over * (1 - coalesce(xi, 0)) ELSE greatest(sqrt(greatest(x2 / n_nz - pow(x1 / n_nz, 2), 0)), 1) END AS scale FROM psums LEFT JOIN regional ON region = cell_row % 6)"""


@query(CELL_DAY, ANNUAL, YEARS, TAIL, POOLED_FIT, levels_sql(PERIODS), sql="SELECT rp, cell_row, cell_col, round(mm, 4) AS mm FROM levels")
def smooth_levels(t):
    """Return levels of the fits pooled over 150 km, with the region's tail shape."""
    days = t.cell_day()
    annual, logs, over = climate.annual_max(days).where("mm > 0"), F.ln("mm"), F.col("mm") - U
    stats = annual.groupBy(*climate.CELL).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(logs).alias("s1"), F.sum(logs * logs).alias("s2"), F.count_if(over > 0).alias("n_over"), F.sum(F.when(over > 0, over).otherwise(0.0)).alias("over"), F.sum("mm").alias("x1"), F.sum(F.col("mm") * F.col("mm")).alias("x2"))
    stats = stats.withColumn("ny", climate.years_of(days).scalar().cast("double")).withColumn("n_nz", F.col("n"))
    sums = spatial.pooled(stats, RADIUS, DECAY, HALF, *center(), ["ny", "n", "s1", "s2"], ("n_nz", "n_over", "over", "x1", "x2"))
    excess = annual.where(over > 0).select(region().alias("region"), over.alias("x"))
    shapes = extremes.gpd_from_l_moments(extremes.l_moments(excess, ["region"], "x", wide=True)).select("region", F.when(F.col("n") >= 50, F.least(F.greatest("xi", F.lit(-0.5)), F.lit(0.5))).otherwise(0.0).alias("xi"))
    return extremes.return_levels(extremes.pooled_parameters(sums, shapes, region(), U), PERIODS).select("rp", *climate.CELL, F.round("mm", 4).alias("mm"))


LIKELY_POOL = f"""near_cells AS (SELECT a.cell_row, a.cell_col, b.cell_row AS r2, b.cell_col AS c2, round({_PAIR_KM}, 6) AS km FROM pstats a JOIN pstats b ON abs(a.cell_row - b.cell_row) <= {HALF} AND abs(a.cell_col - b.cell_col) <= {HALF}),
  pool_over AS (SELECT p.cell_row, p.cell_col, mm - {U} AS x FROM near_cells p JOIN annual b ON b.cell_row = p.r2 AND b.cell_col = p.c2 WHERE km <= {RADIUS} AND mm > {U}),
  {likelihood.fits_sql('ml', 'pool_over', 'cell_row, cell_col')},
  likely AS (SELECT cell_row, cell_col, p.n / p.ny AS p_occ, s1 / p.n AS mu, sqrt(greatest(s2 / p.n - (s1 / p.n) * (s1 / p.n), 1e-6)) AS sigma, {U}e0 AS u,
    CASE WHEN ml.n >= 5 THEN least(greatest(xi, -0.5e0), 0.5e0) ELSE 0 END AS xi, CASE WHEN ml.n >= 5 THEN greatest(scale, 1.27e0) ELSE 12.7e0 END AS scale
    FROM psums p LEFT JOIN ml USING (cell_row, cell_col) WHERE p.n >= 10)"""
V1_PERIODS = (10, 25, 50, 100, 200, 250, 500)
LIKELY_LEVELS = f"levels AS (SELECT rp, cell_row, cell_col, {specfun.return_level('rp', 'p_occ', 'mu', 'sigma', 'xi', 'scale', 'u', 'f_u', 1 - 1e-9, 508.0)} AS mm FROM (SELECT *, {specfun.normal_cdf('((ln(u) - mu) / sigma)')} AS f_u, unnest({list(V1_PERIODS)}) AS rp FROM likely))"


@query(CELL_DAY, ANNUAL, YEARS, "regional AS (SELECT 0 AS region, 0e0 AS xi)", POOLED_FIT, LIKELY_POOL, LIKELY_LEVELS, sql="SELECT rp, cell_row, cell_col, round(mm, 4) AS mm FROM levels")
def pooled_likelihood_levels(t):
    """Return levels of fits pooled over 150 km, each tail the likeliest of the pooled excesses."""
    days = t.cell_day()
    annual, logs, over = keep(climate.annual_max(days).where("mm > 0"), "annual"), F.ln("mm"), F.col("mm") - U
    n_years = climate.years_of(days).scalar().cast("double")
    stats = annual.groupBy(*climate.CELL).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(logs).alias("s1"), F.sum(logs * logs).alias("s2"), F.collect_list(F.when(over > 0, over)).alias("excesses"))
    stats = keep(stats.withColumn("ny", n_years).withColumn("n_nz", F.col("n")), "cell-sums")
    sums = spatial.pooled(stats, RADIUS, DECAY, HALF, *center(), ["ny", "n", "s1", "s2"], ("n_nz",))
    fitted = likelihood.pooled_likelihood(sums, likelihood.pooled_tails(stats, RADIUS, HALF, *center()), U)
    return extremes.return_levels(fitted, V1_PERIODS, 1 - 1e-9, 508.0).select("rp", *climate.CELL, F.round("mm", 4).alias("mm"))


BANDS = ((50, 150), (150, 300), (300, 600))


def _cut(lo: str) -> str:
    return " ".join(f"WHEN km >= {a} AND km < {b} THEN {a}" for a, b in BANDS)


TAILS = f"""peaks AS (SELECT cell_row, cell_col, max(mm) AS mm FROM annual WHERE year BETWEEN 1996 AND 1998 GROUP BY ALL HAVING max(mm) >= 25.4),
  picked AS MATERIALIZED (SELECT *, mm >= 50 AS hit FROM peaks),
  tpairs AS (SELECT a.hit AND b.hit AS both_hit, round({grid.haversine_sql('(49e0 - a.cell_row * 1.25e0)', '(-120e0 + a.cell_col * 2e0)', '(49e0 - b.cell_row * 1.25e0)', '(-120e0 + b.cell_col * 2e0)')}, 6) AS km FROM picked a JOIN picked b ON (a.cell_row, a.cell_col) < (b.cell_row, b.cell_col)),
  chis AS (SELECT CASE {_cut('km')} END AS km_from, count(*) AS pairs, count(*) FILTER (WHERE both_hit) / count(*) / greatest(pow((SELECT avg(CAST(hit AS INTEGER)) FROM picked), 2), 1e-9) AS chi FROM tpairs GROUP BY 1)"""


@query(CELL_DAY, ANNUAL, TAILS, sql="SELECT km_from, pairs, round(chi, 6) AS chi FROM chis WHERE km_from IS NOT NULL")
def tail_dependence(t):
    """chi of joint exceedance of 50 mm by distance band, over all pairs of cells up to 600 km apart."""
    return tails(t).select("km_from", "pairs", F.round("chi", 6).alias("chi"))


def tails(t):
    peaks = climate.annual_max(t.cell_day()).where("year between 1996 and 1998").groupBy(*climate.CELL).agg(F.max("mm").alias("mm")).where("mm >= 25.4")
    cells = peaks.select(*climate.CELL, (F.lit(49.0) - F.col("cell_row") * 1.25).alias("lat"), (F.lit(-120.0) + F.col("cell_col") * 2.0).alias("lon"), (F.col("mm") >= 50).alias("hit"))
    return spatial.joint_exceedance(keep(cells, "tail-cells"), BANDS)
