"""Queries over artefact passes, on the daily maxima of the point observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions import clock, grid, quality
from cellweave.operators import artefacts, climate, nearest, spatial
from cellweave.plans.climate import CLEAN, r6
from cellweave.plans.registry import query
from cellweave.sources.shared import keep
from cellweave.sources.tables import COLS, OBS, ROWS, SITE

KM, SECTOR = 100.0, 90.0
DAYS = f"raster AS (SELECT CAST(ts - INTERVAL 12 HOUR AS DATE) AS day, cell_row, cell_col, max({CLEAN}) AS mm FROM obs GROUP BY ALL HAVING max({CLEAN}) > 0)"
ANNULI = f"""gridc AS (SELECT range // {COLS} AS cell_row, range % {COLS} AS cell_col, 49e0 - range // {COLS} * 1.25e0 AS lat, -120e0 + range % {COLS} * 2e0 AS lon FROM range({ROWS * COLS})),
  sited AS (SELECT cell_row, cell_col, lat, lon, arg_min((site_idx, site_lat, site_lon), (km, site_idx)) AS s, min(km) AS km FROM (SELECT *, round({grid.haversine_sql('lat', 'lon', 'site_lat', 'site_lon')}, 6) AS km FROM gridc, site) GROUP BY ALL),
  annuli AS (SELECT cell_row, cell_col, km, s[1] AS site_idx, CAST(least(floor(km / {KM}e0), 39) AS INTEGER) AS bin,
    CAST(floor(round((degrees(atan2((lon - s[3]) * cos(radians(s[2])), lat - s[2])) + 360e0) % 360e0, 6) / {SECTOR}e0) AS INTEGER) % 4 AS sector FROM sited)"""


def raster(t):
    clean = t.obs().withColumn("mm", quality.sanitize(F.col("mm")))
    return climate.cell_day_max(clean, clock.convective_day(F.col("ts"))).where("mm > 0")


def annuli(t):
    cells = t.spark.range(ROWS * COLS).select(F.floor(F.col("id") / COLS).cast("int").alias("cell_row"), (F.col("id") % COLS).cast("int").alias("cell_col"))
    lat, lon = F.lit(49.0) - F.col("cell_row") * 1.25, F.lit(-120.0) + F.col("cell_col") * 2.0
    sites = t.site()
    near = nearest.nearest_site(cells, sites, lat, lon, keep).join(sites, "site_idx")
    azimuth = F.round(grid.azimuth_deg(F.col("site_lat"), F.col("site_lon"), lat, lon), 6)
    return near.withColumn("lat", lat).withColumn("lon", lon).select(*climate.CELL, "km", "lat", "lon", "site_lat", "site_lon", "site_idx", grid.range_bin(F.col("km"), KM).alias("bin"), (F.floor(azimuth / SECTOR) % 4).cast("int").alias("sector"))


def shown(t, cells):
    return cells.select("day", *climate.CELL, *r6("mm"))


def median_sql(half: int, least: str) -> str:
    return f"""med AS (SELECT t.day, t.cell_row, t.cell_col, any_value(t.mm) AS mm, median(coalesce(v.mm, 0)) AS med FROM raster t, range(-{half}, {half + 1}) dr(a), range(-{half}, {half + 1}) dc(b)
  LEFT JOIN raster v ON v.day = t.day AND v.cell_row = least(greatest(t.cell_row + a, 0), {ROWS - 1}) AND v.cell_col = least(greatest(t.cell_col + b, 0), {COLS - 1}) WHERE t.mm {least} GROUP BY ALL)"""


ZEROED = "SELECT r.day, r.cell_row, r.cell_col, round(CASE WHEN {hit} THEN 0 ELSE r.mm END, 6) AS mm FROM raster r {joins}"


@query(OBS, DAYS, median_sql(1, ">= 5"), sql=ZEROED.format(hit="r.mm >= 5 AND r.mm > 2.5 * greatest(med, 1)", joins="LEFT JOIN med m USING (day, cell_row, cell_col)"))
def speckle_filter(t):
    return shown(t, artefacts.speckle(raster(t), ROWS, COLS))


@query(OBS, DAYS, median_sql(2, "> 20"), sql=ZEROED.format(hit="med < 15 AND r.mm > med + 20", joins="LEFT JOIN med m USING (day, cell_row, cell_col)"))
def filament_filter(t):
    return shown(t, artefacts.filament(raster(t), ROWS, COLS, half=2))


def ring_sql(by: str, least: int) -> str:
    return f"meds AS (SELECT day, {by}, median(mm) AS med FROM raster JOIN annuli USING (cell_row, cell_col) WHERE mm >= 5 GROUP BY ALL HAVING count(*) >= {least})"


@query(OBS, SITE, DAYS, ANNULI, ring_sql("site_idx, bin", 8), sql=ZEROED.format(hit="med IS NOT NULL AND r.mm >= 5 AND r.mm > 2.5 * greatest(med, 1)", joins="JOIN annuli a USING (cell_row, cell_col) LEFT JOIN meds m ON m.day = r.day AND m.site_idx = a.site_idx AND m.bin = a.bin"))
def azimuthal_filter(t):
    return shown(t, artefacts.above_median(raster(t), annuli(t), ["site_idx", "bin"], 8, 2.5))


@query(OBS, SITE, DAYS, ANNULI, ring_sql("site_idx, bin, sector", 4), sql=ZEROED.format(hit="med IS NOT NULL AND r.mm >= 5 AND r.mm > 1.5 * greatest(med, 1)", joins="JOIN annuli a USING (cell_row, cell_col) LEFT JOIN meds m ON m.day = r.day AND m.site_idx = a.site_idx AND m.bin = a.bin AND m.sector = a.sector"))
def polar_spoke_filter(t):
    return shown(t, artefacts.above_median(raster(t), annuli(t), ["site_idx", "bin", "sector"], 4, 1.5))


RINGS = f"""nbrs AS (SELECT a.day, a.site_idx, a.bin, median(b.med) AS nbr FROM meds a JOIN meds b ON a.day = b.day AND a.site_idx = b.site_idx AND abs(a.bin - b.bin) BETWEEN 1 AND 2 GROUP BY ALL),
  inners AS (SELECT day, site_idx, median(med) AS inner_ref FROM meds WHERE (bin + 0.5) * {KM} <= 75 GROUP BY ALL),
  refs AS (SELECT day, site_idx, bin, med, CASE WHEN (bin + 0.5) * {KM} >= 50 AND inner_ref IS NOT NULL THEN greatest(coalesce(nbr, 0), 1, inner_ref) ELSE greatest(coalesce(nbr, 0), 1) END AS ref FROM meds LEFT JOIN nbrs USING (day, site_idx, bin) LEFT JOIN inners USING (day, site_idx) WHERE nbr IS NOT NULL OR inner_ref IS NOT NULL),
  hits AS (SELECT day, site_idx, bin, ref + greatest(5, 0.5e0 * (med - ref)) AS lim FROM refs WHERE med > ref * CASE WHEN (bin + 0.5) * {KM} > 100 THEN 1.18e0 ELSE 1.12e0 END)"""


@query(OBS, SITE, DAYS, ANNULI, ring_sql("site_idx, bin", 5), RINGS, sql=ZEROED.format(hit="r.mm >= 5 AND r.mm > lim", joins="JOIN annuli a USING (cell_row, cell_col) LEFT JOIN hits h ON h.day = r.day AND h.site_idx = a.site_idx AND h.bin = a.bin"))
def radial_ring_filter(t):
    return shown(t, artefacts.radial_rings(raster(t), annuli(t), width=KM))


PERSIST = """days AS (SELECT day, row_number() OVER (ORDER BY day) AS f FROM (SELECT DISTINCT day FROM raster)),
  steps AS (SELECT d.day, h.day AS hday, count(*) OVER (PARTITION BY d.day) AS nf FROM days d JOIN days h ON h.f BETWEEN d.f - 21 AND d.f - 1),
  dense AS (SELECT d.day, a.*, coalesce(mm, 0) AS v FROM days d CROSS JOIN annuli a LEFT JOIN raster r ON r.day = d.day AND r.cell_row = a.cell_row AND r.cell_col = a.cell_col),
  bycell AS (SELECT s.day, cell_row, cell_col, avg(CAST(v >= 25.4 AS INTEGER)) AS cf, median(v) AS cm FROM steps s JOIN dense x ON x.day = s.hday WHERE nf >= 7 GROUP BY ALL),
  byring AS (SELECT s.day, site_idx, bin, count(DISTINCT CASE WHEN v >= 25.4 THEN hday END) / any_value(nf) AS rf, median(v) AS rm FROM steps s JOIN dense x ON x.day = s.hday WHERE nf >= 7 GROUP BY s.day, site_idx, bin HAVING count(*) / any_value(nf) >= 5),
  today AS (SELECT day, site_idx, bin, median(v) AS tm FROM dense GROUP BY ALL HAVING count(*) >= 5)"""


@query(OBS, SITE, DAYS, ANNULI, PERSIST, sql=ZEROED.format(hit="r.mm >= 25.4 AND rf >= 0.6 AND cf >= 0.35 AND r.mm < 1.75 * greatest(cm, 1) AND NOT coalesce(tm >= 1.5 * greatest(rm, 1) AND tm >= 25.4, false)", joins="JOIN annuli a USING (cell_row, cell_col) LEFT JOIN bycell c ON c.day = r.day AND c.cell_row = r.cell_row AND c.cell_col = r.cell_col LEFT JOIN byring g ON g.day = r.day AND g.site_idx = a.site_idx AND g.bin = a.bin LEFT JOIN today d ON d.day = r.day AND d.site_idx = a.site_idx AND d.bin = a.bin"))
def persistence_filter(t):
    return shown(t, artefacts.persistence(raster(t), annuli(t)))


@query(OBS, DAYS, median_sql(1, ">= 5"), sql="SELECT cell_row, cell_col, round(avg(CAST(mm > 2.5 * greatest(med, 1) AS INTEGER)), 6) AS speckle_fraction, count(*) AS n FROM med GROUP BY ALL")
def speckle_fraction(t):
    cells = raster(t)
    med = spatial.window_median(cells.where("mm >= 5"), cells, 1, ROWS, COLS)
    return med.groupBy(*climate.CELL).agg(F.round(F.avg((F.col("mm") > F.greatest("med", F.lit(1.0)) * 2.5).cast("int")), 6).alias("speckle_fraction"), F.count(F.lit(1)).alias("n"))


@query(OBS, SITE, DAYS, ANNULI, sql="SELECT bin, count(*) AS n, round(avg(mm), 6) AS mean_mm, round(quantile_cont(mm, 0.95), 6) AS p95 FROM raster JOIN annuli USING (cell_row, cell_col) GROUP BY bin HAVING count(*) >= 10")
def range_profile(t):
    rows = raster(t).join(annuli(t), climate.CELL)
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("mm"), 6).alias("mean_mm"), F.round(F.percentile("mm", F.lit(0.95)), 6).alias("p95")).where("n >= 10")
