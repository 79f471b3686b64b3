"""Queries with the production constants, on a patch of the full grid that is dense enough for them.

The SQL of each pass is a function from one relation's name to another's, so that the whole chain has SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions import clock, grid, quality
from cellweave.operators import artefacts, climate, correction, daypasses, events, nearest, spatial
from cellweave.operators.correction import GRIDDED, OTHER
from cellweave.plans.climate import CLEAN, r6
from cellweave.plans.events import LAT_SQL, LON_SQL, center
from cellweave.plans.registry import query
from cellweave.sources.shared import keep
from cellweave.sources.tables import CELL_DAY_FINE, SITE

ROW0, COL0, SIDE = 200, 400, 60
GRID = grid.NROWS, grid.NCOLS
WEST = "site_lat >= 36 AND site_lon <= -100"

PATCH = f"""patch AS MATERIALIZED (SELECT day, cell_row, cell_col, max(mm) AS mm FROM (SELECT day, cell_row, cell_col, {CLEAN} AS mm FROM (
  SELECT CAST(ts - INTERVAL 12 HOUR AS DATE) AS day, CAST({ROW0} + event_id * 7 % {SIDE} AS INTEGER) AS cell_row, CAST({COL0} + user_id * 13 % {SIDE} AS INTEGER) AS cell_col, value AS mm FROM events)) GROUP BY ALL HAVING max(mm) > 0)"""
COARSE = "CASE " + " ".join(f"WHEN km >= {e} THEN {i}" for i, e in reversed(list(enumerate(grid.COARSE_EDGES[:-1])))) + " END"
RINGS = f"""gridp AS (SELECT *, {LAT_SQL} AS lat, {LON_SQL} AS lon FROM (SELECT CAST({ROW0} + range // {SIDE} AS INTEGER) AS cell_row, CAST({COL0} + range % {SIDE} AS INTEGER) AS cell_col FROM range({SIDE * SIDE}))),
  psited AS (SELECT cell_row, cell_col, lat, lon, arg_min((site_idx, site_lat, site_lon), (km, site_idx)) AS s, min(km) AS km FROM (SELECT *, round({grid.haversine_sql('lat', 'lon', 'site_lat', 'site_lon')}, 6) AS km FROM gridp, site) GROUP BY ALL),
  rings AS MATERIALIZED (SELECT *, {COARSE} AS coarse, {WEST} AS flagged FROM (SELECT cell_row, cell_col, lat, lon, km, s[1] AS site_idx, s[2] AS site_lat, s[3] AS site_lon, CAST(least(floor(km / 10), 39) AS INTEGER) AS bin,
    CAST(floor(round((degrees(atan2((lon - s[3]) * cos(radians(s[2])), lat - s[2])) + 360e0) % 360e0, 6) / 15e0) AS INTEGER) % 24 AS sector FROM psited))"""


def patch(t):
    rows = t.read("events").select(clock.convective_day(F.col("ts")).alias("day"), (F.lit(ROW0) + F.col("event_id") * 7 % SIDE).cast("int").alias("cell_row"), (F.lit(COL0) + F.col("user_id") * 13 % SIDE).cast("int").alias("cell_col"), quality.sanitize(F.col("value")).alias("mm"))
    return rows.groupBy("day", *climate.CELL).agg(F.max("mm").alias("mm")).where("mm > 0")


def rings(t):
    """The patch's cells with site, range bins, sector and what the features need."""
    cells = t.spark.range(SIDE * SIDE).select((F.lit(ROW0) + F.floor(F.col("id") / SIDE)).cast("int").alias("cell_row"), (F.lit(COL0) + F.col("id") % SIDE).cast("int").alias("cell_col"))
    lat, lon = center()
    near = nearest.nearest_site(cells, t.site(), lat, lon, keep).join(t.site(), "site_idx").withColumn("lat", lat).withColumn("lon", lon)
    azimuth = F.round(grid.azimuth_deg(F.col("site_lat"), F.col("site_lon"), F.col("lat"), F.col("lon")), 6)
    return near.select(*climate.CELL, "site_idx", "km", "lat", "lon", "site_lat", "site_lon", grid.range_bin(F.col("km")).alias("bin"), grid.edge_bin(F.col("km"), grid.COARSE_EDGES).alias("coarse"), (F.floor(azimuth / 15.0) % 24).cast("int").alias("sector"))


def _window(src: str, name: str, half: int, least: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT t.day, t.cell_row, t.cell_col, any_value(t.mm) AS mm, median(coalesce(v.mm, 0)) AS med FROM {src} t, range(-{half}, {half + 1}) dr(a), range(-{half}, {half + 1}) dc(b)
  LEFT JOIN {src} v ON v.day = t.day AND v.cell_row = least(greatest(t.cell_row + a, 0), {GRID[0] - 1}) AND v.cell_col = least(greatest(t.cell_col + b, 0), {GRID[1] - 1}) WHERE t.mm {least} GROUP BY ALL)"""


def _zero(src: str, dst: str, hit: str, joins: str, only: bool) -> str:
    return f"{dst} AS MATERIALIZED (SELECT r.day, r.cell_row, r.cell_col, CASE WHEN {hit}{' AND a.flagged' if only else ''} THEN 0 ELSE r.mm END AS mm FROM {src} r JOIN rings a USING (cell_row, cell_col) {joins})"


def speckle_sql(src, dst, factor=2.5, only=False):
    return f"{_window(src, dst + '_w', 1, '>= 5')}, " + _zero(src, dst, f"r.mm >= 5 AND r.mm > {factor} * greatest(w.med, 1)", f"LEFT JOIN {dst}_w w ON w.day = r.day AND w.cell_row = r.cell_row AND w.cell_col = r.cell_col", only)


def filament_sql(src, dst, margin=20, only=False):
    return f"{_window(src, dst + '_w', 10, f'> {margin}')}, " + _zero(src, dst, f"w.med < 15 AND r.mm > w.med + {margin}", f"LEFT JOIN {dst}_w w ON w.day = r.day AND w.cell_row = r.cell_row AND w.cell_col = r.cell_col", only)


def annulus_sql(src, dst, by, least, factor, only=False):
    same = " AND ".join(f"m.{c} = a.{c}" for c in by)
    return f"{dst}_m AS (SELECT day, {', '.join(by)}, median(mm) AS med FROM {src} JOIN rings USING (cell_row, cell_col) WHERE mm >= 5 GROUP BY ALL HAVING count(*) >= {least}), " + _zero(src, dst, f"m.med IS NOT NULL AND r.mm >= 5 AND r.mm > {factor} * greatest(m.med, 1)", f"LEFT JOIN {dst}_m m ON m.day = r.day AND {same}", only)


def radial_sql(src, dst, ring=1.12, far=1.18, only=False):
    d = dst
    return f"""{d}_m AS MATERIALIZED (SELECT day, site_idx, bin, median(mm) AS med FROM {src} JOIN rings USING (cell_row, cell_col) WHERE mm >= 5 GROUP BY ALL HAVING count(*) >= 5),
  {d}_n AS (SELECT a.day, a.site_idx, a.bin, median(b.med) AS nbr FROM {d}_m a JOIN {d}_m b ON a.day = b.day AND a.site_idx = b.site_idx AND abs(a.bin - b.bin) BETWEEN 1 AND 2 GROUP BY ALL),
  {d}_i AS (SELECT day, site_idx, median(med) AS inner_ref FROM {d}_m WHERE (bin + 0.5) * 10 <= 75 GROUP BY ALL),
  {d}_r AS (SELECT day, site_idx, bin, med, CASE WHEN (bin + 0.5) * 10 >= 50 AND inner_ref IS NOT NULL THEN greatest(coalesce(nbr, 0), 1, inner_ref) ELSE greatest(coalesce(nbr, 0), 1) END AS ref FROM {d}_m LEFT JOIN {d}_n USING (day, site_idx, bin) LEFT JOIN {d}_i USING (day, site_idx) WHERE nbr IS NOT NULL OR inner_ref IS NOT NULL),
  {d}_h AS (SELECT day, site_idx, bin, ref + greatest(5, 0.5e0 * (med - ref)) AS lim FROM {d}_r WHERE med > ref * CASE WHEN (bin + 0.5) * 10 > 100 THEN {far}e0 ELSE {ring}e0 END), """ + _zero(src, dst, "r.mm >= 5 AND r.mm > h.lim", f"LEFT JOIN {d}_h h ON h.day = r.day AND h.site_idx = a.site_idx AND h.bin = a.bin", only)


def persistence_sql(src, dst, inputs):
    d = dst
    dense = lambda name, rel: f"{name} AS MATERIALIZED (SELECT d.day, a.cell_row, a.cell_col, a.site_idx, a.bin, coalesce(mm, 0) AS v FROM {d}_d d CROSS JOIN rings a LEFT JOIN {rel} r ON r.day = d.day AND r.cell_row = a.cell_row AND r.cell_col = a.cell_col)"
    return f"""{d}_d AS MATERIALIZED (SELECT day, row_number() OVER (ORDER BY day) AS f FROM (SELECT DISTINCT day FROM {inputs})),
  {d}_s AS MATERIALIZED (SELECT d.day, h.day AS hday, count(*) OVER (PARTITION BY d.day) AS nf FROM {d}_d d JOIN {d}_d h ON h.f BETWEEN d.f - 21 AND d.f - 1),
  {dense(d + '_x', inputs)}, {dense(d + '_y', src)},
  {d}_c AS (SELECT s.day, cell_row, cell_col, avg(CAST(v >= 25.4 AS INTEGER)) AS cf, median(v) AS cm FROM {d}_s s JOIN {d}_x x ON x.day = s.hday WHERE nf >= 7 GROUP BY ALL),
  {d}_g AS (SELECT s.day, site_idx, bin, count(DISTINCT CASE WHEN v >= 25.4 THEN hday END) / any_value(nf) AS rf, median(v) AS rm FROM {d}_s s JOIN {d}_x x ON x.day = s.hday WHERE nf >= 7 GROUP BY s.day, site_idx, bin HAVING count(*) / any_value(nf) >= 5),
  {d}_t AS (SELECT day, site_idx, bin, median(v) AS tm FROM {d}_y GROUP BY ALL HAVING count(*) >= 5), """ + _zero(src, dst, "r.mm >= 25.4 AND g.rf >= 0.6 AND c.cf >= 0.35 AND r.mm < 1.75 * greatest(c.cm, 1) AND NOT coalesce(t.tm >= 1.5 * greatest(g.rm, 1) AND t.tm >= 25.4, false)", f"LEFT JOIN {d}_c c ON c.day = r.day AND c.cell_row = r.cell_row AND c.cell_col = r.cell_col LEFT JOIN {d}_g g ON g.day = r.day AND g.site_idx = a.site_idx AND g.bin = a.bin LEFT JOIN {d}_t t ON t.day = r.day AND t.site_idx = a.site_idx AND t.bin = a.bin", False)


def site_passes_sql(src: str, prefix: str) -> tuple[list[str], list[str]]:
    names = [f"{prefix}{i}" for i in range(5)]
    steps = [src, *names]
    return names, [
        speckle_sql(steps[0], steps[1], 2.0, True),
        radial_sql(steps[1], steps[2], 1.05, 1.1, True),
        annulus_sql(steps[2], steps[3], ["site_idx", "coarse"], 8, 1.6, True),
        filament_sql(steps[3], steps[4], 12, True),
        annulus_sql(steps[4], steps[5], ["site_idx", "bin", "sector"], 4, 1.5, True),
    ]


def all_passes_sql(src: str, prefix: str = "f") -> tuple[list[str], list[str]]:
    """Names of the relations after each pass, and their SQL."""
    names = [f"{prefix}{i}" for i in range(5)]
    steps = [src, *names]
    ctes = [speckle_sql(steps[0], steps[1]), radial_sql(steps[1], steps[2]), annulus_sql(steps[2], steps[3], ["site_idx", "bin"], 8, 2.5), filament_sql(steps[3], steps[4]), persistence_sql(steps[4], steps[5], src)]
    more, site = site_passes_sql(steps[5], prefix + "s")
    return names + more, ctes + site


SHOWN = "SELECT day, cell_row, cell_col, round(mm, 6) AS mm FROM out"
BASE = (PATCH, SITE, RINGS)


def shown(cells):
    return cells.select("day", *climate.CELL, *r6("mm"))


def kept_rings(t):
    return keep(rings(t), "rings")


def marked(t):
    """The annuli with the flag of their sites."""
    return keep(rings(t).withColumn("flagged", F.expr(WEST)), "rings")


@query(*BASE, radial_sql("patch", "out"), sql=SHOWN)
def fine_radial_rings(t):
    """Rings of 10 km."""
    return shown(artefacts.radial_rings(patch(t), kept_rings(t)))


@query(*BASE, annulus_sql("patch", "out", ["site_idx", "bin"], 8, 2.5), sql=SHOWN)
def fine_azimuthal(t):
    return shown(artefacts.above_median(patch(t), kept_rings(t), ["site_idx", "bin"], 8, 2.5))


@query(*BASE, filament_sql("patch", "out"), sql=SHOWN)
def fine_filament(t):
    """Windows of 21 x 21 cells."""
    return shown(artefacts.filament(patch(t), *GRID))


@query(*BASE, persistence_sql("patch", "out", "patch"), sql=SHOWN)
def fine_persistence(t):
    return shown(artefacts.persistence(patch(t), kept_rings(t)))


_SITE_NAMES, _SITE_SQL = site_passes_sql("patch", "s")


@query(*BASE, *_SITE_SQL, sql=SHOWN.replace("out", _SITE_NAMES[-1]))
def fine_site_remediation(t):
    """The five stricter passes over flagged sites, each on the last one's output."""
    return shown(daypasses.by_day(daypasses.placed(patch(t), marked(t)), daypasses.SITE, *GRID, True))


_NAMES, _SQL = all_passes_sql("patch")


@query(*BASE, *_SQL, sql=" UNION ALL ".join(f"SELECT {i} AS step, '{n}' AS pass, (SELECT count(*) FROM {a} x JOIN {b} y USING (day, cell_row, cell_col) WHERE x.mm > 0 AND y.mm = 0) AS n_removed" for i, (n, a, b) in enumerate(zip(daypasses.NAMES, ["patch", *_NAMES], _NAMES))))
def artefact_chain(t):
    """All passes in order, each on the last one's output, with the cells each removed."""
    out = daypasses.all_passes(keep(patch(t), "patch"), marked(t), *GRID)
    counts = out.where("step is not null").groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    names = F.posexplode(F.array(*map(F.lit, daypasses.NAMES))).alias("step", "pass")
    return t.spark.range(1).select(names).join(counts, "step", "left").select("step", "pass", F.coalesce("n", F.lit(0)).alias("n_removed"))


LABELS = f"marked AS MATERIALIZED (SELECT *, CASE WHEN day IN (SELECT day FROM labelled) THEN '{GRIDDED}' ELSE '{OTHER}' END AS source FROM patch)"
LABELLED = "labelled AS (SELECT DISTINCT day FROM patch WHERE day(day) <= 20)"


def label_days(t):
    """The days of the label set: those up to the 20th of a month."""
    return patch(t).where(F.dayofmonth("day") <= 20).select("day").distinct()


@query(PATCH, LABELLED, LABELS, sql="SELECT source, count(DISTINCT day) AS days, count(*) AS cells FROM marked GROUP BY source")
def label_source(t):
    return correction.with_source(patch(t), label_days(t)).groupBy("source").agg(F.count_distinct("day").alias("days"), F.count(F.lit(1)).alias("cells"))


CALIBRATED = f"""kn AS MATERIALIZED (SELECT source, unnest(range(201)) AS k, unnest(quantile_cont(mm, [{', '.join(str(k / 200) for k in range(201))}])) AS q FROM marked GROUP BY source),
  seg AS MATERIALIZED (SELECT a.k, a.q AS x0, b.q AS x1, c.q AS y0, d.q AS y1 FROM kn a JOIN kn b ON b.source = a.source AND b.k = a.k + 1 JOIN kn c ON c.source = '{OTHER}' AND c.k = a.k JOIN kn d ON d.source = '{OTHER}' AND d.k = a.k + 1 WHERE a.source = '{GRIDDED}'),
  frames AS MATERIALIZED (SELECT m.day, m.cell_row, m.cell_col, least(CASE WHEN any_value(m.mm) >= (SELECT max(x1) FROM seg) THEN (SELECT arg_max(y1, k) FROM seg) ELSE coalesce(arg_max(y0 + (y1 - y0) * (m.mm - x0) / (x1 - x0), k), (SELECT arg_min(y0, k) FROM seg)) END, 300) AS mm
    FROM marked m LEFT JOIN seg ON m.mm >= x0 AND m.mm < x1 WHERE source = '{GRIDDED}' GROUP BY m.day, m.cell_row, m.cell_col),
  others AS (SELECT day, cell_row, cell_col, 15.096e0 * pow(mm / 2.54e0, 0.412e0) AS mm FROM marked WHERE source = '{OTHER}')"""
_DONE, _STEPS = all_passes_sql("frames")
ENV = f"""done AS MATERIALIZED (SELECT day, cell_row, cell_col, CASE WHEN mm > 300 THEN 0 ELSE mm END AS mm FROM (SELECT day, cell_row, cell_col, CASE WHEN mm < 5 OR ((dayofyear(day) >= 305 OR dayofyear(day) <= 59) AND {LAT_SQL} < 30 AND mm < 29) THEN 0 ELSE mm END AS mm FROM (FROM others UNION ALL SELECT day, cell_row, cell_col, mm FROM {_DONE[-1]})))"""


@query(*BASE, LABELLED, LABELS, CALIBRATED, *_STEPS, ENV, sql=f"""SELECT m.day, source, count(*) AS in_pixels, count(*) FILTER (WHERE d.mm > 0) AS out_pixels, round(max(m.mm), 1) AS peak_in_mm, round(max(d.mm), 1) AS peak_out_mm,
  round(100 * (1 - count(*) FILTER (WHERE d.mm > 0) / count(*)), 1) AS filtered_pct, count(*) FILTER (WHERE f.mm > 0 AND p.mm = 0) AS artefacts_removed
  FROM marked m JOIN done d USING (day, cell_row, cell_col) LEFT JOIN frames f USING (day, cell_row, cell_col) LEFT JOIN {_DONE[-1]} p USING (day, cell_row, cell_col) GROUP BY m.day, source""")
def correction_chain(t):
    """The daily correction from raw cells to filtered ones, as a row of counts and peaks a day."""
    return correction.corrected(keep(patch(t), "patch"), label_days(t), marked(t), *GRID, center()[0], keep)[1]


VOXELS = "vox AS (SELECT vol, k, j, i, max(dbz) AS dbz, max(nobs) AS nobs, max(necho) AS necho, max(weight) AS weight FROM (SELECT l_suppkey % 3 AS vol, l_linenumber - 1 AS k, l_partkey % 40 AS j, l_orderkey % 40 AS i, l_quantity - 25e0 AS dbz, l_suppkey % 7 AS nobs, l_partkey % 5 AS necho, l_quantity / 5e0 AS weight FROM lineitem) GROUP BY vol, k, j, i)"
LEVELS = 7


def clutter_sql(src: str) -> str:
    near = lambda rel: f"(SELECT count(*) FROM {rel} e WHERE e.vol = v.vol AND abs(e.k - v.k) <= 1 AND abs(e.j - v.j) <= 1 AND abs(e.i - v.i) <= 1)"
    counted = lambda rel, name: f"{name}e AS MATERIALIZED (SELECT vol, k, j, i FROM {rel} WHERE dbz >= 5), {name}d AS (SELECT e.vol, e.k + a.range AS k, e.j + b.range AS j, e.i + c.range AS i, count(*) AS n FROM {name}e e, range(-1, 2) a, range(-1, 2) b, range(-1, 2) c GROUP BY ALL), {name}l AS MATERIALIZED (SELECT e.* FROM {name}e e JOIN {name}d USING (vol, k, j, i) WHERE n / 27e0 < 0.32)"
    return f"""{counted(src, 'one')}, cols AS (SELECT vol, j, i, bool_or(dbz >= 5 AND k >= 1) AS above, bool_or(dbz >= 5 AND k >= 4) AS aloft, bool_or(dbz >= 5 AND k >= 2 AND k < 4) AS middle, bool_or(dbz >= 5 AND k < 2) AS low FROM {src} GROUP BY ALL),
  left_over AS MATERIALIZED (SELECT v.* FROM {src} v JOIN cols USING (vol, j, i) WHERE NOT EXISTS (FROM onel x WHERE x.vol = v.vol AND x.k = v.k AND x.j = v.j AND x.i = v.i) AND NOT (k = 0 AND dbz >= 5 AND dbz < 20 AND NOT above) AND NOT (k < 2 AND aloft AND NOT middle AND low)),
  {counted('left_over', 'two')}, clean AS (SELECT v.* FROM left_over v WHERE NOT EXISTS (FROM twol x WHERE x.vol = v.vol AND x.k = v.k AND x.j = v.j AND x.i = v.i))"""


def voxels(t):
    c = F.col
    rows = t.read("lineitem").select((c("l_suppkey") % 3).alias("vol"), (c("l_linenumber") - 1).alias("k"), (c("l_partkey") % 40).alias("j"), (c("l_orderkey") % 40).alias("i"), (c("l_quantity") - 25.0).alias("dbz"), (c("l_suppkey") % 7).alias("nobs"), (c("l_partkey") % 5).alias("necho"), (c("l_quantity") / 5.0).alias("weight"))
    return rows.groupBy("vol", "k", "j", "i").agg(*(F.max(x).alias(x) for x in ("dbz", "nobs", "necho", "weight")))


@query(VOXELS, clutter_sql("vox"), sql="SELECT vol, k, j, i, dbz FROM clean")
def clutter_removal(t):
    """Volumes without echoes of low coverage, weak shallow echoes and echoes below an anvil."""
    return artefacts.remove_clutter(voxels(t).select("vol", "k", "j", "i", "dbz"), LEVELS)


@query(VOXELS, "sure AS MATERIALIZED (SELECT vol, k, j, i, dbz FROM vox WHERE NOT ((nobs >= 3 AND necho / greatest(nobs, 1) < 0.6) OR weight < 1.5))", clutter_sql("sure"), sql="SELECT vol, k, j, i, dbz FROM clean")
def native_qc(t):
    """The confidence filter, then the clutter passes."""
    return artefacts.native_qc(voxels(t), LEVELS)


FINE_ACTIVE = "act AS (SELECT * FROM cell_day_fine WHERE mm >= 29)"


@query(CELL_DAY_FINE, FINE_ACTIVE, "steps AS (SELECT day, lag(day) OVER (ORDER BY day) AS prev_day FROM (SELECT DISTINCT day FROM act))", sql="SELECT DISTINCT a.day FROM steps s JOIN act a ON a.day = s.day JOIN act b ON b.day = s.prev_day WHERE s.day - s.prev_day <= 2 AND abs(a.cell_row - b.cell_row) <= 15 AND abs(a.cell_col - b.cell_col) <= 15")
def fine_footprint_overlap(t):
    """Days of which a cell lies within 15 rows and columns of one of the day before, on the full grid."""
    cells = t.cell_day_fine().where(F.col("mm") >= grid.EVENT_MM)
    steps = events.day_steps(events.daily_footprints(cells, *center())).where("gap <= 2").select("day", "prev_day")
    return spatial.overlapping_days(cells, steps, 15)
