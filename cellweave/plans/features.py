"""Queries over the artefact model's features, the volume's sizes and the remaining column rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions import clock, grid, quality
from cellweave.operators import climate, correction, ingest, models
from cellweave.operators import verification as V
from cellweave.operators.correction import FEATURES
from cellweave.plans.artefacts import annuli as coarse_annuli
from cellweave.plans.climate import r6
from cellweave.plans.fine import GRID, LABELLED, LABELS, PATCH, RINGS, _window, kept_rings, label_days, patch
from cellweave.plans.registry import query
from cellweave.plans.verification import MOST_NEGATIVES, pairs
from cellweave.sources.shared import keep
from cellweave.sources.tables import CELL_DAY, COLS, ROWS, SITE

AZIMUTH = "radians((degrees(atan2(sin(radians(lon - site_lon)) * cos(radians(site_lat)), cos(radians(lat)) * sin(radians(site_lat)) - sin(radians(lat)) * cos(radians(site_lat)) * cos(radians(lon - site_lon)))) + 360e0) % 360e0)"
ANGLE = "(2 * pi() * (dayofyear(day) - 1) / 366)"
FEATURE_SQL = f"""feats AS (SELECT m.day, m.cell_row, m.cell_col, m.mm AS v, ln(1 + m.mm) AS log_v, CASE WHEN med > 0 THEN m.mm / med ELSE 1 END AS ratio, km AS range_km, sin({AZIMUTH}) AS sin_az, cos({AZIMUTH}) AS cos_az,
  sin({ANGLE}) AS sin_day, cos({ANGLE}) AS cos_day, CAST(source = 'GridRad' AS INTEGER) * 1e0 AS is_gridded, CAST(source <> 'GridRad' AND day >= DATE '2020-10-14' AS INTEGER) * 1e0 AS is_latest FROM marked m JOIN w USING (day, cell_row, cell_col) JOIN rings USING (cell_row, cell_col))"""


def latest():
    """Not of the gridded source and in the latest era."""
    return (F.col("source") != correction.GRIDDED) & (clock.era(F.col("day")) == "MRMS")


def features(t):
    cells = correction.with_source(patch(t), label_days(t))
    return correction.artefact_features(cells, kept_rings(t), *GRID, latest())


@query(PATCH, SITE, RINGS, LABELLED, LABELS, _window("patch", "w", 1, ">= 5"), FEATURE_SQL, sql="SELECT day, cell_row, cell_col, " + ", ".join(f"round({f}, 6) AS {f}" for f in FEATURES) + " FROM feats")
def artefact_features(t):
    """The ten features of every active cell."""
    return features(t).select("day", *climate.CELL, *r6(*FEATURES))


@query(PATCH, SITE, RINGS, LABELLED, LABELS, _window("patch", "w", 1, ">= 5"), FEATURE_SQL, sql="SELECT p.day, p.cell_row, p.cell_col, round(CASE WHEN v IS NULL THEN p.mm ELSE p.mm / (1 + exp(-(log_v - ratio / 2 + cos_day))) END, 6) AS mm FROM patch p LEFT JOIN feats USING (day, cell_row, cell_col)")
def likelihood_weights(t):
    """Active cells weighted by a logistic score of their features."""
    score = F.lit(1.0) / (F.exp(-(F.col("log_v") - F.col("ratio") / 2 + F.col("cos_day"))) + 1)
    rows = features(t).select("day", *climate.CELL, score.alias("p"))
    return correction.weighted(patch(t), rows).select("day", *climate.CELL, *r6("mm"))


def labelled_features(t):
    """(label, day, cell, features) of the training set on the coarse grid."""
    source = F.when(F.year("day") % 3 == 2, correction.GRIDDED).otherwise(correction.OTHER)
    cells = t.cell_day().withColumn("source", source)
    rows = correction.artefact_features(cells, coarse_annuli(t), ROWS, COLS, F.year("day") % 3 == 0)
    pos = pairs(t).where("size_in >= 1 and mm >= 25.4").select(*V.KEY, F.lit(1.0).alias("label"))
    order = ((F.col("cell_row") * 7919 + F.col("cell_col") * 104729) % 10007, *climate.CELL)
    neg = V.capped_sample(V.without_report(t.cell_day(), t.report()), "day", MOST_NEGATIVES, order).select(*V.KEY, F.lit(0.0).alias("label"))
    return rows.join(pos.unionByName(neg), V.KEY)


@query()
def hail_classifier(t):
    """200 boosted trees of depth 4 on the ten features; years, not rows, are split into training and test."""
    return models.classifier_report(keep(labelled_features(t), "training"), list(FEATURES))


@query("lev AS (SELECT l_orderkey AS id, l_linenumber * 1e0 + (l_partkey % 10) / 20e0 AS alt, 30 + l_quantity / 1.5e0 AS dbz, 5 - l_orderkey % 3 AS hz, 7 + l_orderkey % 2 AS h20 FROM lineitem)", "ord AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY alt, dbz) AS i, count(*) OVER (PARTITION BY id) AS n, lag(alt) OVER w AS a0, lead(alt) OVER w AS a1 FROM lev WINDOW w AS (PARTITION BY id ORDER BY alt, dbz))", "dep AS (SELECT *, CASE WHEN n = 1 THEN 1000 WHEN i = 1 THEN abs(a1 - alt) * 1000 WHEN i = n THEN abs(alt - a0) * 1000 ELSE abs(a1 - a0) / 2 * 1000 END AS d FROM ord)", "shis AS (SELECT id, 0.1e0 * sum(CASE WHEN dbz >= 40 AND alt >= hz - 1 THEN CASE WHEN alt >= h20 - 2 THEN 1 ELSE (alt - (hz - 1)) / (h20 - 2 - (hz - 1)) END * 5e-6 * pow(10, 0.084e0 * dbz) * d ELSE 0 END) AS shi FROM dep GROUP BY id)", sql="SELECT id, round(15.096e0 * pow(shi, 0.206e0), 6) AS mm FROM shis WHERE shi > 0 AND 15.096e0 * pow(shi, 0.206e0) BETWEEN 5 AND 300")
def size_from_index(t):
    """Sizes from column indices, 5 to 300 mm kept."""
    rows = t.read("lineitem").select(F.col("l_orderkey").alias("id"), F.struct((F.col("l_linenumber") * 1.0 + (F.col("l_partkey") % 10) / 20.0).alias("alt_km"), (F.col("l_quantity") / 1.5 + 30).alias("dbz")).alias("x"))
    columns = rows.groupBy("id").agg(F.collect_list("x").alias("profile"))
    shi = ingest.severe_hail_index(F.col("profile"), (F.lit(4) - F.col("id") % 3).cast("double"), (F.lit(5) + F.col("id") % 2).cast("double"))
    return columns.select("id", quality.size_from_index(shi).alias("mm")).where("mm is not null").select("id", *r6("mm"))


@query("vals AS (SELECT l_suppkey % 3 AS vol, (l_partkey * 1009 + l_suppkey) % 60000 AS flat, CASE WHEN l_quantity = 50 THEN CAST('nan' AS DOUBLE) ELSE l_quantity * 1e0 END AS v FROM lineitem)", sql="SELECT vol, flat // (48 * 40) AS k, (flat // 48) % 40 AS j, flat % 48 AS i, max(v) AS dbz FROM vals WHERE NOT isnan(v) AND flat // (48 * 40) < 30 GROUP BY ALL")
def indexed_volume(t):
    """Volumes from index-sparse values: flat indices decoded, duplicates keep the largest, others than finite left out."""
    rows = t.read("lineitem").select((F.col("l_suppkey") % 3).alias("vol"), ((F.col("l_partkey") * 1009 + F.col("l_suppkey")) % 60000).alias("flat"), F.when(F.col("l_quantity") == 50, F.lit(float("nan"))).otherwise(F.col("l_quantity").cast("double")).alias("v"))
    return ingest.indexed_volume(rows, 48, 40, 30)


@query(SITE, "ask AS (SELECT site_idx, site_lat, site_lon, m.range AS month FROM site, range(1, 13) m)", "cell AS (SELECT range % 12 + 1 AS month, range // 12 // 20 AS j, range // 12 % 20 AS k, 0.1e0 * (range % 83) AS h0, 0.2e0 * (range % 71) AS h20 FROM range(12 * 40 * 20))", sql="""SELECT site_idx, ask.month, round(CASE WHEN h0 IS NULL THEN {h0} ELSE least(greatest(h0, 0.5), 7) END, 6) AS h0, round(CASE WHEN h0 IS NULL THEN {h20} ELSE least(greatest(h20, least(greatest(h0, 0.5), 7) + 1), 12) END, 6) AS h20
  FROM ask LEFT JOIN cell ON cell.month = ask.month AND j = CAST(ceil((site_lat - 25) / 0.25e0 - 0.5e0) AS INTEGER) AND k = CAST(ceil((site_lon + 110) / 0.25e0 - 0.5e0) AS INTEGER)""".format(**{n: "CASE " + " ".join(f"WHEN ask.month = {m} AND site_lat >= {a} AND site_lat < {b} THEN {v[i]}e0" for m, row in quality.ISOTHERMS.items() for (a, b), v in zip(quality.BANDS, row)) + f" ELSE {d}e0 END" for i, (n, d) in enumerate((("h0", 3.5), ("h20", 6.0)))}))
def reanalysis_isotherms(t):
    """Freezing levels of the nearest reanalysis cell, clamped; by month and latitude band where there is no cell."""
    month = F.explode(F.sequence(F.lit(1), F.lit(12)))
    ask = t.site().select("site_idx", F.col("site_lat").alias("lat"), F.col("site_lon").alias("lon"), month.alias("month"))
    i = F.col("id")
    cells = t.spark.range(12 * 40 * 20).select((i % 12 + 1).cast("int").alias("month"), F.floor(F.floor(i / 12) / 20).cast("int").alias("j"), (F.floor(i / 12) % 20).cast("int").alias("k"), (i % 83 * F.lit(0.1)).alias("h0"), (i % 71 * F.lit(0.2)).alias("h20"))
    return ingest.isotherms(ask, cells, 25.0, -110.0, 0.25).select("site_idx", "month", *r6("h0", "h20"))


@query("lev AS (SELECT l_orderkey AS id, l_linenumber * 1.5e0 AS h, 290 - l_linenumber * 6e0 + (l_partkey % 7) AS t, l_linenumber AS i FROM lineitem)", "pr AS (SELECT id, row_number() OVER w AS i, h AS h0, t AS t0, lead(h) OVER w AS h1, lead(t) OVER w AS t1 FROM lev WINDOW w AS (PARTITION BY id ORDER BY i, t))", sql="SELECT id, " + ", ".join(f"round(coalesce(arg_max(CASE WHEN (t0 - {k}) * (t1 - {k}) <= 0 AND t0 <> t1 THEN h0 + (h1 - h0) * ({k}e0 - t0) / (t1 - t0) END, CASE WHEN (t0 - {k}) * (t1 - {k}) <= 0 AND t0 <> t1 THEN i END), {d}), 6) AS {n}" for k, d, n in ((273.15, 3.5, "h0c"), (253.15, 6.0, "hm20"))) + " FROM pr GROUP BY id")
def isotherm_heights(t):
    """Heights of 273.15 and 253.15 K; the last crossing in level order, 3.5 and 6 km without one."""
    rows = t.read("lineitem").select(F.col("l_orderkey").alias("id"), F.struct(F.col("l_linenumber").alias("i"), (F.col("l_linenumber") * 1.5).alias("h"), (F.lit(290.0) - F.col("l_linenumber") * 6.0 + F.col("l_partkey") % 7).alias("t")).alias("x"))
    levels = rows.groupBy("id").agg(F.sort_array(F.collect_list("x")).alias("levels"))
    return levels.select("id", F.round(ingest.isotherm_height(F.col("levels"), 273.15, 3.5), 6).alias("h0c"), F.round(ingest.isotherm_height(F.col("levels"), 253.15, 6.0), 6).alias("hm20"))


@query(CELL_DAY, sql="SELECT day, cell_row, cell_col, round(mm, 6) AS v, round(49 - cell_row * 1.25e0, 6) AS lat, dayofyear(day) AS doy, round(sin(2 * pi() * (dayofyear(day) - 1) / 366), 6) AS s, round(cos(2 * pi() * (dayofyear(day) - 1) / 366), 6) AS c FROM cell_day")
def filter_features(t):
    """The five features of the probability filter."""
    return ingest.filter_features(t.cell_day(), F.lit(49.0) - F.col("cell_row") * 1.25).select("day", *climate.CELL, *r6("v", "lat"), "doy", *r6("s", "c"))


@query("names AS (SELECT 'f' || o_orderkey || CASE o_orderkey % 4 WHEN 0 THEN '.netcdf' WHEN 1 THEN '.NETCDF.GZ' WHEN 2 THEN '.netcdf.gz' ELSE '.txt' END AS name, o_custkey % 5 AS grp FROM orders)", sql="SELECT grp, count(*) FILTER (WHERE lower(name) LIKE '%.netcdf.gz') AS compressed, count(*) FILTER (WHERE lower(name) LIKE '%.netcdf') AS plain FROM names GROUP BY grp")
def source_formats(t):
    """Plain and compressed files by suffix."""
    k = F.col("o_orderkey")
    suffix = F.when(k % 4 == 0, ".netcdf").when(k % 4 == 1, ".NETCDF.GZ").when(k % 4 == 2, ".netcdf.gz").otherwise(".txt")
    rows = t.read("orders").select(F.concat(F.lit("f"), k, suffix).alias("name"), (F.col("o_custkey") % 5).alias("grp"))
    return ingest.format_counts(rows, "grp", "name", ".netcdf")


@query("pts AS (SELECT o_orderkey AS id, 24 + o_custkey % 53 / 2e0 AS lat, -125 + o_orderkey % 119 / 2e0 AS lon FROM orders)", sql="SELECT id, least(CAST(floor((50 - lat) / 0.25e0) AS INTEGER), 103) AS cell_row, least(CAST(floor((lon + 125) / 0.25e0) AS INTEGER), 235) AS cell_col FROM pts")
def clamped_cells(t):
    """Cells of a coarser grid whose last edge belongs to the last cell."""
    pts = t.read("orders").select(F.col("o_orderkey").alias("id"), (F.lit(24.0) + F.col("o_custkey") % 53 / 2.0).alias("lat"), (F.lit(-125.0) + F.col("o_orderkey") % 119 / 2.0).alias("lon"))
    return pts.select("id", grid.clamped_cell(F.col("lat"), F.col("lon"), 104, 236, 0.25, 50.0, -125.0).alias("x")).select("id", "x.*")
