"""Queries that hold grid values against reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions import grid
from cellweave.operators import verification as V
from cellweave.operators.climate import CELL
from cellweave.plans.climate import r6
from cellweave.plans.registry import query
from cellweave.sources.tables import CELL_DAY, REPORT

PAIRS = """best AS (SELECT day, cell_row, cell_col, arg_max(size_in, (size_in, -report_id)) AS size_in, arg_max(hour, (size_in, -report_id)) AS hour, arg_max(report_id, (size_in, -report_id)) AS report_id FROM report GROUP BY ALL),
  pairs AS (SELECT b.day, b.cell_row, b.cell_col, size_in, hour, report_id, coalesce(mm, 0) AS mm FROM best b LEFT JOIN cell_day c USING (day, cell_row, cell_col) WHERE b.day IN (SELECT day FROM cell_day))"""
BINS = "bins AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {a}e0, {b}e0)" for i, (a, b) in enumerate(V.SIZE_BINS)) + ") AS x(bin, lo, hi))"


def pairs(t):
    return V.report_pairs(t.report(), t.cell_day())


@query(CELL_DAY, REPORT, PAIRS, sql="SELECT day, cell_row, cell_col, round(size_in, 6) AS size_in, hour, report_id, round(mm, 6) AS mm FROM pairs")
def report_pairs(t):
    return pairs(t).select(*V.KEY, *r6("size_in"), "hour", "report_id", *r6("mm"))


@query(CELL_DAY, REPORT, PAIRS, BINS, "hits AS (SELECT *, mm / 25.4e0 - size_in AS d FROM pairs)", sql="SELECT bin, count(size_in) AS n, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in (("mean_report", "avg(size_in)"), ("mean_grid", "avg(mm / 25.4e0)"), ("bias", "avg(d)"), ("rmse", "sqrt(avg(d * d))"), ("mae", "avg(abs(d))"), ("pod", "avg(CASE WHEN size_in IS NOT NULL THEN CAST(mm >= 25.4 AS INTEGER) END)"))) + " FROM bins LEFT JOIN hits ON size_in >= lo AND size_in < hi GROUP BY bin")
def size_bin_calibration(t):
    return V.calibration(pairs(t), V.size_bins(t.spark)).select("bin", "n", *r6("mean_report", "mean_grid", "bias", "rmse", "mae", "pod"))


@query(CELL_DAY, REPORT, PAIRS, sql="SELECT cell_row // 5 AS lat_key, cell_col // 5 AS lon_key, count(*) AS n, round(avg(mm / 25.4e0 / size_in), 6) AS mean_ratio, round(median(mm / 25.4e0 / size_in), 6) AS median_ratio FROM pairs WHERE mm > 0 AND size_in > 0 GROUP BY ALL")
def spatial_bias(t):
    ratio = F.col("mm") / 25.4 / F.col("size_in")
    return pairs(t).where("mm > 0 and size_in > 0").groupBy(F.floor(F.col("cell_row") / 5).cast("int").alias("lat_key"), F.floor(F.col("cell_col") / 5).cast("int").alias("lon_key")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(ratio), 6).alias("mean_ratio"), F.round(F.median(ratio), 6).alias("median_ratio"))


@query(CELL_DAY, REPORT, PAIRS, "k AS (SELECT count(*) FILTER (WHERE size_in >= 1 AND mm >= 25.4) AS hits, count(*) FILTER (WHERE size_in >= 1 AND mm < 25.4) AS misses, count(*) FILTER (WHERE size_in < 1 AND mm >= 25.4) AS false_alarms FROM pairs)", sql="SELECT *, round(hits / greatest(hits + misses, 1), 6) AS pod, round(false_alarms / greatest(hits + false_alarms, 1), 6) AS far, round(hits / greatest(hits + misses + false_alarms, 1), 6) AS csi FROM k")
def contingency(t):
    return V.contingency(pairs(t), t.cell_day()).select("hits", "misses", "false_alarms", *r6("pod", "far", "csi"))


@query(CELL_DAY, REPORT, PAIRS, sql="SELECT count(*) AS n, round(corr(mm, size_in), 6) AS r, round(avg(mm / 25.4e0 - size_in), 6) AS bias, round(sqrt(avg(pow(mm / 25.4e0 - size_in, 2))), 6) AS rmse FROM pairs")
def pair_correlation(t):
    d = F.col("mm") / 25.4 - F.col("size_in")
    return pairs(t).agg(F.count(F.lit(1)).alias("n"), F.round(V.correlation("mm", "size_in"), 6).alias("r"), F.round(F.avg(d), 6).alias("bias"), F.round(F.sqrt(F.avg(d * d)), 6).alias("rmse"))


@query(CELL_DAY, REPORT, PAIRS, sql="SELECT CASE WHEN hour >= 6 AND hour < 22 THEN 'day' ELSE 'night' END AS part, count(*) AS n, round(avg(CAST(mm > 0 AS INTEGER)), 6) AS detected FROM pairs GROUP BY 1")
def diurnal_detection(t):
    part = F.when((F.col("hour") >= 6) & (F.col("hour") < 22), "day").otherwise("night")
    return pairs(t).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("mm") > 0).cast("int")), 6).alias("detected"))


@query(CELL_DAY, REPORT, sql="SELECT day, cell_row, cell_col, round(mm, 6) AS mm FROM cell_day c WHERE mm >= 29 AND NOT EXISTS (FROM report r WHERE r.day = c.day AND r.cell_row = c.cell_row AND r.cell_col = c.cell_col)")
def no_report_cells(t):
    return V.without_report(t.cell_day(), t.report()).select(*V.KEY, *r6("mm"))


@query(CELL_DAY, "raw AS (SELECT day, max(mm) AS raw_mm FROM cell_day GROUP BY day)", sql="SELECT day, round(raw_mm, 6) AS raw_mm, round(15.096e0 * pow(raw_mm / 2.54e0, 0.412e0), 6) AS corrected_mm, round(15.096e0 * pow(raw_mm / 2.54e0, 0.412e0) / raw_mm, 6) AS ratio FROM raw")
def raw_vs_corrected(t):
    from cellweave.functions.quality import recalibrate

    raw = t.cell_day().groupBy("day").agg(F.max("mm").alias("raw_mm"))
    fixed = t.cell_day().withColumn("mm", recalibrate(F.col("mm"))).groupBy("day").agg(F.max("mm").alias("corrected_mm"))
    return raw.join(fixed, "day").withColumn("ratio", F.col("corrected_mm") / F.col("raw_mm")).select("day", *r6("raw_mm", "corrected_mm", "ratio"))


@query(CELL_DAY, REPORT, PAIRS, BINS, sql="SELECT bin, count(*) AS n, round(avg(CAST(mm >= 25.4 AS INTEGER)), 6) AS pod, round(avg(CAST(abs(size_in - round_even(size_in * 4, 0) / 4) < 0.02 AS INTEGER)), 6) AS quarter_share FROM bins JOIN pairs ON size_in >= lo AND size_in < hi GROUP BY bin HAVING count(*) >= 20")
def detection_and_rounding(t):
    rows = pairs(t).join(F.broadcast(V.size_bins(t.spark)), (F.col("size_in") >= F.col("lo")) & (F.col("size_in") < F.col("hi")))
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("mm") >= 25.4).cast("int")), 6).alias("pod"), F.round(F.avg(grid.quarter_inch(F.col("size_in")).cast("int")), 6).alias("quarter_share")).where("n >= 20")


#: Negatives of a day that the reference's training set keeps.
MOST_NEGATIVES = 150
# Metropolitan centres.
METROS = (
    (40.71, -74.01), (34.05, -118.24), (41.88, -87.63), (29.76, -95.37), (33.45, -112.07), (39.95, -75.17), (29.42, -98.49), (32.78, -96.80), (30.27, -97.74),
    (30.33, -81.66), (39.74, -104.99), (39.96, -82.99), (39.77, -86.16), (35.23, -80.84), (47.61, -122.33), (36.16, -86.78), (35.47, -97.52), (39.10, -94.58),
    (33.75, -84.39), (25.76, -80.19), (44.98, -93.27), (42.33, -83.05), (38.63, -90.20), (39.10, -84.51), (35.08, -106.65),
)


@query(CELL_DAY, REPORT, PAIRS, "metro AS (SELECT * FROM (VALUES " + ", ".join(f"({a}e0, {b}e0)" for a, b in METROS) + ") AS x(mlat, mlon))", f"zoned AS (SELECT report_id, mm, min({grid.haversine_sql('lat', 'lon', 'mlat', 'mlon')}) AS km FROM (SELECT *, 49e0 - cell_row * 1.25e0 AS lat, -120e0 + cell_col * 2e0 AS lon FROM pairs WHERE size_in >= 1), metro GROUP BY report_id, mm)", "zones AS (SELECT CASE WHEN km <= 75 THEN 'urban' ELSE 'rural' END AS zone, count(*) AS n, avg(CAST(mm >= 25.4 AS INTEGER)) AS pod FROM zoned GROUP BY 1 HAVING count(*) >= 30)", sql="SELECT count(*) AS zones, round(any_value(CASE WHEN zone = 'urban' THEN pod END), 6) AS urban, round(any_value(CASE WHEN zone = 'rural' THEN pod END), 6) AS rural, round(CASE WHEN count(*) = 2 THEN max(CASE WHEN zone = 'urban' THEN pod END) / greatest(max(CASE WHEN zone = 'rural' THEN pod END), 1e-6) END, 6) AS ratio, CASE WHEN count(*) < 2 THEN 'skip' WHEN max(CASE WHEN zone = 'urban' THEN pod END) / greatest(max(CASE WHEN zone = 'rural' THEN pod END), 1e-6) < 0.9 THEN 'warn' ELSE 'pass' END AS status FROM zones")
def rural_urban_bias(t):
    """Detection of severe reports within 75 km of a metropolitan centre and elsewhere, zones of 30 pairs or more; warn
    where the urban share is under 0.9 of the rural one. The nearest of a fixed list, in one expression."""
    lat, lon = F.lit(49.0) - F.col("cell_row") * 1.25, F.lit(-120.0) + F.col("cell_col") * 2.0
    km = F.least(*(grid.haversine_km(lat, lon, F.lit(a), F.lit(b)) for a, b in METROS))
    zones = pairs(t).where("size_in >= 1").groupBy(F.when(km <= 75, "urban").otherwise("rural").alias("zone")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("mm") >= 25.4).cast("int")).alias("pod")).where("n >= 30")
    of = lambda z: F.max(F.when(F.col("zone") == z, F.col("pod")))
    rows = zones.agg(F.count(F.lit(1)).alias("zones"), of("urban").alias("urban"), of("rural").alias("rural"))
    ratio = F.when(F.col("zones") == 2, F.col("urban") / F.greatest("rural", F.lit(1e-6)))
    return rows.select("zones", *r6("urban", "rural"), F.round(ratio, 6).alias("ratio"), F.when(F.col("zones") < 2, "skip").when(ratio < 0.9, "warn").otherwise("pass").alias("status"))


@query(CELL_DAY, REPORT, "g AS (SELECT dayofyear(day) AS doy, count(DISTINCT day) AS n FROM cell_day WHERE mm >= 29 GROUP BY 1)", "h AS (SELECT dayofyear(day) AS doy, count(*) AS n FROM report WHERE size_in >= 1 GROUP BY 1)", "d AS (SELECT range AS doy FROM range(1, 367))", sql="SELECT round(corr(a, b), 6) AS r, CASE WHEN corr(a, b) < 0.5 THEN 'warn' ELSE 'pass' END AS status FROM (SELECT coalesce(g.n, 0) / (SELECT sum(n) FROM g) AS a, coalesce(h.n, 0) / (SELECT sum(n) FROM h) AS b FROM d LEFT JOIN g USING (doy) LEFT JOIN h USING (doy) WHERE doy BETWEEN 90 AND 244)")
def seasonality_alignment(t):
    g = t.cell_day().where("mm >= 29").groupBy(F.dayofyear("day").alias("doy")).agg(F.count_distinct("day").alias("g"))
    h = t.report().where("size_in >= 1").groupBy(F.dayofyear("day").alias("doy")).agg(F.count(F.lit(1)).alias("h"))
    days = t.spark.range(1, 367).select(F.col("id").cast("int").alias("doy"))
    rows = days.join(g, "doy", "left").join(h, "doy", "left").fillna(0, ["g", "h"])
    total = rows.agg(F.sum("g").alias("tg"), F.sum("h").alias("th"))
    shares = rows.where("doy between 90 and 244").select((F.col("g") / total.select("tg").scalar()).alias("a"), (F.col("h") / total.select("th").scalar()).alias("b"))
    return shares.agg(F.round(V.correlation("a", "b"), 6).alias("r"), F.when(V.correlation("a", "b") < 0.5, "warn").otherwise("pass").alias("status"))


@query(CELL_DAY, REPORT, PAIRS, "pos AS (SELECT day, cell_row, cell_col, mm, 1 AS hail FROM pairs WHERE size_in >= 1 AND mm >= 25.4)", """neg AS (SELECT day, cell_row, cell_col, mm, 0 AS hail FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY (cell_row * 7919 + cell_col * 104729) % 10007, cell_row, cell_col) AS n
  FROM cell_day c WHERE mm >= 29 AND NOT EXISTS (FROM report r WHERE r.day = c.day AND r.cell_row = c.cell_row AND r.cell_col = c.cell_col)) WHERE n <= 150)""", sql="SELECT hail, day, cell_row, cell_col, round(mm, 6) AS mm FROM (FROM pos UNION ALL FROM neg)")
def training_set(t):
    """Positives: severe reports on active cells. Negatives: event cells without a report, at most 150 a day."""
    pos = pairs(t).where("size_in >= 1 and mm >= 25.4").select(F.lit(1).alias("hail"), *V.KEY, *r6("mm"))
    order = ((F.col("cell_row") * 7919 + F.col("cell_col") * 104729) % 10007, *CELL)
    neg = V.capped_sample(V.without_report(t.cell_day(), t.report()), "day", MOST_NEGATIVES, order)
    return pos.unionByName(neg.select(F.lit(0).alias("hail"), *V.KEY, *r6("mm")))


def _ring():
    from cellweave.plans.artefacts import ANNULI
    from cellweave.sources.tables import SITE

    return SITE, ANNULI


_EDGES = grid.COARSE_EDGES
_CENTERS = V.range_centers(_EDGES)
_BIN = "CASE " + " ".join(f"WHEN km >= {e} THEN {i}" for i, e in reversed(list(enumerate(_EDGES[:-1])))) + " END"
DEBIAS = f"""src AS (SELECT CASE WHEN year(day) % 2 = 0 THEN 'A' ELSE 'C' END AS source, km, size_in, mm FROM pairs JOIN annuli USING (cell_row, cell_col)),
  fit AS (SELECT source, {_BIN} AS bin, count(*) AS n, median(size_in * 25.4e0 / mm) AS m FROM src WHERE mm >= 5 AND size_in >= 1 AND km < {_EDGES[-1]} GROUP BY ALL),
  fac AS (SELECT s.source, CAST(b.range AS INTEGER) AS bin, coalesce(n, 0) AS n, CASE WHEN n >= 30 THEN m ELSE 1 END AS f FROM (SELECT DISTINCT source FROM src) s CROSS JOIN range({len(_CENTERS)}) b LEFT JOIN fit ON fit.source = s.source AND fit.bin = b.range),
  factors AS (SELECT source, bin, n, least(greatest(f / max(CASE WHEN bin = 4 THEN f END) OVER (PARTITION BY source), 0.45), 1.15) AS factor FROM fac)"""


def _debias(t):
    from cellweave.plans.artefacts import annuli

    source = F.when(F.year("day") % 2 == 0, "A").otherwise("C")
    rows = pairs(t).join(annuli(t), CELL).withColumn("source", source)
    return V.range_debias(rows, _EDGES)


@query(CELL_DAY, REPORT, PAIRS, *_ring(), DEBIAS, sql="SELECT source, bin, n, round(factor, 6) AS factor FROM factors")
def range_debias(t):
    """Factors by range bin, relative to the bin nearest 125 km."""
    return _debias(t).withColumn("factor", F.round("factor", 6))


@query(CELL_DAY, REPORT, PAIRS, *_ring(), DEBIAS, "mids AS (SELECT source, bin, factor, list_extract(" + str(_CENTERS) + ", bin + 1) AS c FROM factors)", "segs AS (SELECT source, c AS x0, factor AS y0, lead(c) OVER w AS x1, lead(factor) OVER w AS y1, bin FROM mids WINDOW w AS (PARTITION BY source ORDER BY bin))", "cd AS (SELECT day, cell_row, cell_col, mm, km, CASE WHEN year(day) % 2 = 0 THEN 'A' ELSE 'C' END AS source FROM cell_day JOIN annuli USING (cell_row, cell_col))", "ends AS (SELECT source, arg_min(factor, bin) AS f0, arg_max(factor, bin) AS f1 FROM factors GROUP BY source)", sql=f"SELECT day, cell_row, cell_col, round(mm * CASE WHEN km < {_CENTERS[0]} THEN f0 WHEN km >= {_CENTERS[-1]} THEN f1 ELSE y0 + (y1 - y0) * (km - x0) / (x1 - x0) END, 6) AS mm FROM cd JOIN ends USING (source) LEFT JOIN segs ON segs.source = cd.source AND km >= x0 AND km < x1")
def range_debiased(t):
    """Daily maxima times the factor of their range, interpolated between bin centres."""
    from cellweave.plans.artefacts import annuli

    cells = t.cell_day().join(annuli(t), CELL).withColumn("source", F.when(F.year("day") % 2 == 0, "A").otherwise("C"))
    return V.apply_range_debias(cells, _debias(t), _EDGES).select(*V.KEY, *r6("mm"))
