"""Queries over older variants and the remaining small operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellweave.functions import clock, quality
from cellweave.operators import artefacts, climate, events, extremes, ingest, legacy
from cellweave.plans.artefacts import ANNULI, DAYS, annuli, raster
from cellweave.plans.climate import ANNUAL, r6
from cellweave.plans.events import ACTIVE, STEPS, active, center
from cellweave.plans.extremes import CHAIN, U, levels_sql, parameters, region
from cellweave.plans.ingest import PANEL, panel
from cellweave.plans.registry import query
from cellweave.sources.shared import keep
from cellweave.sources.tables import CELL_DAY, OBS, REPORT, SITE


@query(OBS, sql="SELECT m, round(avg(x), 6) AS mean, count(*) AS n_chunks FROM (SELECT day(ts) AS m, source, avg(mm) AS x FROM obs GROUP BY ALL) GROUP BY m")
def month_climatology(t):
    rows = t.obs().withColumn("m", F.dayofmonth("ts"))
    return legacy.month_climatology(rows, "source", "m", "mm").select("m", *r6("mean"), "n_chunks")


@query(sql="SELECT l_orderkey, l_linenumber, f % 48 AS i, (f // 48) % 40 AS j, f // (48 * 40) AS k FROM (SELECT l_orderkey, l_linenumber, (l_partkey * 1009 + l_suppkey) % 57600 AS f FROM lineitem)")
def index_decode(t):
    flat = (F.col("l_partkey") * 1009 + F.col("l_suppkey")) % 57600
    return t.read("lineitem").select("l_orderkey", "l_linenumber", legacy.decode_index(flat, 48, 40).alias("x")).select("l_orderkey", "l_linenumber", "x.*")


@query(CELL_DAY, sql="SELECT day, cell_row, cell_col, round(mm, 6) AS mm, round(ln(1 + mm), 6) AS log_mm, round(sin(2 * pi() * (dayofyear(day) - 1) / 366), 6) AS s, round(cos(2 * pi() * (dayofyear(day) - 1) / 366), 6) AS c FROM cell_day")
def feature_vectors(t):
    angle = (F.dayofyear("day") - 1) * 2 * F.pi() / 366
    return t.cell_day().withColumn("log_mm", F.log1p("mm")).withColumn("s", F.sin(angle)).withColumn("c", F.cos(angle)).select("day", *climate.CELL, *r6("mm", "log_mm", "s", "c"))


JUNE = tuple((lo, hi, *h) for (lo, hi), h in zip(quality.BANDS, quality.ISOTHERMS[6], strict=True))


@query(SITE, sql="SELECT site_idx, CASE " + " ".join(f"WHEN site_lat >= {a} AND site_lat < {b} THEN {h}e0" for a, b, h, _ in JUNE) + " ELSE 3.5e0 END AS h0, CASE " + " ".join(f"WHEN site_lat >= {a} AND site_lat < {b} THEN {h}e0" for a, b, _, h in JUNE) + " ELSE 6.0e0 END AS h20 FROM site")
def isotherm_lookup(t):
    """Freezing levels by latitude band for June, the fallback pair elsewhere."""
    pick = lambda n: F.coalesce(*(F.when((F.col("site_lat") >= b[0]) & (F.col("site_lat") < b[1]), b[n]) for b in JUNE))
    return t.site().select("site_idx", F.coalesce(pick(2), F.lit(3.5)).alias("h0"), F.coalesce(pick(3), F.lit(6.0)).alias("h20"))


MASK = "flags AS (SELECT r.range AS cell_row, c.range AS cell_col, (r.range + c.range) % 7 <> 0 AS inside, least(1 + 0.05e0 * r.range / 10, 1.2e0) AS factor FROM range(20) r, range(25) c)"


@query(*CHAIN, levels_sql((10, 100)), MASK, sql="SELECT rp, cell_row, cell_col, round(CASE WHEN inside THEN least(mm * factor, 300) ELSE 0 END, 4) AS mm FROM levels JOIN flags USING (cell_row, cell_col)")
def masked_levels(t):
    flags = t.spark.range(500).select(F.floor(F.col("id") / 25).cast("int").alias("cell_row"), (F.col("id") % 25).cast("int").alias("cell_col"))
    flags = flags.withColumn("inside", (F.col("cell_row") + F.col("cell_col")) % 7 != 0).withColumn("factor", quality.topo_factor(F.col("cell_row") * 100.0))
    return legacy.masked(extremes.return_levels(parameters(t), (10, 100)), flags).withColumn("mm", F.round("mm", 4))


@query(sql="SELECT c_custkey, trim(regexp_replace(trim(regexp_replace(regexp_replace(upper(trim(n)), '[^A-Z0-9]+', ' ', 'g'), '\\b(COUNTY|PARISH|BOROUGH|CITY)$', '')), '^SAINT ', 'ST ')) AS county FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Saint ' WHEN 1 THEN 'de-' ELSE '' END || c_mktsegment || CASE c_custkey % 3 WHEN 0 THEN ' County' WHEN 1 THEN ' parish' ELSE '' END AS n FROM customer)")
def county_names(t):
    k = F.col("c_custkey")
    name = F.concat(F.when(k % 4 == 0, "Saint ").when(k % 4 == 1, "de-").otherwise(""), "c_mktsegment", F.when(k % 3 == 0, " County").when(k % 3 == 1, " parish").otherwise(""))
    return t.read("customer").select("c_custkey", legacy.clean_county(name).alias("county"))


EDGES = "edges AS (SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey)"


@query(PANEL, EDGES, "wide AS (SELECT county AS center, year, total FROM panel UNION ALL SELECT a, year, total FROM panel JOIN edges ON b = county)", sql="SELECT center, count(*) AS n, round(CASE WHEN count(*) >= 10 AND regr_slope(ln(total), ln(year - 1990)) IS NOT NULL THEN least(greatest(regr_slope(ln(total), ln(year - 1990)), 0.1), 5) ELSE 1 END, 6) AS beta FROM wide GROUP BY center")
def neighbour_beta(t):
    """Log-log slopes over a county and its neighbours."""
    n = t.read("nation").select("n_nationkey", "n_name", "n_regionkey")
    other = n.select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("b"), "n_regionkey")
    edges = n.join(other, "n_regionkey").where("n_nationkey <> k2").select(F.col("n_name").alias("a"), "b")
    rows = legacy.with_neighbours(panel(t), edges, "county")
    slope = F.regr_slope(F.ln("total"), F.ln(F.col("year") - 1990))
    return rows.groupBy("center").agg(F.count(F.lit(1)).alias("n"), F.round(F.when((F.count(F.lit(1)) >= 10) & slope.isNotNull(), F.least(F.greatest(slope, F.lit(0.1)), F.lit(5.0))).otherwise(1.0), 6).alias("beta"))


@query(CELL_DAY, sql="SELECT band, cell_row // 5 AS cell_row, cell_col // 5 AS cell_col, least(count(*), 65535) AS n FROM (SELECT *, least(CAST(floor(mm / 25.4) AS INTEGER), 4) AS band FROM cell_day) GROUP BY ALL")
def band_block_sum(t):
    rows = t.cell_day().groupBy(F.least(F.floor(F.col("mm") / 25.4), F.lit(4)).cast("int").alias("band"), *climate.CELL).agg(F.count(F.lit(1)).alias("n"))
    return legacy.block_sum(rows, 5)


@query(CELL_DAY, REPORT, sql="SELECT cell_row, cell_col, count(*) AS n FROM report r WHERE NOT EXISTS (FROM cell_day c WHERE c.day = r.day AND c.cell_row = r.cell_row AND c.cell_col = r.cell_col) GROUP BY ALL ORDER BY n DESC, cell_row, cell_col LIMIT 10")
def most_unmatched(t):
    rows = t.report().join(t.cell_day(), ["day", *climate.CELL], "left_anti").groupBy(*climate.CELL).agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.desc("n"), *climate.CELL).limit(10)


@query(CELL_DAY, sql="SELECT day FROM (SELECT DISTINCT day FROM cell_day WHERE mm < 100 AND day NOT BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' UNION SELECT DISTINCT day FROM cell_day WHERE mm >= 100 AND day BETWEEN DATE '1996-01-01' AND DATE '1997-12-31')")
def label_window_replace(t):
    days = t.cell_day()
    old, new = days.where("mm < 100").select("day"), days.where("mm >= 100").select("day")
    return ingest.replace_window(old, new, "day", F.lit("1996-01-01").cast("date"), F.lit("1997-12-31").cast("date"))


@query(PANEL, sql="UNPIVOT (SELECT county, year, hail, wind FROM panel) ON hail, wind INTO NAME kind VALUE n")
def panel_unpivot(t):
    return panel(t).unpivot(["county", "year"], ["hail", "wind"], "kind", "n")


@query(CELL_DAY, ACTIVE, STEPS, sql="SELECT DISTINCT a.day FROM steps s JOIN act a ON a.day = s.day JOIN act b ON b.day = s.prev_day WHERE s.gap <= 2 AND abs(a.cell_row - b.cell_row) + abs(a.cell_col - b.cell_col) <= 3")
def diamond_overlap(t):
    cells = active(t)
    steps = events.day_steps(events.daily_footprints(cells, *center())).where("gap <= 2").select("day", "prev_day")
    return legacy.near_manhattan(cells, steps, 3)


RANKS = """rk AS (SELECT cell_row, rank() OVER (PARTITION BY cell_row ORDER BY x) + (count(*) OVER (PARTITION BY cell_row, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY cell_row ORDER BY y) + (count(*) OVER (PARTITION BY cell_row, y) - 1) / 2 AS ry
  FROM (SELECT a.cell_row, a.mm AS x, b.mm AS y FROM annual a JOIN annual b ON a.year = b.year AND a.cell_row = b.cell_row AND b.cell_col = a.cell_col + 1))"""


@query(CELL_DAY, ANNUAL, RANKS, sql="SELECT cell_row, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM rk GROUP BY cell_row HAVING count(*) >= 5")
def neighbour_spearman(t):
    """Rank correlation of annual maxima of horizontal neighbours."""
    a = climate.annual_max(t.cell_day())
    b = a.select("year", "cell_row", (F.col("cell_col") - 1).alias("cell_col"), F.col("mm").alias("y"))
    return legacy.spearman(a.withColumnRenamed("mm", "x").join(b, ["year", *climate.CELL]), ["cell_row"], "x", "y").withColumn("rho", F.round("rho", 6))


@query(OBS, SITE, DAYS, ANNULI, sql="SELECT source, round(stddev_pop(m) / avg(m), 6) AS cv, CASE WHEN stddev_pop(m) / avg(m) >= 0.45 THEN 'warn' ELSE 'pass' END AS status FROM (SELECT CASE WHEN day(day) % 2 = 0 THEN 'even' ELSE 'odd' END AS source, bin, avg(mm) AS m FROM raster JOIN annuli USING (cell_row, cell_col) GROUP BY ALL HAVING count(*) >= 10) GROUP BY source")
def ring_energy(t):
    rows = raster(t).join(annuli(t), climate.CELL).withColumn("source", F.when(F.dayofmonth("day") % 2 == 0, "even").otherwise("odd"))
    profile = rows.groupBy("source", "bin").agg(F.avg("mm").alias("m"), F.count(F.lit(1)).alias("n")).where("n >= 10")
    cv = F.stddev_pop("m") / F.avg("m")
    return profile.groupBy("source").agg(F.round(cv, 6).alias("cv"), F.when(cv >= 0.45, "warn").otherwise("pass").alias("status"))


@query(OBS, sql="SELECT bucket, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate, round(avg((p - y) * (p - y)), 6) AS brier FROM (SELECT CAST(floor(p * 5) AS INTEGER) AS bucket, p, y FROM (SELECT least(mm / 100e0, 0.999e0) AS p, CAST(nobs > 3 AS INTEGER) AS y FROM obs)) GROUP BY bucket")
def filter_reliability(t):
    rows = t.obs().select(F.least(F.col("mm") / 100.0, F.lit(0.999)).alias("p"), (F.col("nobs") > 3).cast("int").alias("y"))
    d = F.col("p") - F.col("y")
    return rows.groupBy(F.floor(F.col("p") * 5).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("y"), 6).alias("rate"), F.round(F.avg(d * d), 6).alias("brier"))


@query(CELL_DAY, "firsts AS (SELECT day, (row_number() OVER (ORDER BY day) - 1) % 10 AS k FROM (SELECT DISTINCT day FROM cell_day))", sql="SELECT day, cell_row, cell_col, round(mm, 6) AS mm FROM cell_day JOIN firsts USING (day) WHERE k = 0")
def systematic_days(t):
    from cellweave.sources.sinks import every_nth_day

    return every_nth_day(t.cell_day(), 10).select("day", *climate.CELL, *r6("mm"))


@query(OBS, SITE, DAYS, ANNULI, "listed AS (SELECT * FROM annuli WHERE site_idx IN (0, 20, 40))", "meds AS (SELECT day, site_idx, bin, sector, median(mm) AS med FROM raster JOIN listed USING (cell_row, cell_col) WHERE mm >= 5 GROUP BY ALL HAVING count(*) >= 4)", sql="SELECT r.day, r.cell_row, r.cell_col, round(CASE WHEN med IS NOT NULL AND r.mm >= 5 AND r.mm > 1.5 * greatest(med, 1) THEN 0 ELSE r.mm END, 6) AS mm FROM raster r LEFT JOIN listed a USING (cell_row, cell_col) LEFT JOIN meds m ON m.day = r.day AND m.site_idx = a.site_idx AND m.bin = a.bin AND m.sector = a.sector")
def site_remediation(t):
    """Polar spokes of listed sites only; other sites' cells don't change."""
    flagged = annuli(t).where(F.col("site_idx").isin(0, 20, 40))
    out = artefacts.above_median(raster(t), flagged, ["site_idx", "bin", "sector"], 4, 1.5)
    return out.select("day", *climate.CELL, *r6("mm"))


@query(CELL_DAY, sql="SELECT month(day) AS month, strftime(day, '%m%d') AS mmdd, year(day) % 4 = 0 AS leap, count(*) AS n, min(least(abs(dayofyear(day) - 15), 366 - abs(dayofyear(day) - 15))) AS from_mid_january FROM cell_day GROUP BY ALL")
def calendar_labels(t):
    d = F.col("day")
    return t.cell_day().groupBy(F.month(d).alias("month"), F.date_format(d, "MMdd").alias("mmdd"), (F.year(d) % 4 == 0).alias("leap")).agg(F.count(F.lit(1)).alias("n"), F.min(clock.doy_distance(F.dayofyear(d), F.lit(15))).alias("from_mid_january"))


@query(CELL_DAY, "p AS (SELECT year(day) AS year, count(*) AS n FROM cell_day GROUP BY 1)", sql="SELECT year, n, n - first_value(n) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS since_first, last_value(n) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_n, n - lag(n) OVER (ORDER BY year) AS since_last FROM p")
def yearly_trend(t):
    w = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = t.cell_day().groupBy(F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("year", "n", (F.col("n") - F.first("n").over(w)).alias("since_first"), F.last("n").over(w).alias("last_n"), (F.col("n") - F.lag("n").over(Window.orderBy("year"))).alias("since_last"))


@query()
def gpd_likelihood_fit(t):
    """Maximum-likelihood tails by region."""
    over = climate.annual_max(t.cell_day()).where(F.col("mm") > U).select(region().alias("region"), (F.col("mm") - U).alias("x"))
    return legacy.fit_gpd(keep(over, "excesses"), "region")


