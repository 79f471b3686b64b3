"""Queries over coverage, manifests, calibration, volume columns, counties, streams and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions import clock, quality
from cellweave.operators import climate, ingest, models
from cellweave.plans.climate import CLEAN, r6
from cellweave.plans.events import center
from cellweave.plans.extremes import CHAIN, levels_sql
from cellweave.plans.registry import query
from cellweave.sources.shared import keep
from cellweave.sources.tables import CELL_DAY, OBS

COVER = """seconds AS (SELECT DISTINCT source, CAST(ts - INTERVAL 12 HOUR AS DATE) AS day, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM obs),
  gaps AS (SELECT *, s - lag(s) OVER (PARTITION BY source, day ORDER BY s) AS gap FROM seconds),
  cover AS (SELECT source, day, count(*) AS n, min(s) AS first_s, max(s) AS last_s, coalesce(max(gap), 0) AS max_gap_s FROM gaps GROUP BY ALL)"""


@query(OBS, COVER, sql="SELECT *, n >= 6 AND first_s - (epoch(day) + 43200) <= 1800 AND epoch(day) + 43200 + 86400 - last_s <= 1800 AND max_gap_s <= 3600 AS covered FROM cover")
def window_coverage(t):
    return ingest.window_coverage(t.obs(), ["source"])


MANIFEST = f"""man AS (SELECT *, CASE WHEN source_files = 0 THEN 'missing_source' WHEN read_errors >= source_files THEN 'error' WHEN read_errors > 0 AND active_cells > 0 THEN 'ok_with_read_errors' WHEN read_errors > 0 THEN 'no_hail_pixels_with_read_errors' WHEN active_cells = 0 THEN 'no_hail_pixels' ELSE 'ok' END AS status
  FROM (SELECT source, CAST(ts - INTERVAL 12 HOUR AS DATE) AS day, count(*) AS source_files, count(*) FILTER (WHERE mm IS NULL OR isnan(mm) OR mm < 0 OR mm > 300) AS read_errors,
    count(DISTINCT CASE WHEN {CLEAN} >= 29 THEN cell_row * 1000 + cell_col END) AS active_cells, max({CLEAN}) AS max_mm FROM obs GROUP BY ALL))"""


@query(OBS, MANIFEST, sql="SELECT source, day, source_files, read_errors, active_cells, round(max_mm, 6) AS max_mm, status FROM man")
def manifest_status(t):
    return ingest.manifest(t.obs()).withColumn("max_mm", F.round("max_mm", 6))


@query(OBS, MANIFEST, sql="SELECT source, coalesce(count(*) FILTER (WHERE status = 'ok'), 0) AS ok, coalesce(count(*) FILTER (WHERE status = 'ok_with_read_errors'), 0) AS ok_with_read_errors FROM man GROUP BY source")
def coverage_pivot(t):
    return ingest.manifest(t.obs()).groupBy("source").pivot("status", ["ok", "ok_with_read_errors"]).count().fillna(0)


@query(OBS, MANIFEST, sql="SELECT source, day, CASE WHEN day < DATE '2024-01-11' THEN source_files WHEN day >= DATE '2024-01-21' THEN source_files ELSE source_files + 100 END AS source_files, status FROM man")
def manifest_upsert(t):
    both = keep(ingest.manifest(t.obs()).select("source", "day", "source_files", "status"), "manifest")
    new = both.where("day >= date'2024-01-11' and day < date'2024-01-21'").withColumn("source_files", F.col("source_files") + 100)
    return ingest.upsert(both.where("day < date'2024-01-16' or day >= date'2024-01-21'"), new, ["source", "day"])


@query(OBS, MANIFEST, sql="SELECT source, day, CASE WHEN active_cells % 2 = 0 THEN source_files ELSE 0 END AS source_files, CASE WHEN active_cells % 2 = 0 THEN 'new' ELSE 'new' END AS status FROM man")
def manifest_provenance(t):
    """New rows of even days skipped their input and keep the prior file counts."""
    old = keep(ingest.manifest(t.obs()).select("source", "day", "source_files", "active_cells"), "manifest").withColumn("status", F.lit("old"))
    new = old.withColumn("source_files", F.lit(0).cast("long")).withColumn("status", F.lit("new"))
    return ingest.upsert_keeping_provenance(old, new, ["source", "day"], F.col("active_cells") % 2 == 0, ["source_files"]).drop("active_cells")


@query(OBS, sql="SELECT event_id, source, cell_row, cell_col FROM obs o WHERE CASE source WHEN 'B' THEN 1 WHEN 'C' THEN 2 ELSE 3 END = (SELECT min(CASE source WHEN 'B' THEN 1 WHEN 'C' THEN 2 ELSE 3 END) FROM obs p WHERE p.cell_row = o.cell_row AND p.cell_col = o.cell_col AND CAST(p.ts - INTERVAL 12 HOUR AS DATE) = CAST(o.ts - INTERVAL 12 HOUR AS DATE))")
def source_preference(t):
    rows = t.obs().withColumn("day", clock.convective_day(F.col("ts")))
    return ingest.prefer_sources(rows, ["day", *climate.CELL], {"B": 1, "C": 2, "A": 3}).select("event_id", "source", *climate.CELL)


@query(OBS, sql="SELECT event_id FROM obs o WHERE source = 'A' AND NOT EXISTS (SELECT 1 FROM obs b WHERE b.source = 'B' AND abs(epoch_us(o.ts) - epoch_us(b.ts)) <= 180000000)")
def gap_fill_antijoin(t):
    obs = t.obs()
    return ingest.without_near_times(obs.where("source = 'A'"), obs.where("source = 'B'"), 180).select("event_id")


KNOTS = f"knots AS (SELECT source, unnest(range(201)) AS k, unnest(quantile_cont(mm, [{', '.join(str(k / 200) for k in range(201))}])) AS q FROM (SELECT source, {CLEAN} AS mm FROM obs) WHERE mm > 0 GROUP BY source)"


def knots(t):
    clean = t.obs().withColumn("mm", quality.sanitize(F.col("mm"))).where("mm > 0")
    return ingest.quantile_knots(clean, ["source"])


@query(OBS, KNOTS, sql="SELECT source, k, round(q, 6) AS q FROM knots")
def quantile_knots(t):
    return knots(t).select("source", "k", *r6("q"))


@query(OBS, KNOTS, """ends AS (SELECT source, min(q) AS lo, max(q) AS hi FROM knots GROUP BY source)""", f"""src AS (SELECT event_id, {CLEAN} AS mm FROM obs WHERE source = 'C')""", """seg AS (SELECT a.q AS x0, b.q AS x1, c.q AS y0, d.q AS y1, a.k FROM knots a JOIN knots b ON b.source = 'C' AND b.k = a.k + 1 JOIN knots c ON c.source = 'A' AND c.k = a.k JOIN knots d ON d.source = 'A' AND d.k = a.k + 1 WHERE a.source = 'C')""", sql="""SELECT event_id, round(CASE WHEN mm <= 0 THEN 0 ELSE least(coalesce((SELECT arg_max(y0 + (y1 - y0) * (mm - x0) / (x1 - x0), k) FROM seg WHERE mm >= x0 AND mm < x1), CASE WHEN mm >= (SELECT hi FROM ends WHERE source = 'C') THEN (SELECT hi FROM ends WHERE source = 'A') ELSE (SELECT lo FROM ends WHERE source = 'A') END), 300) END, 6) AS mapped FROM src""")
def quantile_mapping(t):
    clean = t.obs().withColumn("mm", quality.sanitize(F.col("mm")))
    return ingest.quantile_map(clean, knots(t), "C", "A").select("event_id", *r6("mapped"))


@query(OBS, sql="SELECT event_id, NOT ((nobs >= 3 AND necho / greatest(nobs, 1) < 0.6) OR mm / 100e0 < 1.5) AS keep FROM obs")
def reflectivity_filter(t):
    return t.obs().select("event_id", quality.keep_reflectivity(F.col("nobs"), F.col("necho"), F.col("mm") / 100.0).alias("keep"))


COLUMN_SQL = "lev AS (SELECT l_orderkey AS id, l_linenumber * 1e0 + (l_partkey % 10) / 20e0 AS alt, 30 + l_quantity / 1.5e0 AS dbz, 5 - l_orderkey % 3 AS hz, 7 + l_orderkey % 2 AS h20 FROM lineitem)"


@query(COLUMN_SQL, "ord AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY alt, dbz) AS i, count(*) OVER (PARTITION BY id) AS n, lag(alt) OVER w AS a0, lead(alt) OVER w AS a1 FROM lev WINDOW w AS (PARTITION BY id ORDER BY alt, dbz))", "dep AS (SELECT *, CASE WHEN n = 1 THEN 1000 WHEN i = 1 THEN abs(a1 - alt) * 1000 WHEN i = n THEN abs(alt - a0) * 1000 ELSE abs(a1 - a0) / 2 * 1000 END AS d FROM ord)", sql="SELECT id, round(0.1e0 * sum(CASE WHEN dbz >= 40 AND alt >= hz - 1 THEN CASE WHEN alt >= h20 - 2 THEN 1 ELSE (alt - (hz - 1)) / (h20 - 2 - (hz - 1)) END * 5e-6 * pow(10, 0.084e0 * dbz) * d ELSE 0 END), 6) AS shi FROM dep GROUP BY id")
def shi_column(t):
    rows = t.read("lineitem").select(F.col("l_orderkey").alias("id"), F.struct((F.col("l_linenumber") * 1.0 + (F.col("l_partkey") % 10) / 20.0).alias("alt_km"), (F.col("l_quantity") / 1.5 + 30).alias("dbz")).alias("x"))
    columns = rows.groupBy("id").agg(F.collect_list("x").alias("profile"))
    shi = ingest.severe_hail_index(F.col("profile"), (F.lit(4) - F.col("id") % 3).cast("double"), (F.lit(5) + F.col("id") % 2).cast("double"))
    return columns.select("id", F.round(shi, 6).alias("shi"))


@query("lev AS (SELECT l_orderkey AS id, l_linenumber AS i, l_linenumber * 1.5e0 AS h, 290 - l_linenumber * 6e0 + (l_partkey % 7) AS t FROM lineitem)", "pr AS (SELECT id, row_number() OVER w AS i, h AS h0, t AS t0, lead(h) OVER w AS h1, lead(t) OVER w AS t1 FROM lev WINDOW w AS (PARTITION BY id ORDER BY i, t))", sql="SELECT id, round(coalesce(arg_max(CASE WHEN (t0 - 273.15) * (t1 - 273.15) <= 0 AND t0 <> t1 THEN h0 + (h1 - h0) * (273.15e0 - t0) / (t1 - t0) END, CASE WHEN (t0 - 273.15) * (t1 - 273.15) <= 0 AND t0 <> t1 THEN i END), 3.5), 6) AS h0c FROM pr GROUP BY id")
def isotherm_height(t):
    rows = t.read("lineitem").select(F.col("l_orderkey").alias("id"), F.struct(F.col("l_linenumber").alias("i"), (F.col("l_linenumber") * 1.5).alias("h"), (F.lit(290.0) - F.col("l_linenumber") * 6.0 + F.col("l_partkey") % 7).alias("t")).alias("x"))
    levels = rows.groupBy("id").agg(F.sort_array(F.collect_list("x")).alias("levels"))
    return levels.select("id", F.round(ingest.isotherm_height(F.col("levels"), 273.15, 3.5), 6).alias("h0c"))


PANEL = """panel AS (SELECT n_name AS county, year(o_orderdate) AS year, count(*) FILTER (WHERE o_orderstatus = 'O') AS hail, count(*) FILTER (WHERE o_orderstatus = 'F') AS wind, count(*) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""


def panel(t):
    rows = t.read("orders").join(t.read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t.read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("county"), F.year("o_orderdate").alias("year")).agg(F.count_if(F.col("o_orderstatus") == "O").alias("hail"), F.count_if(F.col("o_orderstatus") == "F").alias("wind"), F.count(F.lit(1)).alias("total"))


@query(PANEL, sql="SELECT county, year, hail, wind, total FROM panel UNION ALL SELECT 'ALL', year, CAST(sum(hail) AS BIGINT), CAST(sum(wind) AS BIGINT), CAST(sum(total) AS BIGINT) FROM panel GROUP BY year")
def county_panel(t):
    """Counts a county and year, and the national rollup."""
    rows = panel(t)
    total = rows.groupBy("year").agg(*(F.sum(c).alias(c) for c in ("hail", "wind", "total")))
    return rows.unionByName(total.select(F.lit("ALL").alias("county"), "*"))


@query(PANEL, sql="SELECT county, round(CASE WHEN count(*) >= 5 AND regr_slope(ln(total), ln(year - 1990)) IS NOT NULL THEN least(greatest(regr_slope(ln(total), ln(year - 1990)), -5), 5) ELSE 1 END, 6) AS beta FROM panel GROUP BY county")
def local_beta(t):
    slope = F.regr_slope(F.ln("total"), F.ln(F.col("year") - 1990))
    return panel(t).groupBy("county").agg(F.round(F.when((F.count(F.lit(1)) >= 5) & slope.isNotNull(), F.least(F.greatest(slope, F.lit(-5.0)), F.lit(5.0))).otherwise(1.0), 6).alias("beta"))


@query(CELL_DAY, "binned AS (SELECT cell_row, cell_col, least(CAST(floor(mm / 25.4) AS INTEGER), 4) AS b FROM cell_day)", sql="SELECT cell_row, cell_col, max(b) * 25.4e0 + 12.7e0 AS max_mid, round(sum(b * 25.4e0 + 12.7e0) / count(*), 6) AS mean_mid FROM binned GROUP BY ALL")
def characteristic_size(t):
    b = F.least(F.floor(F.col("mm") / 25.4), F.lit(4)).cast("int")
    mid = b * 25.4 + 12.7
    return t.cell_day().groupBy(*climate.CELL).agg(F.max(mid).alias("max_mid"), F.round(F.sum(mid) / F.count(F.lit(1)), 6).alias("mean_mid"))


@query(OBS, f"clean AS (SELECT ts, cell_row, cell_col, {CLEAN} AS mm FROM obs)", sql="SELECT CAST(ts - INTERVAL 12 HOUR AS DATE) AS day, cell_row, cell_col, max(mm) AS mm FROM clean GROUP BY ALL")
def stream_daily_max(t):
    """The daily maxima through a stream that reads what is there and stops; changed keys go to files, batch by batch."""
    import posixpath
    import uuid

    from cellweave.sources.shared import keep as kept
    from cellweave.streaming import daily

    source = kept(t.obs().select("ts", *climate.CELL, "mm"), "stream-source")
    path = posixpath.dirname(source.inputFiles()[0])
    stream = daily.daily_max_stream(t.spark.readStream.schema(source.schema).parquet(path))
    folder = f"{t.spark.conf.get('spark.checkpoint.dir').rstrip('/')}/stream-{uuid.uuid4().hex}"
    daily.upsert_batches(stream, f"{folder}/state", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    return daily.read_upserts(t.spark, f"{folder}/out", ["day", *climate.CELL])


@query()
def region_clusters(t):
    """Cells in up to six regions by K-means on mean hail, occurrence, latitude and longitude; ten starts."""
    days = t.cell_day()
    annual = keep(climate.annual_max(days), "annual")
    return models.region_clusters(annual, climate.years_of(days).first()[0], *center())


_P, _XI, _SCALE = models.jittered("rep", "d")


@query(*CHAIN, f"sample AS MATERIALIZED (SELECT *, CAST(row_number() OVER (ORDER BY {models.SAMPLE_ORDER}, cell_row, cell_col) AS INTEGER) AS i FROM parameters QUALIFY i <= 150)", "size AS (SELECT count(*) AS n FROM sample)", levels_sql((100,)).replace("levels AS", "point AS").replace("FROM parameters", "FROM sample"), f"drawn AS (SELECT rep, d, {models.draw('rep', 'd', 'n')} AS i FROM (SELECT a.range AS rep, b.range AS d, n FROM range(1, 251) a, range(1, 151) b, size WHERE b.range <= n))", f"moved AS (SELECT rep AS cell_row, d AS cell_col, mu, sigma, u, {_P} AS p_occ, {_XI} AS xi, {_SCALE} AS scale FROM drawn JOIN sample USING (i))", levels_sql((100,)).replace("FROM parameters", "FROM moved"), "meds AS (SELECT median(mm) AS m FROM levels WHERE mm > 0 GROUP BY cell_row)", sql="SELECT round(low, 4) AS low, round(mid, 4) AS mid, round(high, 4) AS high, round((high - low) / greatest(mid, 1), 4) AS width, CASE WHEN (high - low) / greatest(mid, 1) > 0.5 THEN 'warn' ELSE 'pass' END AS status FROM (SELECT quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM meds), (SELECT median(mm) AS mid FROM point WHERE mm > 0)")
def bootstrap_ci(t):
    """Interval of the 100-year level by 250 replicates of 150 cells with jittered parameters."""
    from cellweave.plans.extremes import parameters

    out = models.bootstrap(keep(parameters(t), "parameters"))
    return out.select(*(F.round(c, 4).alias(c) for c in ("low", "mid", "high", "width")), "status")
