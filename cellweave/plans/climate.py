"""Queries over daily maxima and their climatology."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellweave.functions import clock, grid, quality
from cellweave.operators import climate
from cellweave.plans.registry import query
from cellweave.sources.tables import CELL_DAY, CELL_DAY_FINE, OBS, SITE

CLEAN = "CASE WHEN mm IS NULL OR isnan(mm) OR mm < 0 OR mm > 300 THEN 0e0 ELSE mm END"
YEARS = "years AS (SELECT count(DISTINCT year(day)) AS n_years FROM cell_day)"
ANNUAL = "annual AS (SELECT year(day) AS year, cell_row, cell_col, max(mm) AS mm FROM cell_day GROUP BY ALL)"


def r6(*names):
    return [F.round(F.col(n), 6).alias(n) for n in names]


@query(OBS, sql=f"""SELECT source, count(*) AS n, count(*) FILTER (WHERE mm IS NULL OR isnan(mm) OR mm < 0 OR mm > 300) AS n_bad,
  round(sum({CLEAN}), 4) AS total, round(max({CLEAN}), 6) AS peak FROM obs GROUP BY source""")
def sanitize_qa(t):
    v = F.col("mm")
    return t.obs().groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(quality.is_bad(v)).alias("n_bad"), F.round(F.sum(quality.sanitize(v)), 4).alias("total"), F.round(F.max(quality.sanitize(v)), 6).alias("peak"))


@query(OBS, sql="SELECT event_id, round(CASE WHEN mm > 0 THEN 15.096e0 * pow(mm / 2.54e0, 0.412e0) ELSE 0 END, 6) AS mm75 FROM obs")
def witt_recalibration(t):
    return t.obs().select("event_id", F.round(quality.recalibrate(F.col("mm")), 6).alias("mm75"))


@query(CELL_DAY, sql="""SELECT day, cell_row, cell_col, round(CASE WHEN mm < 5 OR ((dayofyear(day) >= 305 OR dayofyear(day) <= 59) AND cell_row + 24 < 30 AND mm < 29) THEN 0 ELSE mm END, 6) AS mm
  FROM cell_day""")
def environment_filter(t):
    v = quality.environment_filter(F.col("mm"), F.col("cell_row") + 24.0, F.dayofyear("day"))
    return t.cell_day().select("day", *climate.CELL, F.round(v, 6).alias("mm"))


@query(OBS, sql="""SELECT event_id, round(CASE WHEN p IS NULL THEN CASE WHEN mm < 5 OR ((doy >= 305 OR doy <= 59) AND lat < 30 AND mm < 29) THEN 0 ELSE mm END
    WHEN mm * p < 5 OR mm * p > 300 THEN 0 ELSE mm * p END, 6) AS mm
  FROM (SELECT *, CASE WHEN nobs > 0 THEN least(greatest(necho / 3e0, 0), 1) END AS p, cell_row + 24e0 AS lat, dayofyear(ts) AS doy FROM obs)""")
def probability_filter(t):
    p = F.when(F.col("nobs") > 0, F.col("necho") / 3.0)
    v = quality.probability_filter(F.col("mm"), p, F.col("cell_row") + 24.0, F.dayofyear("ts"))
    return t.obs().select("event_id", F.round(v, 6).alias("mm"))


@query(CELL_DAY, sql="""SELECT CASE WHEN d >= DATE '2020-10-14' THEN 'MRMS' WHEN d >= DATE '2012-01-01' THEN 'GridRad' ELSE 'MYRORSS' END AS era, count(*) AS n, count(DISTINCT year(d)) AS years
  FROM (SELECT day + INTERVAL 6935 DAY AS d FROM cell_day) GROUP BY 1""")
def era_classification(t):
    days = t.cell_day().select(F.date_add("day", 6935).alias("d"))
    return days.groupBy(clock.era(F.col("d")).alias("era")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.year("d")).alias("years"))


@query(OBS, sql=f"SELECT CAST(ts - INTERVAL 12 HOUR AS DATE) AS day, cell_row, cell_col, max({CLEAN}) AS mm FROM obs GROUP BY ALL")
def convective_day_max(t):
    clean = t.obs().withColumn("mm", quality.sanitize(F.col("mm")))
    return climate.cell_day_max(clean, clock.convective_day(F.col("ts")))


@query(CELL_DAY_FINE, sql="SELECT day, cell_row // 5 AS cell_row, cell_col // 5 AS cell_col, max(mm) AS mm FROM cell_day_fine GROUP BY ALL")
def block_max(t):
    return climate.block_max(t.cell_day_fine())


@query(SITE, sql="""SELECT site_idx, CASE WHEN ok THEN r ELSE -1 END AS cell_row, CASE WHEN ok THEN c ELSE -1 END AS cell_col,
    round(CASE WHEN ok THEN 50.005e0 - (r + 0.5e0) * 0.05e0 END, 6) AS center_lat, round(CASE WHEN ok THEN -125.005e0 + (c + 0.5e0) * 0.05e0 END, 6) AS center_lon
  FROM (SELECT *, r BETWEEN 0 AND 519 AND c BETWEEN 0 AND 1179 AS ok FROM (SELECT site_idx,
    CAST(trunc((50.005e0 - (site_lat + 2.01e0)) / 0.05e0) AS INTEGER) AS r, CAST(trunc((site_lon - 5.03e0 + 125.005e0) / 0.05e0) AS INTEGER) AS c FROM site))""")
def latlon_to_grid(t):
    cell = grid.latlon_to_cell(F.col("site_lat") + 2.01, F.col("site_lon") - 5.03)
    lat, lon = grid.cell_center(F.col("cell_row"), F.col("cell_col"))
    inside = F.col("cell_row") >= 0
    return t.site().select("site_idx", cell.alias("x")).select("site_idx", "x.*").select("site_idx", *climate.CELL, F.round(F.when(inside, lat), 6).alias("center_lat"), F.round(F.when(inside, lon), 6).alias("center_lon"))


@query(sql="""SELECT p_partkey, round(least(greatest(1 + 0.05e0 * km, 1), 1.2e0), 6) AS by_elevation,
    round(least(greatest(coalesce(1 + km / CASE WHEN fl > 0.25 THEN fl END * 0.25e0, 1 + 0.05e0 * km), 1), 1.25e0), 6) AS by_level
  FROM (SELECT p_partkey, least(greatest(p_retailprice * 3 - 3000, 0), 4000) / 1000e0 AS km, p_size / 10e0 AS fl FROM part)""")
def topo_factor(t):
    height, level = F.col("p_retailprice") * 3 - 3000, F.col("p_size") / 10.0
    return t.read("part").select("p_partkey", F.round(quality.topo_factor(height), 6).alias("by_elevation"), F.round(quality.topo_factor(height, level), 6).alias("by_level"))


@query(CELL_DAY, ANNUAL, sql="SELECT year, cell_row, cell_col, mm FROM annual")
def annual_max(t):
    return climate.annual_max(t.cell_day())


@query(CELL_DAY, ANNUAL, YEARS, sql="SELECT cell_row, cell_col, round(count(*) FILTER (WHERE mm > 0) / n_years, 6) AS p_occ, " + ", ".join(f"round(count(*) FILTER (WHERE mm >= {x}) / n_years, 6) AS p_{i}" for i, x in enumerate(grid.THRESHOLDS_MM)) + " FROM annual, years GROUP BY cell_row, cell_col, n_years")
def occurrence_probability(t):
    days = t.cell_day()
    out = climate.occurrence(climate.annual_max(days), climate.years_of(days), grid.THRESHOLDS_MM)
    return out.select(*climate.CELL, *r6(*out.columns[2:]))


@query(CELL_DAY, "n AS (SELECT dayofyear(day) AS doy, count(DISTINCT day) AS n_days FROM cell_day GROUP BY 1)", sql="SELECT doy, cell_row, cell_col, round(sum(mm) / n_days, 6) AS mean_mm FROM cell_day JOIN n ON dayofyear(day) = doy GROUP BY doy, cell_row, cell_col, n_days")
def doy_climatology(t):
    return climate.doy_means(t.cell_day()).select("doy", *climate.CELL, *r6("mean_mm"))


@query(CELL_DAY, "n AS (SELECT count(DISTINCT day) AS f, count(DISTINCT year(day)) AS y FROM cell_day)", sql="SELECT cell_row, cell_col, round(sum(mm) / f, 6) AS mean_mm, round(count(*) FILTER (WHERE mm > 0) / y, 6) AS days_per_year FROM cell_day, n GROUP BY cell_row, cell_col, f, y")
def annual_mean_and_hail_days(t):
    return climate.annual_means(t.cell_day()).select(*climate.CELL, *r6("mean_mm", "days_per_year"))


@query(CELL_DAY, sql="SELECT cell_row, cell_col, year(day) AS year, month(day) AS month, count(*) FILTER (WHERE mm >= 25.4) AS days_0, count(*) FILTER (WHERE mm >= 29.0) AS days_1, count(*) FILTER (WHERE mm >= 50.8) AS days_2 FROM cell_day GROUP BY ALL")
def hail_day_counts(t):
    return climate.hail_day_counts(t.cell_day(), (25.4, 29.0, 50.8))


@query(CELL_DAY, YEARS, "rate AS (SELECT cell_row, cell_col, count(*) FILTER (WHERE mm >= 29.0) / n_years AS per_year FROM cell_day, years GROUP BY cell_row, cell_col, n_years)", sql="""SELECT box, count(*) AS n_active, round(max(per_year), 6) AS max_rate, round(quantile_cont(per_year, 0.95), 6) AS p95, round(quantile_cont(per_year, 0.99), 6) AS p99,
    round(avg(per_year), 6) AS mean_rate, round(median(per_year), 6) AS median_rate
  FROM (SELECT *, unnest(CASE WHEN cell_row BETWEEN 5 AND 14 AND cell_col BETWEEN 8 AND 16 THEN ['all', 'plains'] ELSE ['all'] END) AS box FROM rate WHERE per_year > 0) GROUP BY box""")
def hail_day_rates(t):
    days = t.cell_day()
    rate = days.groupBy(*climate.CELL).agg(F.count_if(F.col("mm") >= grid.EVENT_MM).alias("n")).withColumn("per_year", F.col("n") / climate.years_of(days).scalar()).where("per_year > 0")
    plains = F.col("cell_row").between(5, 14) & F.col("cell_col").between(8, 16)
    boxed = rate.withColumn("box", F.explode(F.when(plains, F.array(F.lit("all"), F.lit("plains"))).otherwise(F.array(F.lit("all")))))
    v = F.col("per_year")
    return boxed.groupBy("box").agg(F.count(F.lit(1)).alias("n_active"), F.round(F.max(v), 6).alias("max_rate"), F.round(F.percentile(v, F.lit(0.95)), 6).alias("p95"), F.round(F.percentile(v, F.lit(0.99)), 6).alias("p99"), F.round(F.avg(v), 6).alias("mean_rate"), F.round(F.median(v), 6).alias("median_rate"))


PEAKS = f"peaks AS (SELECT source, CAST(ts - INTERVAL 12 HOUR AS DATE) AS day, max({CLEAN}) AS peak_mm, count(*) FILTER (WHERE {CLEAN} > 0) AS active FROM obs GROUP BY ALL)"


def daily_peaks(t):
    clean = t.obs().withColumn("mm", quality.sanitize(F.col("mm")))
    return clean.groupBy("source", clock.convective_day(F.col("ts")).alias("day")).agg(F.max("mm").alias("peak_mm"), F.count_if(F.col("mm") > 0).alias("active"))


@query(OBS, PEAKS, sql="SELECT source, subset, count(*) AS n, round(avg(peak_mm), 6) AS mean, round(max(peak_mm), 6) AS max, " + ", ".join(f"round(quantile_cont(peak_mm, {p / 100}), 6) AS p{p}" for p in (50, 75, 90, 95, 99)) + " FROM (SELECT *, unnest(CASE WHEN active >= 60 THEN ['all', 'busy'] ELSE ['all'] END) AS subset FROM peaks) GROUP BY source, subset")
def peak_percentiles(t):
    both = F.when(F.col("active") >= 60, F.array(F.lit("all"), F.lit("busy"))).otherwise(F.array(F.lit("all")))
    out = climate.percentile_table(daily_peaks(t).withColumn("subset", F.explode(both)), ["source", "subset"], "peak_mm", (50, 75, 90, 95, 99))
    return out.select("source", "subset", "n", *r6(*out.columns[3:]))


@query(OBS, PEAKS, sql="SELECT source, day, peak_mm, round(cume_dist() OVER (PARTITION BY source ORDER BY peak_mm), 6) AS ecdf FROM peaks")
def ecdf_by_source(t):
    return climate.ecdf(daily_peaks(t).drop("active"), ["source"], "peak_mm").select("source", "day", "peak_mm", *r6("ecdf"))


@query(OBS, PEAKS, sql="SELECT source, arg_max(day, (peak_mm, day)) AS top_day, round(max(peak_mm), 6) AS peak_mm, count(*) AS n_days, sum(active)::BIGINT AS active FROM peaks GROUP BY source")
def daily_peak_summary(t):
    return daily_peaks(t).groupBy("source").agg(F.max_by("day", F.struct("peak_mm", "day")).alias("top_day"), F.round(F.max("peak_mm"), 6).alias("peak_mm"), F.count(F.lit(1)).alias("n_days"), F.sum("active").alias("active"))


@query(CELL_DAY, sql="SELECT year(day) AS year, count(DISTINCT day) FILTER (WHERE mm >= 25.4) AS damage_days, count(DISTINCT day) FILTER (WHERE mm >= 29.0) AS event_days, count(DISTINCT day) AS data_days FROM cell_day GROUP BY 1")
def national_hail_days(t):
    any_day = lambda x: F.count_distinct(F.when(F.col("mm") >= x, F.col("day")))
    return t.cell_day().groupBy(F.year("day").alias("year")).agg(any_day(25.4).alias("damage_days"), any_day(29.0).alias("event_days"), F.count_distinct("day").alias("data_days"))


@query(CELL_DAY, ANNUAL, YEARS, sql="""SELECT era, count(*) AS n_cells, round(avg(mean_max), 6) AS mean_annual_max FROM (
    SELECT era, cell_row, cell_col, sum(mm) / any_value(n_years) AS mean_max FROM (SELECT CASE WHEN year < 1998 THEN 'early' ELSE 'late' END AS era, * FROM annual)
    JOIN (SELECT CASE WHEN year < 1998 THEN 'early' ELSE 'late' END AS era, count(DISTINCT year) AS n_years FROM annual GROUP BY 1) USING (era) GROUP BY era, cell_row, cell_col) GROUP BY era""")
def era_mean_annual_max(t):
    """Mean over cells of the mean annual maximum of each era, years without signal counting 0."""
    annual = climate.annual_max(t.cell_day()).withColumn("era", F.when(F.col("year") < 1998, "early").otherwise("late"))
    n = annual.groupBy("era").agg(F.count_distinct("year").alias("n_years"))
    cells = annual.groupBy("era", *climate.CELL).agg(F.sum("mm").alias("s")).join(F.broadcast(n), "era").withColumn("m", F.col("s") / F.col("n_years"))
    return cells.groupBy("era").agg(F.count(F.lit(1)).alias("n_cells"), F.round(F.avg("m"), 6).alias("mean_annual_max"))


@query(CELL_DAY, ANNUAL, sql="SELECT year, cell_row, cell_col, mm, round(mm - lag(mm) OVER (PARTITION BY cell_row, cell_col ORDER BY year), 6) AS change FROM annual")
def annual_change(t):
    w = Window.partitionBy(*climate.CELL).orderBy("year")
    return climate.annual_max(t.cell_day()).withColumn("change", F.round(F.col("mm") - F.lag("mm").over(w), 6))
