"""Diagnostic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions import grid, specfun
from cellweave.operators import checks, climate, extremes
from cellweave.plans import extremes as evt
from cellweave.plans.climate import ANNUAL, PEAKS, daily_peaks, r6
from cellweave.plans.events import ACTIVE, CATALOG, GROUPS, STEPS, TAILS, tails
from cellweave.plans.registry import query
from cellweave.plans.simulation import CELLS, COUNTS, DOY, SIGMA, SIM, YEARS, history, levels
from cellweave.sources.shared import keep
from cellweave.sources.tables import CELL_DAY, OBS

BASE = (CELL_DAY, ACTIVE, STEPS, GROUPS, CATALOG)
PER_YEAR = "per AS (SELECT year(start_date) AS year, count(*) AS n FROM cat GROUP BY 1)"


def per_year(t):
    return keep(history(t)[0].groupBy(F.year("start_date").alias("year")).agg(F.count(F.lit(1)).alias("n")), "per-year")


def _trend_sql(step: str) -> tuple[str, str, str]:
    return f"y AS (SELECT {step} AS i, max(mm) AS v FROM cell_day GROUP BY 1)", "s AS (SELECT coalesce(sum(sign(b.v - a.v)), 0) AS s FROM y a JOIN y b ON a.i < b.i)", "k AS (SELECT n, s, z, 2 * (1 - (" + specfun.normal_cdf("abs(z)") + ")) AS p FROM (SELECT n, CAST(s AS DOUBLE) AS s, CASE WHEN n >= 8 THEN (s - sign(s)) / sqrt(n * (n - 1) * (2 * n + 5) / 18) END AS z FROM s, (SELECT count(*) AS n FROM y)))"


_TREND = "SELECT n, s, round(z, 6) AS z, round(CASE WHEN z IS NOT NULL THEN p END, 6) AS p, CASE WHEN z IS NOT NULL AND p < 0.05 THEN 'warn' ELSE 'pass' END AS status FROM k"


@query(CELL_DAY, *_trend_sql("year(day)"), sql=_TREND)
def mann_kendall(t):
    """Trend of the annual maxima, from eight years on."""
    yearly = t.cell_day().groupBy(F.year("day").alias("i")).agg(F.max("mm").alias("v"))
    return checks.mann_kendall(yearly, "i", "v").select("n", "s", *r6("z", "p"), "status")


@query(CELL_DAY, *_trend_sql("year(day) * 12 + month(day)"), sql=_TREND)
def mann_kendall_monthly(t):
    """Trend of the monthly maxima."""
    monthly = t.cell_day().groupBy((F.year("day") * 12 + F.month("day")).alias("i")).agg(F.max("mm").alias("v"))
    return checks.mann_kendall(monthly, "i", "v").select("n", "s", *r6("z", "p"), "status")


@query(*BASE, PER_YEAR, sql="SELECT round(avg(n), 6) AS mean, round(var_samp(n), 6) AS variance, round(var_samp(n) / avg(n), 6) AS idx, CASE WHEN var_samp(n) / avg(n) > 3 THEN 'warn' ELSE 'pass' END AS status FROM per")
def dispersion(t):
    return checks.dispersion(per_year(t)).select(*r6("mean", "variance", "idx"), "status")


@query(*BASE, PER_YEAR, "mv AS (SELECT avg(n) AS m, var_samp(n) AS v, avg(n) * avg(n) / (var_samp(n) - avg(n)) AS r FROM per)", sql="SELECT round(sum(n * ln(m) - m - lgamma(n + 1)), 4) AS poisson, round(sum(lgamma(n + r) - lgamma(r) - lgamma(n + 1) + r * ln(r / (r + m)) + n * ln(1 - r / (r + m))), 4) AS negative_binomial FROM per, mv")
def nb_vs_poisson(t):
    return checks.poisson_or_negative_binomial(per_year(t)).select(*(F.round(c, 4).alias(c) for c in ("poisson", "negative_binomial")))


@query(*BASE, sql="SELECT 'domain' AS \"check\", count(*) FILTER (WHERE mm < 0 OR mm > 300) AS n_bad FROM cell_day UNION ALL SELECT 'unique_keys', count(*) FROM (SELECT 1 FROM cell_day GROUP BY day, cell_row, cell_col HAVING count(*) > 1) UNION ALL SELECT 'events_without_cells', count(*) FROM (SELECT event_id FROM cat EXCEPT SELECT event_id FROM ecells) UNION ALL SELECT 'cells_without_event', count(*) FROM (SELECT event_id FROM ecells EXCEPT SELECT event_id FROM cat) UNION ALL SELECT 'too_long', count(*) FROM cat WHERE duration_days > 5")
def output_validation(t):
    catalog, cells = history(t)
    return checks.output_checks(t.cell_day(), catalog, cells)


@query(OBS, PEAKS, sql="SELECT source, median(peak_mm) AS median_peak, round(median(peak_mm) / (SELECT median(peak_mm) FROM peaks WHERE source = 'A'), 6) AS ratio, CASE WHEN median(peak_mm) / (SELECT median(peak_mm) FROM peaks WHERE source = 'A') NOT BETWEEN 0.4 AND 2.5 THEN 'warn' ELSE 'pass' END AS status FROM peaks GROUP BY source")
def source_transition(t):
    peaks = daily_peaks(t)
    base = peaks.where("source = 'A'").agg(F.median("peak_mm")).scalar()
    out = peaks.groupBy("source").agg(F.median("peak_mm").alias("median_peak")).withColumn("r", F.col("median_peak") / base)
    return out.select("source", "median_peak", F.round("r", 6).alias("ratio"), F.when(F.col("r").between(0.4, 2.5), "pass").otherwise("warn").alias("status"))


@query(CELL_DAY, ANNUAL, evt.TAIL, sql="SELECT count(*) AS n, round(avg(CAST(xi > 0 AS INTEGER)), 6) AS heavy_share, CASE WHEN avg(CAST(xi > 0 AS INTEGER)) > 0.85 THEN 'warn' ELSE 'pass' END AS status FROM tail")
def gpd_summary(t):
    fits = extremes.regional_gpd(climate.annual_max(t.cell_day()), evt.region(), evt.U)
    share = F.avg((F.col("xi") > 0).cast("int"))
    return fits.agg(F.count(F.lit(1)).alias("n"), F.round(share, 6).alias("heavy_share"), F.when(share > 0.85, "warn").otherwise("pass").alias("status"))


RPS = (5, 10, 20)


@query(CELL_DAY, ANNUAL, evt.YEARS, evt.BODY, evt.TAIL, evt.PARAMETERS, evt.levels_sql(RPS), ACTIVE, STEPS, GROUPS, CATALOG, SIGMA, DOY, COUNTS, SIM, CELLS, "k AS (SELECT * FROM (VALUES " + ", ".join(f"({p}, {YEARS // p})" for p in RPS) + ") AS x(rp, k))", "rk AS (SELECT cell_row, cell_col, mm, row_number() OVER (PARTITION BY cell_row, cell_col ORDER BY mm DESC) AS k FROM sann)", "cmp AS (SELECT rp, l.mm / r.mm AS ratio FROM levels l JOIN k USING (rp) JOIN rk r ON r.cell_row = l.cell_row AND r.cell_col = l.cell_col AND r.k = k.k WHERE l.mm > 0 AND r.mm > 0)", sql="SELECT rp, count(*) AS n, round(median(ratio), 4) AS median_ratio, round(quantile_cont(ratio, 0.9), 4) AS p90, CASE WHEN avg(CAST(ratio > 1.5 AS INTEGER)) > 0.25 THEN 'warn' ELSE 'pass' END AS status FROM cmp GROUP BY rp", small=True)
def analytical_vs_stochastic(t):
    empirical = levels(t, periods=RPS).withColumnRenamed("mm", "sim_mm")
    rows = extremes.return_levels(evt.parameters(t), RPS).join(empirical, ["rp", *climate.CELL]).where("mm > 0 and sim_mm > 0").withColumn("ratio", F.col("mm") / F.col("sim_mm"))
    return rows.groupBy("rp").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("ratio"), 4).alias("median_ratio"), F.round(F.percentile("ratio", F.lit(0.9)), 4).alias("p90"), F.when(F.avg((F.col("ratio") > 1.5).cast("int")) > 0.25, "warn").otherwise("pass").alias("status"))


@query(CELL_DAY, evt.YEARS, sql="SELECT round(max(d), 6) AS max_days, CASE WHEN max(d) > 21 THEN 'warn' ELSE 'pass' END AS status FROM (SELECT count(*) / any_value(n_years) AS d FROM cell_day, years WHERE mm >= 29 GROUP BY cell_row, cell_col)")
def hail_day_benchmark(t):
    days = t.cell_day()
    d = days.where("mm >= 29").groupBy(*climate.CELL).agg(F.count(F.lit(1)).alias("n")).select((F.col("n") / climate.years_of(days).scalar()).alias("d"))
    return d.agg(F.round(F.max("d"), 6).alias("max_days"), F.when(F.max("d") > 21, "warn").otherwise("pass").alias("status"))


@query(*BASE, PER_YEAR, "mv AS (SELECT count(*) AS n_years, avg(n) AS m, var_pop(n) AS v FROM per)", "rr AS (SELECT *, CASE WHEN n_years >= 5 AND v > m THEN m * m / greatest(v - m, 1e-6) END AS r FROM mv)", "dl AS (SELECT sum(coalesce(lgamma(n + r) - lgamma(r) + r * ln(r / (r + m)) + n * ln(1 - r / (r + m) + 1e-12) - (n * ln(m) - m), 0)) AS d FROM per, rr WHERE n_years >= 5)", sql="SELECT n_years, round(CASE WHEN n_years >= 5 THEN m END, 6) AS mean, round(CASE WHEN n_years >= 5 THEN v END, 6) AS variance, round(CASE WHEN n_years >= 5 THEN v / m END, 6) AS idx, round(r, 4) AS r, round(d, 4) AS delta, CASE WHEN n_years < 5 THEN 'skip' WHEN v / m > 3 THEN 'warn' ELSE 'pass' END AS status FROM rr, dl")
def negative_binomial_status(t):
    out = checks.negative_binomial_check(per_year(t))
    return out.select("n_years", *r6("mean", "variance", "idx"), F.round("r", 4).alias("r"), F.round("delta", 4).alias("delta"), "status")


@query(CELL_DAY, ANNUAL, TAILS, sql="SELECT round(max(CASE WHEN km_from = 50 THEN chi END), 6) AS near, round(max(CASE WHEN km_from = 300 THEN chi END), 6) AS far, CASE WHEN max(CASE WHEN km_from = 300 THEN chi END) > max(CASE WHEN km_from = 50 THEN chi END) THEN 'warn' ELSE 'pass' END AS status FROM chis")
def tail_dependence_status(t):
    """Warn where cells 300 to 600 km apart depend more than near ones."""
    of = lambda km: F.max(F.when(F.col("km_from") == km, F.col("chi")))
    return tails(t).agg(of(50).alias("near"), of(300).alias("far")).select(*r6("near", "far"), F.when(F.col("far") > F.col("near"), "warn").otherwise("pass").alias("status"))


ERAS = (("A", 1, 10), ("C", 1, 10), ("C", 11, 20), ("B", 11, 31))


@query(OBS, PEAKS, sql=f"SELECT w, count(*) AS n_days, round(median(peak_mm), 6) AS median_mm, round(median(peak_mm) / greatest(max(first_mm), 1), 6) AS ratio, CASE WHEN median(peak_mm) / greatest(max(first_mm), 1) NOT BETWEEN 0.4 AND 2.5 THEN 'warn' ELSE 'pass' END AS status FROM (SELECT w, peak_mm FROM peaks JOIN (VALUES {', '.join(f"({i}, '{s}', {a}, {b})" for i, (s, a, b) in enumerate(ERAS))}) v(w, s, lo, hi) ON source = s AND day(day) BETWEEN lo AND hi WHERE peak_mm > 0), (SELECT median(peak_mm) AS first_mm FROM peaks WHERE source = 'A' AND day(day) BETWEEN 1 AND 10 AND peak_mm > 0) GROUP BY w")
def era_windows(t):
    """Median daily peaks of four windows of a source and days, and their ratio to the first."""
    peaks = daily_peaks(t).where("peak_mm > 0")
    inside = lambda w: (F.col("source") == w[0]) & F.dayofmonth("day").between(w[1], w[2])
    rows = peaks.withColumn("w", F.explode(F.array(*(F.when(inside(w), i) for i, w in enumerate(ERAS))))).where("w is not null")
    first = peaks.where(inside(ERAS[0])).agg(F.median("peak_mm")).scalar()
    out = rows.groupBy("w").agg(F.count(F.lit(1)).alias("n_days"), F.median("peak_mm").alias("median_mm")).withColumn("ratio", F.col("median_mm") / F.greatest(first, F.lit(1.0)))
    return out.select("w", "n_days", *r6("median_mm", "ratio"), F.when(F.col("ratio").between(0.4, 2.5), "pass").otherwise("warn").alias("status"))


DETECT_BINS = ((0.0, 0.75), (0.75, 1.0), (1.0, 1.25), (1.25, 1.5), (1.5, 2.0), (2.0, 3.0), (3.0, 99.0))


def _detect():
    from cellweave.plans.verification import PAIRS
    from cellweave.sources.tables import REPORT

    return REPORT, PAIRS


@query(CELL_DAY, *_detect(), "db AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {a}e0, {b}e0)" for i, (a, b) in enumerate(DETECT_BINS)) + ") x(bin, lo, hi))", "dd AS (SELECT bin, avg(CAST(mm > 0 AS INTEGER)) AS pod FROM db JOIN pairs ON size_in >= lo AND size_in < hi GROUP BY bin HAVING count(*) >= 20)", sql="SELECT (SELECT count(*) FROM dd) AS bins, (SELECT round(arg_min(pod, bin), 6) FROM dd) AS first_pod, (SELECT round(arg_max(pod, bin), 6) FROM dd) AS last_pod, round(avg(CAST(abs(size_in - round_even(size_in * 4, 0) / 4) < 0.02 AS INTEGER)), 6) AS quarter_share, round(avg(CASE WHEN size_in >= 1 THEN CAST(mm >= 25.4 AS INTEGER) END), 6) AS pod_severe, CASE WHEN (SELECT count(*) FROM dd) >= 2 AND (SELECT arg_max(pod, bin) < arg_min(pod, bin) FROM dd) THEN 'warn' ELSE 'pass' END AS status FROM pairs")
def detection_status(t):
    """Detection in the smallest and largest size bin of 20 pairs or more; warn where it falls with size."""
    from cellweave.operators import verification as V
    from cellweave.plans.verification import pairs

    rows = keep(pairs(t), "pairs")
    binned = rows.join(F.broadcast(V.size_bins(t.spark, DETECT_BINS)), (F.col("size_in") >= F.col("lo")) & (F.col("size_in") < F.col("hi")))  # seven rows
    pods = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("mm") > 0).cast("int")).alias("pod")).where("n >= 20")
    ends = pods.agg(F.count(F.lit(1)).alias("bins"), F.min_by("pod", "bin").alias("first_pod"), F.max_by("pod", "bin").alias("last_pod"))
    every = rows.agg(F.avg(grid.quarter_inch(F.col("size_in")).cast("int")).alias("quarter_share"), F.avg(F.when(F.col("size_in") >= 1, (F.col("mm") >= 25.4).cast("int"))).alias("pod_severe"))
    return ends.crossJoin(every).select("bins", *r6("first_pod", "last_pod", "quarter_share", "pod_severe"), F.when((F.col("bins") >= 2) & (F.col("last_pod") < F.col("first_pod")), "warn").otherwise("pass").alias("status"))


@query(OBS, sql="SELECT round(avg((p - y) * (p - y)), 6) AS brier, CASE WHEN avg((p - y) * (p - y)) > 0.25 THEN 'warn' ELSE 'pass' END AS status FROM (SELECT least(mm / 100e0, 0.999e0) AS p, CAST(nobs > 3 AS INTEGER) AS y FROM obs)")
def filter_reliability_status(t):
    """Brier score of the probability filter; warn over 0.25."""
    d = F.least(F.col("mm") / 100.0, F.lit(0.999)) - (F.col("nobs") > 3).cast("int")
    brier = F.avg(d * d)
    return t.obs().agg(F.round(brier, 6).alias("brier"), F.when(brier > 0.25, "warn").otherwise("pass").alias("status"))


@query(OBS, "mf AS (SELECT CAST(ts - INTERVAL 12 HOUR AS DATE) AS day, source, CASE WHEN count(*) < 5 THEN 'missing_source' WHEN count(*) FILTER (WHERE necho = 0) >= count(*) THEN 'error' ELSE 'ok' END AS status FROM obs GROUP BY ALL)", sql="SELECT count(*) AS n_days, round(avg(CAST(status = 'missing_source' AS INTEGER)), 6) AS missing, round(avg(CAST(status = 'error' AS INTEGER)), 6) AS failed, CASE WHEN avg(CAST(status = 'missing_source' AS INTEGER)) > 0.05 OR avg(CAST(status = 'error' AS INTEGER)) > 0.01 THEN 'warn' ELSE 'pass' END AS \"check\" FROM mf")
def upstream_qc(t):
    """Missing and failed days of a manifest."""
    from cellweave.functions.clock import convective_day

    n = F.count(F.lit(1))
    manifest = t.obs().groupBy(convective_day(F.col("ts")).alias("day"), "source").agg(F.when(n < 5, "missing_source").when(F.count_if(F.col("necho") == 0) >= n, "error").otherwise("ok").alias("status"))
    return checks.upstream_check(manifest).select("n_days", *r6("missing", "failed"), "check")


@query(CELL_DAY, sql="SELECT 'count' AS \"check\", CASE WHEN (SELECT count(*) FROM cell_day) < 100 THEN 1 ELSE 0 END AS n_bad UNION ALL SELECT 'shape', count(*) FILTER (WHERE NOT (cell_row BETWEEN 0 AND 19 AND cell_col BETWEEN 0 AND 24)) FROM cell_day UNION ALL SELECT 'domain', count(*) FILTER (WHERE mm < 0 OR mm > 300) FROM cell_day UNION ALL SELECT 'unique_keys', 0 UNION ALL SELECT 'years', count(*) FROM range(1995, 2003) y WHERE y.range NOT IN (SELECT year(day) FROM cell_day)")
def dataset_validation(t):
    """Count, shape, domain, unique keys and years 1995 to 2002 of the daily cells."""
    return checks.dataset_checks(t.cell_day(), 20, 25, 100, (1995, 2002))


@query(CELL_DAY, sql="SELECT count(*) AS n, round(avg(mm), 6) AS mean, round(stddev_samp(mm), 6) AS std, round(min(mm), 6) AS min, round(quantile_cont(mm, 0.25), 6) AS p25, round(median(mm), 6) AS p50, round(quantile_cont(mm, 0.75), 6) AS p75, round(max(mm), 6) AS max FROM cell_day")
def describe_values(t):
    q = lambda p: F.percentile("mm", F.lit(p))
    return t.cell_day().agg(F.count(F.lit(1)).alias("n"), *(F.round(x, 6).alias(c) for c, x in (("mean", F.avg("mm")), ("std", F.stddev_samp("mm")), ("min", F.min("mm")), ("p25", q(0.25)), ("p50", q(0.5)), ("p75", q(0.75)), ("max", F.max("mm")))))


@query(*BASE, "firsts AS (SELECT min(year(start_date)) AS a, max(year(start_date)) AS b FROM cat)", sql="SELECT y.y AS year, count(event_id) AS n, round(avg(peak_hail_mm), 6) AS mean_peak, count(*) FILTER (WHERE duration_days > 1) AS multi_day FROM (SELECT unnest(range(a, b + 1)) AS y FROM firsts) y LEFT JOIN cat ON year(start_date) = y.y GROUP BY 1")
def annual_events(t):
    """Events a year, years without any included."""
    catalog = history(t)[0].withColumn("year", F.year("start_date"))
    ends = catalog.agg(F.min("year").alias("a"), F.max("year").alias("b"))
    years = ends.select(F.explode(F.sequence("a", "b")).alias("year"))
    rows = years.join(catalog.drop("doy"), "year", "left")
    return rows.groupBy("year").agg(F.count("event_id").alias("n"), F.round(F.avg("peak_hail_mm"), 6).alias("mean_peak"), F.count_if(F.col("duration_days") > 1).alias("multi_day"))
