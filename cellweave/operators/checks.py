"""Diagnostic statistics; each makes one row with a status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mann_kendall(series: DataFrame, order: str, value: str, least: int = 8) -> DataFrame:
    """n, S, its normal score z without tie correction and the two-sided p, of one value a step of ``order``; z and p are
    null under ``least`` steps, and the status a pass."""
    from cellweave.functions import specfun

    rows = series.select(F.col(order).alias("i"), F.col(value).alias("v"))
    later = rows.select(F.col("i").alias("j"), F.col("v").alias("w"))
    s = rows.join(later, F.col("i") < F.col("j")).agg(F.coalesce(F.sum(F.signum(F.col("w") - F.col("v"))), F.lit(0.0)).alias("s"))
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    both = n.withColumn("s", s.scalar())
    var = F.col("n") * (F.col("n") - 1) * (F.col("n") * 2 + 5) / 18
    z = F.when(F.col("n") >= least, (F.col("s") - F.signum("s")) / F.sqrt(var))
    out = both.withColumn("z", z).withColumn("_a", F.abs("z"))
    out = out.withColumn("p", F.when(F.col("z").isNotNull(), (F.lit(1.0) - F.expr(specfun.normal_cdf("_a"))) * 2)).drop("_a")
    return out.withColumn("status", F.when(F.col("p") < 0.05, "warn").otherwise("pass"))


def dispersion(counts: DataFrame, value: str = "n") -> DataFrame:
    out = counts.agg(F.avg(value).alias("mean"), F.var_samp(value).alias("variance"))
    return out.withColumn("idx", F.col("variance") / F.col("mean")).withColumn("status", F.when(F.col("idx") > 3, "warn").otherwise("pass"))


def poisson_or_negative_binomial(counts: DataFrame, value: str = "n") -> DataFrame:
    """Log-likelihoods by the method of moments; log-factorials as sums of logs over a table of the counts' range."""
    spark = counts.sparkSession
    top = counts.agg(F.max(value)).scalar()
    logs = spark.range(1).select(F.explode(F.sequence(F.lit(0).cast("long"), top.cast("long"))).alias("k"))
    logs = logs.select("k", F.sum(F.ln(F.greatest("k", F.lit(1)))).over(Window.orderBy("k")).alias("lf"))
    m = counts.agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    rows = counts.select(F.col(value).cast("long").alias("k")).join(logs, "k").withColumn("m", m.select("m").scalar()).withColumn("v", m.select("v").scalar())
    r = F.col("m") * F.col("m") / (F.col("v") - F.col("m"))
    p = r / (r + F.col("m"))
    # lgamma(k + r) - lgamma(r) = sum of ln(r + i) for i < k
    rise = F.aggregate(F.transform(F.sequence(F.lit(0).cast("long"), F.col("k")), lambda i: F.when(i < F.col("k"), F.ln(r + i)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    poisson = F.col("k") * F.ln("m") - F.col("m") - F.col("lf")
    negative = rise - F.col("lf") + r * F.ln(p) + F.col("k") * F.ln(F.lit(1.0) - p)
    return rows.agg(F.sum(poisson).alias("poisson"), F.sum(F.when(F.col("v") > F.col("m"), negative)).alias("negative_binomial"))


def output_checks(cell_day: DataFrame, catalog: DataFrame, cells: DataFrame, most_days: int = 5) -> DataFrame:
    """(check, n_bad): domain, key uniqueness, event-id set equality both ways, length cap."""
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit(name).alias("check"), "n_bad")
    ids, known = catalog.select("event_id"), cells.select("event_id").distinct()
    parts = [
        one("domain", cell_day.where("mm < 0 or mm > 300 or isnan(mm)")),
        one("unique_keys", cell_day.groupBy("day", "cell_row", "cell_col").count().where("count > 1")),
        one("events_without_cells", ids.exceptAll(known)),
        one("cells_without_event", known.exceptAll(ids)),
        one("too_long", catalog.where(F.col("duration_days") > most_days)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def negative_binomial_check(counts: DataFrame, value: str = "n") -> DataFrame:
    """n_years, mean, population variance, dispersion index, the negative binomial's r, how much its log-likelihood is
    above Poisson's, and warn for an index over 3. Without overdispersion r is null and the difference 0; under five
    years everything but n_years is null and the status skip."""
    rows = counts.select(F.col(value).cast("long").alias("k"))
    m = rows.agg(F.count(F.lit(1)).alias("n_years"), F.avg("k").alias("mean"), F.var_pop("k").alias("variance"))
    every = rows.crossJoin(m).where("n_years >= 5").withColumn("r", F.when(F.col("variance") > F.col("mean"), F.col("mean") * F.col("mean") / F.greatest(F.col("variance") - F.col("mean"), F.lit(1e-6))))
    r, k, mean = F.col("r"), F.col("k"), F.col("mean")
    p = r / (r + mean)
    # lgamma(k + r) - lgamma(r) = sum of ln(r + i) for i < k; the log-factorials cancel in the difference
    rise = F.aggregate(F.transform(F.sequence(F.lit(0).cast("long"), k), lambda i: F.when(i < k, F.ln(r + i)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    delta = rise + r * F.ln(p) + k * F.ln(F.lit(1.0) - p + 1e-12) - (k * F.ln(mean) - mean)
    both = every.withColumn("_d", F.coalesce(delta, F.lit(0.0))).agg(F.max("r").alias("r"), F.sum("_d").alias("delta"))
    index = F.col("variance") / F.col("mean")
    some = F.col("n_years") >= 5
    return m.crossJoin(both).select("n_years", F.when(some, F.col("mean")).alias("mean"), F.when(some, F.col("variance")).alias("variance"), F.when(some, index).alias("idx"), "r", "delta", F.when(~some, "skip").when(index > 3, "warn").otherwise("pass").alias("status"))


def upstream_check(manifest: DataFrame) -> DataFrame:
    """n_days, shares of missing and failed days of a manifest (status), and warn over 5 % missing or 1 % failed."""
    n = F.count(F.lit(1))
    missing, failed = (F.count_if(F.col("status") == s) / F.greatest(n, F.lit(1)) for s in ("missing_source", "error"))
    return manifest.agg(n.alias("n_days"), missing.alias("missing"), failed.alias("failed")).withColumn("check", F.when(F.col("n_days") == 0, "skip").when((F.col("missing") > 0.05) | (F.col("failed") > 0.01), "warn").otherwise("pass"))


def dataset_checks(cells: DataFrame, rows: int, cols: int, least_rows: int, years: tuple[int, int]) -> DataFrame:
    """(check, n_bad) of a cell-day table: row count, shape, domain, unique keys, and years of the span without a row."""
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit(name).alias("check"), "n_bad")
    span = cells.sparkSession.range(years[0], years[1] + 1).select(F.col("id").cast("int").alias("year"))
    total = cells.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least_rows)
    parts = [one("count", total), one("shape", cells.where(~(F.col("cell_row").between(0, rows - 1) & F.col("cell_col").between(0, cols - 1)))), one("domain", cells.where("mm is null or isnan(mm) or mm < 0 or mm > 300")), one("unique_keys", cells.groupBy("day", "cell_row", "cell_col").count().where("count > 1")), one("years", span.join(cells.select(F.year("day").alias("year")).distinct(), "year", "left_anti"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
