"""Queries over files: gridded files written and read by the data source, tables known by their footers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.operators import climate
from cellweave.plans.registry import query
from cellweave.sources import dimensions, footers, gridsource
from cellweave.sources.shared import folder, keep


@query(sql="SELECT CAST(ts - INTERVAL 12 HOUR AS DATE) AS day, CAST(event_id * 7 % 2600 // 5 AS INTEGER) AS cell_row, CAST(user_id * 13 % 5900 // 5 AS INTEGER) AS cell_col, round(max(value), 4) AS mm FROM events WHERE value > 0 AND value <= 300 GROUP BY ALL")
def grid_file_days(t):
    """Observations written as native gridded files, one every three hours, and read back as daily maxima of cells.

    The filter on the day is pushed down to the listing of the files.
    """
    at = F.expr("cast(to_date(ts) as timestamp_ntz) + make_dt_interval(0, hour(ts) div 3 * 3, 0, 0)")
    rows = t.read("events").select(at.alias("ts"), (F.col("event_id") * 7 % 2600).cast("int").alias("row"), (F.col("user_id") * 13 % 5900).cast("int").alias("col"), F.col("value").alias("mm"))
    spark, place = t.spark, folder(t.spark, "grid-files")
    gridsource.register(spark)
    before = {k: spark.conf.get(k, None) for k in gridsource.PUSHDOWN}
    try:
        for k, v in gridsource.PUSHDOWN.items():
            spark.conf.set(k, v)
        gridsource.write_grids(rows, place, {"units": "mm"})
        cells = spark.read.format("grid_files").load(place).where("day >= date'1990-01-01' and error is null")
        return keep(climate.cell_day_max(cells, F.col("day")).withColumn("mm", F.round("mm", 4)), "grid-days")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


#: Columns whose extremes the query asks for, by table.
ASKED = {"lineitem": ("l_shipdate", "l_orderkey"), "orders": ("o_orderdate", "o_totalprice"), "events": ("ts", "value"), "supplier": ("s_suppkey",)}


def _asked_sql() -> str:
    value = lambda c: f"year({c})" if c in ("l_shipdate", "o_orderdate", "ts") else c
    return " UNION ALL ".join(f"SELECT '{table}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_nulls, CAST(min({value(c)}) AS DOUBLE) AS low, CAST(max({value(c)}) AS DOUBLE) AS high FROM {table}" for table, columns in ASKED.items() for c in columns)


@query(sql=_asked_sql())
def footer_statistics(t):
    """Rows, nulls and extremes (of times their years) of columns of several tables, from Parquet footers; no data page is read."""
    footers.register(t.spark)
    out = None
    for table, columns in ASKED.items():
        found = footers.table_statistics(t.spark, f"{t.sf_dir}/{table}.parquet").where(F.col("column").isin(*columns))
        end = lambda c: F.coalesce(F.col(f"{c}_number"), F.substring(c, 1, 4).cast("double")).alias(c)
        rows = found.select(F.lit(table).alias("table_name"), F.col("column").alias("column_name"), "n_rows", "n_nulls", end("low"), end("high"))
        out = rows if out is None else out.unionByName(rows)
    return out


_PEOPLE = "people AS (SELECT lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 40 AS VARCHAR), 3, '0') AS geoid, 2000 + c_custkey % 7 AS year, CAST(floor(sum(greatest(c_acctbal, 0))) AS BIGINT) AS p FROM customer GROUP BY ALL)"
_PLACES = "places AS (SELECT lpad(CAST(s_nationkey + 1 AS VARCHAR), 2, '0') || lpad(CAST(s_suppkey % 40 AS VARCHAR), 3, '0') AS geoid, avg(25e0 + s_suppkey * 7 % 24) AS lat, avg(-120e0 + s_suppkey * 13 % 50) AS lon, avg(s_suppkey % 5 / 4e0) AS beta, min(s_suppkey) AS k FROM supplier GROUP BY ALL)"


@query(_PEOPLE, _PLACES, sql="SELECT p.geoid, y.year, round(lat, 6) AS lat, round(lon, 6) AS lon, round(pow(coalesce(r.p, 1) / coalesce(o.p, 1), CASE WHEN k % 3 = 0 THEN 1e0 ELSE beta END), 6) AS factor FROM places p CROSS JOIN (SELECT DISTINCT year FROM people) y LEFT JOIN (SELECT geoid, year, greatest(p, 1) * 1e0 AS p FROM people) o ON o.geoid = p.geoid AND o.year = y.year LEFT JOIN (SELECT geoid, greatest(p, 1) * 1e0 AS p FROM people WHERE year = 2003) r ON r.geoid = p.geoid")
def dimension_files(t):
    """Population factors of counties from CSV files of centroids, exponents and population, written from the tables first."""
    place = folder(t.spark, "dimensions")
    number = lambda c, n: F.lpad(c.cast("string"), n, "0")
    s = t.read("supplier").groupBy((F.col("s_nationkey") + 1).alias("state"), (F.col("s_suppkey") % 40).alias("county")).agg(F.avg(F.lit(25.0) + F.col("s_suppkey") * 7 % 24).alias("lat"), F.avg(F.lit(-120.0) + F.col("s_suppkey") * 13 % 50).alias("lon"), F.avg(F.col("s_suppkey") % 5 / 4.0).alias("beta"), F.min("s_suppkey").alias("k"))
    s = keep(s.withColumn("geoid", F.concat(number(F.col("state"), 2), number(F.col("county"), 3))), "counties")
    c = t.read("customer").groupBy(F.concat(number(F.col("c_nationkey") + 1, 2), number(F.col("c_custkey") % 40, 3)).alias("geoid"), (F.lit(2000) + F.col("c_custkey") % 7).alias("year")).agg(F.floor(F.sum(F.greatest("c_acctbal", F.lit(0.0)))).alias("trend_pop"))
    out = {"centroids": s.select(F.col("state").alias("STATEFP"), F.col("county").alias("COUNTYFP"), F.col("lat").alias("LATITUDE"), F.col("lon").alias("LONGITUDE")), "beta": s.where("k % 3 <> 0").select("geoid", F.col("beta").alias("local_beta")), "population": c}
    for name, rows in out.items():
        rows.write.option("header", True).csv(f"{place}/{name}")
    read = dimensions.read_centroids(t.spark, f"{place}/centroids"), dimensions.read_exponents(t.spark, f"{place}/beta"), dimensions.read_population(t.spark, f"{place}/population")
    return dimensions.county_factors(*read, 2003).select("geoid", "year", *(F.round(x, 6).alias(x) for x in ("lat", "lon", "factor")))
