"""The small files that county statistics need: centroids, local exponents, population by year, report counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, path: str, **columns: str) -> DataFrame:
    """CSV columns by name, in any case and order, as text; a byte-order mark belongs to no name. A missing one is an error."""
    rows = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    names = {c.lstrip("﻿").strip().lower(): c for c in rows.columns}
    if missing := [c for c in columns.values() if c.lower() not in names]:
        raise ValueError(f"{path} has no {', '.join(missing)}")
    return rows.select(*(F.trim(F.col(f"`{names[c.lower()]}`")).alias(k) for k, c in columns.items()))


def _number(name: str, kind: str = "double") -> Column:
    return F.col(name).try_cast(kind)


def read_centroids(spark: SparkSession, path: str) -> DataFrame:
    """(geoid, lat, lon) of counties: state and county numbers filled with zeros to two and three digits."""
    rows = _read(spark, path, state="STATEFP", county="COUNTYFP", lat="LATITUDE", lon="LONGITUDE")
    geoid = F.concat(F.lpad("state", 2, "0"), F.lpad("county", 3, "0"))
    return rows.select(geoid.alias("geoid"), _number("lat").alias("lat"), _number("lon").alias("lon")).dropna()


def read_exponents(spark: SparkSession, path: str) -> DataFrame:
    """(geoid, beta): the exponents that were fitted; counties without a row count as 1 where they are used."""
    return _read(spark, path, geoid="geoid", beta="local_beta").select("geoid", _number("beta").alias("beta")).dropna()


def read_population(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(geoid, year, population), at least 1, of the years from ``first`` to ``last``."""
    rows = _read(spark, path, geoid="geoid", year="year", p="trend_pop").select("geoid", _number("year", "int").alias("year"), F.greatest(_number("p").cast("long"), F.lit(1)).alias("population")).dropna()
    rows = rows if first is None else rows.where(F.col("year") >= first)
    return rows if last is None else rows.where(F.col("year") <= last)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(geoid, year, total, county_name, state_name) of reports; a county's names are those of its least year."""
    rows = _read(spark, path, geoid="geoid", year="year", total="total", county_name="county_name", state_name="state_name").select("geoid", _number("year", "int").alias("year"), _number("total", "long").alias("total"), "county_name", "state_name").dropna(subset=["geoid", "year", "total"])
    names = rows.groupBy("geoid").agg(F.min_by(F.struct("county_name", "state_name"), F.struct("year", "county_name", "state_name")).alias("n"))
    return rows.select("geoid", "year", "total").join(names, "geoid").select("geoid", "year", "total", "n.county_name", "n.state_name")


def county_factors(centroids: DataFrame, exponents: DataFrame, population: DataFrame, reference: int) -> DataFrame:
    """(geoid, year, lat, lon, factor): (reference population / population) ^ beta of every county with a centroid and each year that
    any has; a county without beta has exponent 1, one without a population counts as 1 person."""
    years = population.select("year").distinct()
    own = population.select("geoid", "year", "population")
    then = own.where(F.col("year") == reference).select("geoid", F.col("population").alias("_ref"))
    rows = centroids.join(F.broadcast(years)).join(own, ["geoid", "year"], "left").join(then, "geoid", "left").join(exponents, "geoid", "left")  # a row a year
    one = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(1.0))
    return rows.select("geoid", "year", "lat", "lon", F.pow(one("_ref") / one("population"), one("beta")).alias("factor"))
