"""Report files: CSV with a preamble, found by its header line, in Latin-1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _field(cells: Column, header: Column, *names: str) -> Column:
    """The cell under the first of ``names`` that the header has."""
    at = F.coalesce(*(F.nullif(F.array_position(header, n), F.lit(0)) for n in names))
    return F.trim(F.try_element_at(cells, at.cast("int")))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, lat, lon, size_in, hour) of every usable line under the header that names lat and lon.

    Sizes are hundredths of an inch; the hour is the first two characters of the time, 12 where absent. Lines with a
    bad number, outside 20..55 N and 130..60 W, or without size are left out, and so are files without a header.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.decode("content", "ISO-8859-1").alias("text"))
    lines = F.transform(F.split("text", "\r?\n"), lambda x: F.lower(F.trim(x)))
    is_header = lambda x: x.contains("lat") & x.contains("lon")
    rows = files.withColumn("lines", lines).withColumn("at", F.array_position(F.transform("lines", is_header), True)).where("at > 0")
    rows = rows.withColumn("header", F.transform(F.split(F.element_at("lines", F.col("at").cast("int")), ","), lambda x: F.trim(x)))
    rows = rows.select("file", "header", "at", F.posexplode("lines").alias("line", "raw")).where("line >= at and raw <> ''").withColumn("cells", F.split("raw", ","))
    number = lambda *names: _field(F.col("cells"), F.col("header"), *names).try_cast("double")
    hour = F.substring(_field(F.col("cells"), F.col("header"), "time"), 1, 2).try_cast("int")
    out = rows.select("file", "line", number("lat", "latitude").alias("lat"), number("lon", "longitude").alias("lon"), (number("size", "mag") / 100.0).alias("size_in"), F.coalesce(hour, F.lit(12)).alias("hour"))
    return out.where(F.col("lat").between(20, 55) & F.col("lon").between(-130, -60) & (F.col("size_in") > 0))
