"""Files by day: listings, convective-day unions, download plans, source choice, decompression."""

from __future__ import annotations

import datetime as dt
import gzip

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.clock import convective_day, name_time


def list_files(spark: SparkSession, root: str, days: list[dt.date], layout: str = "%Y/%m/%d", suffixes: tuple[str, ...] = (".netcdf", ".netcdf.gz")) -> DataFrame:
    """(path, size, listed_day) of the files of calendar days, by their folders, suffixes in any case.

    Only the folders of ``days`` are listed, and no content is read. Missing folders have no files.
    """
    jvm = spark._jvm.org.apache.hadoop.fs
    store = jvm.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    folders = {f"/{day.strftime(layout)}": day for day in days if store.exists(jvm.Path(f"{root}/{day.strftime(layout)}"))}
    if not folders:
        return spark.createDataFrame([], "path string, size long, listed_day date")
    files = spark.read.format("binaryFile").load([root + f for f in folders])  # one scan, whatever the number of days
    depth = layout.count("/") + 1
    folder = F.concat(F.lit("/"), F.array_join(F.slice(F.split("path", "/"), F.lit(-depth - 1), F.lit(depth)), "/"))
    listed = F.create_map(*(F.lit(x) for pair in folders.items() for x in pair))[folder]
    out = files.select("path", F.col("length").alias("size"), listed.alias("listed_day"))
    lower = F.lower("path")
    keep = F.lit(False)
    for s in suffixes:
        keep = keep | lower.endswith(s)
    return out.where(keep)


def convective_files(spark: SparkSession, root: str, day: dt.date, **how) -> DataFrame:
    """Files whose name's time is in the day from 12 UTC: the listings of two calendar days, a path once, by time."""
    both = list_files(spark, root, [day, day + dt.timedelta(1)], **how)
    timed = both.withColumn("ts", name_time(F.col("path"))).where(convective_day(F.col("ts")) == F.lit(day))
    return timed.dropDuplicates(["path"]).select("path", "size", "ts").orderBy("ts", "path")


def staged_files(spark: SparkSession, root: str, first: dt.date, last: dt.date) -> DataFrame:
    """(path, size, by_convective_day) of staged files, from folders by_convective_day=YYYY-MM-DD; only those of the span
    are read."""
    rows = spark.read.format("binaryFile").option("basePath", root).load(root).select("path", F.col("length").alias("size"), F.to_date("by_convective_day").alias("by_convective_day"))
    return rows.where(F.col("by_convective_day").between(F.lit(first), F.lit(last)))


def day_path(root: str, day: Column, suffix: str) -> Column:
    """The path of a day's output: root/YYYY/prefix_YYYYMMDD."""
    return F.concat(F.lit(f"{root}/"), F.date_format(day, "yyyy"), F.lit("/"), F.lit("mesh_"), F.date_format(day, "yyyyMMdd"), F.lit(suffix))


def days_between(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))


def download_plan(days: DataFrame, url: str, out: str) -> DataFrame:
    """(day, hour, url, out_path) of the 24 hourly files from 12 UTC of each convective day, an out_path once.

    ``url`` and ``out`` have {date} and {hour}. Retrieval itself is outside the engine.
    """
    hours = days.select("day", F.explode(F.sequence(F.lit(12), F.lit(35))).alias("h")).withColumn("hour", (F.col("h") % 24).cast("int")).withColumn("_d", F.date_add("day", F.floor(F.col("h") / 24).cast("int")))

    def fill(text):
        filled = F.replace(F.lit(text), F.lit("{date}"), F.date_format("_d", "yyyyMMdd"))
        return F.replace(filled, F.lit("{hour}"), F.lpad(F.col("hour").cast("string"), 2, "0"))

    rows = hours.select("day", "hour", fill(url).alias("url"), fill(out).alias("out_path"))
    return rows.groupBy("out_path").agg(F.min(F.struct("day", "hour", "url")).alias("x")).select("x.day", "x.hour", "x.url", "out_path")


def choose_source(coverage: DataFrame, days: DataFrame) -> DataFrame:
    """(day, choice) from the fine source's (day, covered): fine where it covers the window, fine and gap-fill where it has
    something, else coarse."""
    rows = days.select("day").distinct().join(coverage.groupBy("day").agg(F.bool_or("covered").alias("covered")), "day", "left")
    return rows.select("day", F.when(F.col("covered"), "fine").when(F.col("covered").isNotNull(), "fine+gap_fill").otherwise("coarse").alias("choice"))


def decoded(files: DataFrame) -> DataFrame:
    """(path, content) of binary files, those named .gz decompressed; a file at a time in a task. A broken one is null."""

    def run(batches):
        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out.append(gzip.decompress(content) if path.lower().endswith(".gz") else content)
                except (OSError, EOFError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["path", "content"])

    return files.select("path", "content").mapInArrow(run, "path string, content binary")
