"""Outputs: cell-days by year, repaired copies, sparse events, run manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.quality import is_bad, sanitize


def write_cell_days(cells: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet by year, so a span of years reads only its folders; the commit protocol makes a write all or nothing."""
    cells.withColumn("year", F.year("day")).write.mode(mode).partitionBy("year").parquet(path)


def read_cell_days(spark: SparkSession, path: str, first=None, last=None) -> DataFrame:
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.where((F.col("year") >= first.year) & (F.col("day") >= F.lit(first)))
    if last is not None:
        rows = rows.where((F.col("year") <= last.year) & (F.col("day") <= F.lit(last)))
    return rows.drop("year")


def repair_cell_days(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Sanitise a stored table into a new one; returns (year, n, n_bad) of what was found."""
    rows = spark.read.parquet(source)
    write_cell_days(rows.drop("year").withColumn("mm", sanitize(F.col("mm"))).where("mm > 0"), target)
    return rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_bad(F.col("mm"))).alias("n_bad"))


def every_nth_day(cells: DataFrame, step: int) -> DataFrame:
    """Systematic sample: the days 1, 1 + step, ... in order. The window holds a row per day."""
    from pyspark.sql import Window

    days = cells.select("day").distinct().withColumn("_i", F.row_number().over(Window.orderBy("day")))
    return cells.join(days.where((F.col("_i") - 1) % step == 0).select("day"), "day", "left_semi")


def run_manifest(spark: SparkSession, metrics: dict) -> DataFrame:
    """One row: metrics as a map and as JSON."""
    pairs = F.create_map(*(F.lit(str(x)) for kv in sorted(metrics.items()) for x in kv))
    return spark.range(1).select(pairs.alias("metrics")).withColumn("json", F.to_json("metrics"))


def write_tagged(cells: DataFrame, path: str, tags: dict) -> None:
    """A new table of daily cells with its tags beside it; both appear complete or not at all."""
    write_cell_days(cells, f"{path}/cells")
    run_manifest(cells.sparkSession, tags).select("metrics", "json").write.parquet(f"{path}/tags")


def read_tags(spark: SparkSession, path: str) -> dict:
    """Tags of a tagged table; a table without tags has none."""
    row = spark.read.parquet(f"{path}/tags").select(F.from_json("json", "map<string,string>").alias("m")).first()
    return dict(row["m"]) if row else {}


def peaks(cells: DataFrame, tags: DataFrame) -> DataFrame:
    """(day, peak_mm): the day's stored peak where its tags (day, max_mm) have one, else the cells' maximum."""
    found = cells.groupBy("day").agg(F.max("mm").alias("_max"))
    rows = found.join(tags.select("day", "max_mm"), "day", "full")
    return rows.select("day", F.coalesce("max_mm", "_max", F.lit(0.0)).alias("peak_mm"))


def largest(spark: SparkSession, path: str, column: str):
    """Largest value of one column, the only one read; where Spark may, from row-group statistics alone."""
    return spark.read.parquet(path).agg(F.max(column)).first()[0]


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A manifest by date, the newest row of each; empty where there is none."""
    return _newest(_manifest(spark, path, schema)).drop("version").orderBy("date")


def _manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows that were ever written, with their version; a manifest that isn't there is made, empty."""
    full = f"{schema}, version long"
    spark.createDataFrame([], full).write.mode("ignore").option("header", True).csv(path)
    return spark.read.schema(full).option("header", True).csv(path)


def _newest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("date").agg(F.max_by(F.struct(*rows.columns), F.struct("version", *(c for c in rows.columns if c not in ("version", "date")))).alias("r")).select("r.*")


def upsert_manifest(spark: SparkSession, path: str, rows: DataFrame) -> int:
    """Merge rows by ``date`` into a stored manifest, the new ones winning, as the next version, whose number is returned.

    Rows are appended and a date's newest version is read, so a write that fails leaves nothing, and of two writers none
    loses the other's dates; a date that both write in one version has the larger row.
    """
    schema = rows.schema.simpleString()[7:-1].replace(":", " ")
    version = (_manifest(spark, path, schema).agg(F.max("version")).first()[0] or 0) + 1
    one = _newest(rows.withColumn("version", F.lit(version).cast("long")))
    one.select(*rows.columns, "version").coalesce(1).write.mode("append").option("header", True).csv(path)  # a row a day
    return version


def append_events(events: DataFrame, path: str, first_year: int, last_year: int, most_rows: int = 100_000) -> None:
    """Add simulated events of a span of years to a table, in files of at most ``most_rows``. A span is a partition that is
    overwritten, so a repeated run writes the same table."""
    rows = events.where(F.col("sim_year").between(first_year, last_year)).withColumn("span", F.lit(f"{first_year:07d}-{last_year:07d}"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", most_rows).partitionBy("span").parquet(path)


def write_sorted(rows: DataFrame, path: str, *order: str) -> None:
    """Files in global order of the columns."""
    rows.orderBy(*order).write.parquet(path)


def write_single(rows: DataFrame, path: str, form: str = "csv") -> None:
    """One CSV file with a header, or one JSON-lines file, of a small table such as a summary."""
    writer = rows.coalesce(1).write
    (writer.option("header", True).csv if form == "csv" else writer.json)(path)


def write_event_table(catalog: DataFrame, cells: DataFrame, path: str) -> None:
    """Events and their cells as two tables, the cells in event order within files."""
    catalog.write.parquet(f"{path}/events")
    cells.repartition("event_id").sortWithinPartitions("event_id", "cell_row", "cell_col").write.parquet(f"{path}/event_cells")


def read_event_table(spark: SparkSession, path: str) -> DataFrame:
    """Each event's row with its cells as an array, in event order of the catalogue."""
    cells = spark.read.parquet(f"{path}/event_cells").groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("cell_row", "cell_col", "mm"))).alias("cells"))
    return spark.read.parquet(f"{path}/events").join(cells, "event_id", "left")


def write_sites(sites: DataFrame, path: str) -> None:
    sites.select("site_id", "lat", "lon").orderBy("site_id").coalesce(1).write.option("header", True).csv(path)


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """(site_idx, site_id, site_lat, site_lon): indices from 0 in order of the id."""
    from pyspark.sql import Window

    rows = spark.read.schema("site_id string, lat double, lon double").option("header", True).csv(path)
    return rows.select((F.row_number().over(Window.orderBy("site_id")) - 1).alias("site_idx"), "site_id", F.col("lat").alias("site_lat"), F.col("lon").alias("site_lon"))
