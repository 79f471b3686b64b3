"""Relations of the hazard model bound to the supplied tables, as DataFrames and as the SQL the oracles use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.quality import sanitize

#: Coarse grid of the bound tables.
ROWS, COLS = 20, 25


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def obs(self) -> DataFrame:
        """Point-in-time grid observations of three sources."""
        source = F.when(F.col("event_type").isin("view", "click"), "A").when(F.col("event_type") == "purchase", "B").otherwise("C")
        return self.read("events").select("event_id", "ts", (F.col("user_id") % ROWS).cast("int").alias("cell_row"), (F.col("event_id") * 7 % COLS).cast("int").alias("cell_col"), F.col("value").alias("mm"), source.alias("source"), (F.col("event_id") % 7).cast("int").alias("nobs"), (F.col("event_id") % 5).cast("int").alias("necho"))

    def _days(self, row, col) -> DataFrame:
        share = F.col("l_extendedprice") / 105000.0
        raw = self.read("lineitem").where("l_linenumber = 1 and l_returnflag = 'R'").select(F.to_date("l_shipdate").alias("day"), row.cast("int").alias("cell_row"), col.cast("int").alias("cell_col"), sanitize(F.lit(310.0) * share * share).alias("mm"))
        return raw.groupBy("day", "cell_row", "cell_col").agg(F.max("mm").alias("mm")).where("mm > 0")

    def cell_day(self) -> DataFrame:
        """Daily cell maxima on the coarse grid, cells without signal left out."""
        return self._days(F.col("l_partkey") % ROWS, F.col("l_suppkey") % COLS)

    def cell_day_fine(self) -> DataFrame:
        """The same on the full grid."""
        return self._days(F.col("l_partkey") * 37 % 520, F.col("l_suppkey") * 113 % 1180)

    def report(self) -> DataFrame:
        return self.read("orders").select(F.to_date("o_orderdate").alias("day"), (F.col("o_custkey") % ROWS).cast("int").alias("cell_row"), (F.col("o_orderkey") % COLS).cast("int").alias("cell_col"), (F.col("o_totalprice") % 500 / 100.0).alias("size_in"), (F.col("o_orderkey") % 24).cast("int").alias("hour"), F.col("o_orderkey").alias("report_id"))

    def site(self) -> DataFrame:
        return self.read("supplier").select(F.col("s_suppkey").alias("site_idx"), (F.lit(25.0) + F.col("s_suppkey") * 7 % 24).alias("site_lat"), (F.lit(-120.0) + F.col("s_suppkey") * 13 % 50).alias("site_lon"))


OBS = f"""obs AS (SELECT event_id, ts, CAST(user_id % {ROWS} AS INTEGER) AS cell_row, CAST(event_id * 7 % {COLS} AS INTEGER) AS cell_col, value AS mm,
  CASE WHEN event_type IN ('view', 'click') THEN 'A' WHEN event_type = 'purchase' THEN 'B' ELSE 'C' END AS source,
  CAST(event_id % 7 AS INTEGER) AS nobs, CAST(event_id % 5 AS INTEGER) AS necho FROM events)"""


def _days_sql(name: str, row: str, col: str) -> str:
    return f"""{name} AS (SELECT day, cell_row, cell_col, max(mm) AS mm FROM (
  SELECT CAST(l_shipdate AS DATE) AS day, CAST({row} AS INTEGER) AS cell_row, CAST({col} AS INTEGER) AS cell_col,
    CASE WHEN raw > 300 THEN 0.0e0 ELSE raw END AS mm
  FROM (SELECT *, 310e0 * (l_extendedprice / 105000e0) * (l_extendedprice / 105000e0) AS raw FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R'))
  GROUP BY day, cell_row, cell_col HAVING max(mm) > 0)"""


CELL_DAY = _days_sql("cell_day", f"l_partkey % {ROWS}", f"l_suppkey % {COLS}")
CELL_DAY_FINE = _days_sql("cell_day_fine", "l_partkey * 37 % 520", "l_suppkey * 113 % 1180")
REPORT = f"""report AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(o_custkey % {ROWS} AS INTEGER) AS cell_row, CAST(o_orderkey % {COLS} AS INTEGER) AS cell_col,
  o_totalprice % 500 / 100e0 AS size_in, CAST(o_orderkey % 24 AS INTEGER) AS hour, o_orderkey AS report_id FROM orders)"""
SITE = "site AS (SELECT s_suppkey AS site_idx, 25e0 + s_suppkey * 7 % 24 AS site_lat, -120e0 + s_suppkey * 13 % 50 AS site_lon FROM supplier)"
