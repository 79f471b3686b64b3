"""Structured Streaming forms of the daily reduction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.quality import sanitize


def daily_max_stream(obs: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Tumbling 12 UTC to 12 UTC cell maxima of a stream of (ts, cell_row, cell_col, mm), final after ``lateness``."""
    rows = obs.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("mm", sanitize(F.col("mm"))).withWatermark("ts", lateness)
    windows = rows.groupBy(F.window("ts", "1 day", "1 day", "12 hours").alias("w"), "cell_row", "cell_col").agg(F.max("mm").alias("mm"))
    return windows.select(F.to_date("w.start").alias("day"), "cell_row", "cell_col", "mm")


def upsert_batches(stream: DataFrame, folder: str, out: str):
    """A query that writes the keys each micro-batch changed, with their maxima so far, under ``out``.

    A batch writes its own folder, so a repeated batch writes the same rows again, and none rewrites another's. State is
    bounded by the watermark: later rows of closed windows are dropped, see ``reprocess``.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", folder).foreachBatch(put)


def read_upserts(spark: SparkSession, out: str, key: list[str]) -> DataFrame:
    """The table that the batches make: maxima never fall, so the largest of a key is its newest."""
    return spark.read.parquet(f"{out}/batch=*").groupBy(*key).agg(F.max("mm").alias("mm"))


def reprocess(spark: SparkSession, table: str, raw: DataFrame, days: list, target: str) -> None:
    """Daily maxima of ``table`` (day, cell, mm) with those of ``days`` computed anew from all raw rows, late ones too,
    as a new table at ``target``."""
    from cellweave.functions.clock import convective_day

    again = F.col("day").isin(days)
    clean = raw.withColumn("day", convective_day(F.col("ts"))).where(again).withColumn("mm", sanitize(F.col("mm")))
    new = clean.groupBy("day", "cell_row", "cell_col").agg(F.max("mm").alias("mm"))
    spark.read.parquet(table).where(~again).select("day", "cell_row", "cell_col", "mm").unionByName(new).write.parquet(target)


def trailing_frames(frames: DataFrame, state: DataFrame | None, most: int = 21) -> DataFrame:
    """The last ``most`` frames (day, cell, mm) of a stored state and new days, to be stored as the next state.

    A frame of a day that the state has is replaced, so a resumed run that repeats days ends in the same state; without a
    state it is recomputed from ``frames``.
    """
    from pyspark.sql import Window

    every = frames if state is None else state.join(frames.select("day").distinct(), "day", "left_anti").unionByName(frames)
    days = every.select("day").distinct().withColumn("_n", F.row_number().over(Window.orderBy(F.desc("day"))))
    return every.join(days.where(F.col("_n") <= most).select("day"), "day", "left_semi")
