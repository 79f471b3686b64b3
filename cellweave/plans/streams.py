"""Queries that run a stream to its end and read what it left."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellweave.operators import climate
from cellweave.plans.fine import BASE, kept_rings, patch, persistence_sql
from cellweave.plans.climate import r6
from cellweave.plans.registry import query
from cellweave.sources.shared import folder, keep
from cellweave.streaming import persistence

#: Deliveries that the frames come in; the stream is stopped and started again between them.
DELIVERIES = 3


@query(*BASE, persistence_sql("patch", "out", "patch"), sql="SELECT day, cell_row, cell_col, round(mm, 6) AS mm FROM out WHERE day < (SELECT max(day) FROM patch)")
def stream_persistence(t):
    """The persistence pass over frames that arrive in deliveries, by a stream that starts anew from its checkpoint for each.

    The last day stays in the state: it is final when the next one comes.
    """
    cells = keep(patch(t), "frames")
    number = F.row_number().over(Window.orderBy("day"))  # a row a day
    frames = cells.join(cells.select("day").distinct().withColumn("frame", number), "day").select("day", "frame", *climate.CELL, "mm", F.col("mm").alias("v"))
    frames, annuli, place = keep(frames, "numbered"), kept_rings(t), folder(t.spark, "stream-persistence")
    most = frames.agg(F.max("frame")).first()[0] or 0
    parts = "spark.sql.shuffle.partitions"
    keys = max(1, annuli.select("site_idx", "bin").distinct().count())  # an annulus's state is in one partition; more than annuli stay empty
    settings = {**persistence.ROCKSDB, parts: min(keys, int(t.spark.conf.get(parts)))}
    before = {k: t.spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            t.spark.conf.set(k, v)
        for i in range(DELIVERIES):
            frames.where((F.col("frame") > most * i // DELIVERIES) & (F.col("frame") <= most * (i + 1) // DELIVERIES)).write.mode("append").parquet(f"{place}/in")
            stream = persistence.persistence_stream(t.spark.readStream.schema(frames.schema).parquet(f"{place}/in"), annuli)
            stream.writeStream.option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{place}/out").awaitTermination()
    finally:
        for k, v in before.items():
            t.spark.conf.set(k, v) if v is not None else t.spark.conf.unset(k)
    return t.spark.read.schema(persistence.OUT).parquet(f"{place}/out").select("day", *climate.CELL, *r6("mm"))
