"""Event catalogue: active days grouped by gap, overlap and coherence, capped in length, rolled up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions import grid
from cellweave.operators.climate import CELL
from cellweave.operators.spatial import overlapping_days

MAX_GAP, MAX_DAYS, MAX_SPEED, MAX_RATIO = 2, 5, 150.0, 3.0


def daily_footprints(cells: DataFrame, lat: Column, lon: Column) -> DataFrame:
    """Per active day: peak and intensity-weighted centroid."""
    v = F.col("mm")
    return cells.groupBy("day").agg(F.max(v).alias("peak"), (F.sum(lat * v) / F.sum(v)).alias("lat"), (F.sum(lon * v) / F.sum(v)).alias("lon"))


def day_steps(days: DataFrame) -> DataFrame:
    """Each active day with the one before it. One row a day: the global window is small whatever the cells."""
    w = Window.orderBy("day")
    names = ("day", "peak", "lat", "lon")
    rows = days.select("*", *(F.lag(n).over(w).alias(f"prev_{n}") for n in names)).withColumn("gap", F.datediff("day", "prev_day"))
    km = grid.haversine_km(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon"))
    ratio = F.greatest("peak", "prev_peak") / F.greatest(F.least("peak", "prev_peak"), F.lit(1e-6))
    return rows.withColumn("speed", F.round(km / F.greatest("gap", F.lit(1)), 6)).withColumn("ratio", F.round(ratio, 6))


def event_days(cells: DataFrame, lat: Column, lon: Column, buffer: int) -> DataFrame:
    """(event_id, day, speed, ratio, joined): a day joins the previous active one's event if the gap, the buffered
    overlap and the coherence allow it; an event is cut greedily before it exceeds MAX_DAYS days."""
    steps = day_steps(daily_footprints(cells, lat, lon))
    near = overlapping_days(cells, steps.where(F.col("gap") <= MAX_GAP).select("day", "prev_day"), buffer).withColumn("near", F.lit(True))
    joins = (F.col("gap") <= MAX_GAP) & F.coalesce("near", F.lit(False)) & (F.col("speed") <= MAX_SPEED) & (F.col("ratio") <= MAX_RATIO)
    flagged = steps.join(near, "day", "left").withColumn("new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    grouped = flagged.withColumn("grp", F.sum("new").over(Window.orderBy("day")))
    start = lambda acc, x: F.when(F.datediff(x["day"], acc["start"]) < MAX_DAYS, acc["start"]).otherwise(x["day"])
    step = lambda acc, x: F.struct(start(acc, x).alias("start"), F.concat(acc["out"], F.array(F.struct(x["day"].alias("day"), x["speed"].alias("speed"), x["ratio"].alias("ratio"), start(acc, x).alias("start")))).alias("out"))
    days = F.sort_array(F.collect_list(F.struct("day", "speed", "ratio")))
    empty = F.array().cast("array<struct<day:date,speed:double,ratio:double,start:date>>")
    folded = grouped.groupBy("grp").agg(days.alias("d")).select(F.explode(F.aggregate("d", F.struct(F.col("d")[0]["day"].alias("start"), empty.alias("out")), step)["out"]).alias("x")).select("x.*")
    first = F.col("start") == F.col("day")
    numbered = folded.withColumn("event_id", F.sum(first.cast("int")).over(Window.orderBy("day")) - 1)
    return numbered.select("event_id", "day", F.when(~first, F.col("speed")).alias("speed"), F.when(~first, F.col("ratio")).alias("ratio"))


def event_cells(days: DataFrame, cells: DataFrame) -> DataFrame:
    """Cell-wise maxima over an event's days."""
    return cells.join(days.select("event_id", "day"), "day").groupBy("event_id", *CELL).agg(F.max("mm").alias("mm"))


def event_catalog(days: DataFrame, footprint: DataFrame, lat: Column, lon: Column, cell_km2: float) -> DataFrame:
    v = F.col("mm")
    rolled = footprint.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_active_cells"), F.max(v).alias("peak_hail_mm"), F.avg(v).alias("mean_hail_mm"), (F.sum(lat * v) / F.sum(v)).alias("centroid_lat"), (F.sum(lon * v) / F.sum(v)).alias("centroid_lon"))
    spans = days.groupBy("event_id").agg(F.min("day").alias("start_date"), F.max("day").alias("end_date"), F.coalesce(F.max("speed"), F.lit(0.0)).alias("centroid_speed_km_day"), F.coalesce(F.max("ratio"), F.lit(1.0)).alias("max_intensity_jump_ratio"))
    ok = (F.col("centroid_speed_km_day") <= MAX_SPEED) & (F.col("max_intensity_jump_ratio") <= MAX_RATIO)
    return rolled.join(spans, "event_id").select("*", (F.datediff("end_date", "start_date") + 1).alias("duration_days"), (F.col("n_active_cells") * cell_km2).alias("footprint_area_km2"), F.dayofyear("start_date").alias("doy"), F.when(ok, "ok").otherwise("review").alias("merge_quality_flag"))
