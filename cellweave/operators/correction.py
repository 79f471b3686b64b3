"""The daily correction chain and the features and weights of the artefact model."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.quality import environment_filter, recalibrate, sanitize
from cellweave.operators.artefacts import ACTIVE_MM, KEY
from cellweave.operators.climate import CELL
from cellweave.operators.daypasses import all_passes
from cellweave.operators.ingest import quantile_knots, quantile_map
from cellweave.operators.spatial import window_median

#: Labels of the corrected sources.
GRIDDED, OTHER = "GridRad", "MYRORSS/MRMS"


def with_source(rows: DataFrame, label_days: DataFrame) -> DataFrame:
    """Adds ``source``: ``GRIDDED`` on the days of ``label_days`` (day), ``OTHER`` on all others."""
    known = label_days.select("day").distinct().withColumn("_known", F.lit(True))
    return rows.join(known, "day", "left").withColumn("source", F.when(F.col("_known"), GRIDDED).otherwise(OTHER)).drop("_known")


def calibrated(rows: DataFrame, keep) -> DataFrame:
    """Rows (day, cell, source, mm) with mm recalibrated, or for ``GRIDDED`` moved to the other source's distribution."""
    knots = keep(quantile_knots(rows.where("mm > 0"), ["source"]), "knots")
    mapped = quantile_map(rows, knots, GRIDDED, OTHER).withColumn("mm", F.col("mapped")).drop("mapped")
    return mapped.select(*rows.columns).unionByName(rows.where(F.col("source") == OTHER).withColumn("mm", recalibrate(F.col("mm"))))


def corrected(raw: DataFrame, label_days: DataFrame, annuli: DataFrame, rows: int, cols: int, lat: Column, keep) -> tuple[DataFrame, DataFrame]:
    """(corrected cells, one row per day of what the chain did) of daily cells (day, cell, mm).

    Source by label set, calibration, for ``GRIDDED`` days the artefact passes with the frames before them as history,
    the environment filter, and the quality cap. ``annuli`` has bin, coarse, sector and whether the site is flagged. The
    passes take three shuffles, by day, by annulus and by day; ``keep(df, name)`` writes what several steps read.
    """
    before = keep(calibrated(with_source(raw, label_days), keep), "calibrated")
    frames = before.where(F.col("source") == GRIDDED).select(*KEY, "mm")
    now = keep(all_passes(frames, annuli, rows, cols).select(*KEY, "mm", F.col("v").alias("frame")), "passed")
    after = before.where(F.col("source") == OTHER).select(*KEY, "mm").unionByName(now.select(*KEY, "mm"))
    done = keep(after.withColumn("mm", sanitize(environment_filter(F.col("mm"), lat, F.dayofyear("day")))), "corrected")
    joined = with_source(raw, label_days).withColumnRenamed("mm", "raw").join(done, KEY).join(now.select(*KEY, F.col("mm").alias("passed"), "frame"), KEY, "left")
    n_in, n_out = F.count_if(F.col("raw") > 0), F.count_if(F.col("mm") > 0)
    stats = joined.groupBy("day", "source").agg(
        n_in.alias("in_pixels"),
        n_out.alias("out_pixels"),
        F.round(F.max("raw"), 1).alias("peak_in_mm"),
        F.round(F.max("mm"), 1).alias("peak_out_mm"),
        F.round((F.lit(1.0) - n_out / F.greatest(n_in, F.lit(1))) * 100, 1).alias("filtered_pct"),
        F.count_if((F.col("frame") > 0) & (F.col("passed") == 0)).alias("artefacts_removed"),
    )
    return done.where("mm > 0"), stats


def spherical_azimuth(site_lat: Column, site_lon: Column, lat: Column, lon: Column) -> Column:
    """The azimuth that the features use: its sine term has the site's cosine, its cosine term the cell's as first point."""
    d, a, b = F.radians(lon - site_lon), F.radians(lat), F.radians(site_lat)
    x, y = F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(x, y)) + 360.0, F.lit(360.0))


#: The ten features in their order.
FEATURES = ("v", "log_v", "ratio", "range_km", "sin_az", "cos_az", "sin_day", "cos_day", "is_gridded", "is_latest")


def artefact_features(cells: DataFrame, annuli: DataFrame, rows: int, cols: int, latest: Column) -> DataFrame:
    """(day, cell, *FEATURES) of the active cells of daily cells (day, cell, mm, source).

    ``annuli`` has km, lat, lon, site_lat and site_lon of each cell; ``latest`` says if a row is of the latest source.
    The ratio is to the median of the 3 x 3 window, 1 where that is 0.
    """
    active = cells.where(F.col("mm") >= ACTIVE_MM)
    med = window_median(active.select(*KEY, "mm", "source"), cells, 1, rows, cols)
    placed = med.join(annuli.select(*CELL, "km", "lat", "lon", "site_lat", "site_lon"), CELL)
    az = F.radians(spherical_azimuth(F.col("site_lat"), F.col("site_lon"), F.col("lat"), F.col("lon")))
    angle = (F.dayofyear("day") - 1) * (2 * math.pi / 366)
    v = F.col("mm")
    values = (v, F.log1p(v), F.when(F.col("med") > 0, v / F.col("med")).otherwise(1.0), F.col("km"), F.sin(az), F.cos(az), F.sin(angle), F.cos(angle), (F.col("source") == GRIDDED).cast("double"), latest.cast("double"))
    return placed.select(*KEY, *(x.alias(n) for x, n in zip(values, FEATURES, strict=True)))


def weighted(cells: DataFrame, probabilities: DataFrame) -> DataFrame:
    """``cells`` with the mm of active ones times their probability (day, cell, p); others as they were."""
    rows = cells.join(probabilities.select(*KEY, "p"), KEY, "left")
    return rows.withColumn("mm", F.when((F.col("mm") >= ACTIVE_MM) & F.col("p").isNotNull(), F.col("mm") * F.col("p")).otherwise(F.col("mm"))).drop("p")
