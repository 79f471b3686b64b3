"""Ingest-side relations: window coverage, manifests, source preference, calibration, volume columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions import clock
from cellweave.functions.grid import MAX_MM
from cellweave.functions.quality import climate_isotherms, day_status, is_bad, sanitize
from cellweave.operators.ranks import quantiles


def window_coverage(times: DataFrame, group: list[str], edge_s: int = 1800, gap_s: int = 3600, least: int = 6) -> DataFrame:
    """Per group and 12 UTC day of ``ts``: times, first and last, largest gap, and if the window is covered."""
    rows = times.withColumn("day", clock.convective_day(F.col("ts"))).withColumn("s", F.unix_timestamp(F.col("ts").cast("timestamp"))).select(*group, "day", "s").distinct()
    w = Window.partitionBy(*group, "day").orderBy("s")
    rows = rows.withColumn("gap", F.col("s") - F.lag("s").over(w))
    start = F.unix_timestamp(F.col("day").cast("timestamp")) + 43200
    out = rows.groupBy(*group, "day").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("first_s"), F.max("s").alias("last_s"), F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap_s"))
    ok = (F.col("n") >= least) & (F.col("first_s") - start <= edge_s) & (start + 86400 - F.col("last_s") <= edge_s) & (F.col("max_gap_s") <= gap_s)
    return out.withColumn("covered", ok)


def manifest(obs: DataFrame) -> DataFrame:
    """A row per source and day: files (an observation is one), read errors, active cells, peak."""
    rows = obs.withColumn("day", clock.convective_day(F.col("ts"))).withColumn("bad", is_bad(F.col("mm"))).withColumn("v", sanitize(F.col("mm")))
    out = rows.groupBy("source", "day").agg(F.count(F.lit(1)).alias("source_files"), F.count_if("bad").alias("read_errors"), F.count_distinct(F.when(F.col("v") >= 29, F.col("cell_row") * 1000 + F.col("cell_col"))).alias("active_cells"), F.max("v").alias("max_mm"))
    return out.withColumn("status", day_status(F.col("source_files"), F.col("active_cells"), F.col("read_errors")))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``new`` rows over ``old`` ones of equal key; one full join, no driver state."""
    values = [c for c in old.columns if c not in key]
    joined = old.alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), key, "full")
    return joined.select(*key, *(F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in values))


def upsert_keeping_provenance(old: DataFrame, new: DataFrame, key: list[str], skipped: Column, kept: list[str]) -> DataFrame:
    """Like ``upsert``, but a ``skipped`` new row keeps the old non-empty values of the ``kept`` columns."""
    values = [c for c in old.columns if c not in key]
    flagged = new.withColumn("_new", F.lit(True)).withColumn("_skip", skipped)
    joined = old.alias("o").join(flagged.alias("n"), key, "full")

    def pick(c):
        fresh = F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        return (F.when(F.col("_skip") & F.col(f"o.{c}").isNotNull(), F.col(f"o.{c}")).otherwise(fresh) if c in kept else fresh).alias(c)

    return joined.select(*key, *map(pick, values))


def replace_window(old: DataFrame, new: DataFrame, day: str, first, last) -> DataFrame:
    """Labels outside the window kept, those inside replaced."""
    return old.where(~F.col(day).between(first, last)).unionByName(new.where(F.col(day).between(first, last))).distinct()


def prefer_sources(rows: DataFrame, group: list[str], order: dict[str, int]) -> DataFrame:
    """Of each group only the rows of its most preferred source."""
    rank = F.coalesce(*(F.when(F.col("source") == s, n) for s, n in order.items()))
    best = rows.withColumn("_rank", rank).withColumn("_best", F.min("_rank").over(Window.partitionBy(*group)))
    return best.where("_rank = _best").drop("_rank", "_best")


def without_near_times(coarse: DataFrame, fine: DataFrame, seconds: int) -> DataFrame:
    """Rows of ``coarse`` (ts) with no row of ``fine`` within ``seconds``: buckets of that width, an equi-join of three
    neighbouring ones and the exact test."""
    second = lambda: F.unix_micros(F.col("ts").cast("timestamp"))
    width = seconds * 1_000_000
    left = coarse.withColumn("_s", second()).withColumn("_b", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(F.col("_s") / width) + d)))
    right = fine.select(second().alias("_t")).select("_t", F.floor(F.col("_t") / width).alias("_b")).distinct()
    hit = left.join(right, "_b").where(F.abs(F.col("_s") - F.col("_t")) <= width).select(*coarse.columns).distinct()
    return coarse.join(hit.select("event_id"), "event_id", "left_anti")


def quantile_knots(rows: DataFrame, group: list[str], steps: int = 200) -> DataFrame:
    """(group, k, q): exact quantiles of mm at k / steps, linear interpolation; no task holds a group."""
    return quantiles(rows, group, "mm", [k / steps for k in range(steps + 1)])


def interpolate(value: Column, xs: Column, ys: Column) -> Column:
    """Piecewise linear through knots in order of x, clamped at the ends; equal x take the last one's y."""
    below = F.size(F.filter(xs, lambda x: x <= value))
    n = F.size(xs)
    i = F.least(F.greatest(below, F.lit(1)), n - 1)
    x0, x1, y0, y1 = (F.element_at(a, i + d) for a, d in ((xs, 0), (xs, 1), (ys, 0), (ys, 1)))
    inner = y0 + (y1 - y0) * (value - x0) / (x1 - x0)
    return F.when(below <= 0, F.element_at(ys, 1)).when(below >= n, F.element_at(ys, -1)).otherwise(inner)


def quantile_map(rows: DataFrame, knots: DataFrame, source: str, target: str) -> DataFrame:
    """``mapped``: source values moved to the target's distribution; 0 and below stay 0. Knots are two bounded arrays."""
    arrays = knots.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "q"))), lambda x: x["q"]).alias("qs"))
    both = arrays.where(F.col("source").isin(source, target)).agg(F.map_from_entries(F.collect_list(F.struct("source", "qs")))).scalar()  # knots are made once
    rows = rows.where(F.col("source") == source).withColumn("_k", both).withColumn("_x", F.try_element_at("_k", F.lit(source))).withColumn("_y", F.try_element_at("_k", F.lit(target))).drop("_k")
    return rows.withColumn("mapped", F.when(F.col("mm") > 0, F.least(interpolate(F.col("mm"), F.col("_x"), F.col("_y")), F.lit(MAX_MM))).otherwise(0.0)).drop("_x", "_y")


def severe_hail_index(profile: Column, h0: Column, h20: Column) -> Column:
    """0.1 * sum of w * 5e-6 * 10^(0.084 Z) * depth over levels of Z >= 40 at or above ``h0``, in height order.

    ``profile`` is an array of struct(alt_km, dbz). Depth is the absolute gradient of height in metres (1000 for a lone
    level); w grows linearly from ``h0`` to 1 at ``h20``.
    """
    p = F.array_sort(profile)
    n = F.size(p)
    alt = lambda i: F.element_at(p, i.cast("int"))["alt_km"]
    depth = lambda i: F.when(n == 1, 1000.0).otherwise(F.abs(alt(F.least(i + 2, n)) - alt(F.greatest(i, F.lit(1)))) / (F.least(i + 2, n) - F.greatest(i, F.lit(1))) * 1000.0)

    def level(x, i):
        w = F.when(x["alt_km"] >= h20, 1.0).otherwise((x["alt_km"] - h0) / (h20 - h0))
        use = (x["dbz"] >= 40) & (x["alt_km"] >= h0)
        return F.when(use, w * 5e-6 * F.pow(F.lit(10.0), x["dbz"] * 0.084) * depth(i)).otherwise(0.0)

    return F.aggregate(F.transform(p, level), F.lit(0.0), lambda a, x: a + x) * 0.1


def isotherm_height(levels: Column, kelvin: float, default: float) -> Column:
    """Height where temperature crosses ``kelvin`` between neighbouring levels (array of struct(h, t)), the last one
    in order; ``default`` without a crossing."""
    pair = F.zip_with(F.slice(levels, F.lit(1), F.size(levels) - 1), F.slice(levels, F.lit(2), F.size(levels) - 1), lambda a, b: F.struct(a["h"].alias("h0"), a["t"].alias("t0"), b["h"].alias("h1"), b["t"].alias("t1")))
    cross = F.filter(pair, lambda x: ((x["t0"] - kelvin) * (x["t1"] - kelvin) <= 0) & (x["t0"] != x["t1"]))
    at = F.transform(cross, lambda x: x["h0"] + (x["h1"] - x["h0"]) * (F.lit(kelvin) - x["t0"]) / (x["t1"] - x["t0"]))
    return F.coalesce(F.try_element_at(at, F.lit(-1)), F.lit(default))


def filter_features(cells: DataFrame, lat: Column) -> DataFrame:
    """(day, cell, v, lat, doy, s, c): what the probability filter scores; the angle is 2 pi (doy - 1) / 366."""
    angle = (F.dayofyear("day") - 1) * (2 * math.pi / 366)
    return cells.select("day", "cell_row", "cell_col", F.col("mm").alias("v"), lat.alias("lat"), F.dayofyear("day").alias("doy"), F.sin(angle).alias("s"), F.cos(angle).alias("c"))


def indexed_volume(values: DataFrame, n_lon: int, n_lat: int, n_alt: int) -> DataFrame:
    """(vol, k, j, i, dbz) of sparse values (vol, flat, v): indices outside the volume and values that are not finite are
    left out, of duplicates the largest stays. A dense volume is the same with all indices."""
    from cellweave.operators.legacy import decode_index

    at = decode_index(F.col("flat"), n_lon, n_lat)
    rows = values.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")) & (F.col("flat") >= 0)).select("vol", at.alias("x"), "v")
    return rows.where(F.col("x.k") < n_alt).groupBy("vol", F.col("x.k").alias("k"), F.col("x.j").alias("j"), F.col("x.i").alias("i")).agg(F.max("v").alias("dbz"))


def snap(value: Column, first: float, step: float) -> Column:
    """Index of the nearest of first, first + step, ...; the lower one on ties."""
    return F.ceil((value - first) / step - 0.5).cast("int")


def isotherms(points: DataFrame, cells: DataFrame, south: float, west: float, step: float) -> DataFrame:
    """``points`` (lat, lon, month, ...) with h0 and h20 of the nearest reanalysis cell (month, j, k, h0, h20), clamped
    to 0.5..7 and h0 + 1..12 km; where there is none, the climate's. Snapping makes the nearest cell an equi-join."""
    placed = points.withColumn("j", snap(F.col("lat"), south, step)).withColumn("k", snap(F.col("lon"), west, step))
    rows = placed.join(cells, ["month", "j", "k"], "left")
    h0 = F.least(F.greatest("h0", F.lit(0.5)), F.lit(7.0))
    low, high = climate_isotherms(F.col("lat"), F.col("month"))
    own = F.col("h0").isNotNull()
    h20 = F.least(F.greatest(F.col("h20"), h0 + 1.0), F.lit(12.0))
    return rows.withColumn("_h0", F.when(own, h0).otherwise(low)).withColumn("h20", F.when(own, h20).otherwise(high)).withColumn("h0", F.col("_h0")).drop("_h0", "j", "k")


def format_counts(files: DataFrame, group: str, name: str, suffix: str) -> DataFrame:
    """(group, compressed, plain): files by suffix, in any case; a compressed one is not a plain one."""
    lower = F.lower(name)
    return files.groupBy(group).agg(F.count_if(lower.endswith(suffix + ".gz")).alias("compressed"), F.count_if(lower.endswith(suffix)).alias("plain"))


def split_lines(lines: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Lines (line, ...) cut at white space into text columns; missing ones are null."""
    words = F.split(F.trim("line"), r"\s+")
    return lines.select("*", *(F.try_element_at(words, F.lit(i + 1)).alias(n) for i, n in enumerate(names)))


def rebuild_manifest(cells: DataFrame, listed: DataFrame) -> DataFrame:
    """(day, files, active, max_mm, status) from daily cells and a listing (day, files); days of either are there."""
    found = cells.groupBy("day").agg(F.count(F.lit(1)).alias("active"), F.round(F.max("mm"), 1).alias("max_mm"))
    rows = found.join(listed, "day", "full").fillna(0, ["files", "active"]).fillna(0.0, ["max_mm"])
    status = day_status(F.col("files"), F.col("active"), F.lit(0))
    return rows.select("day", "files", "active", "max_mm", status.alias("status"))
