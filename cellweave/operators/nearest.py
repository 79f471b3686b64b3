"""The nearest site of every place, by a tree of cubes over the unit sphere, joined level by level.

Sites are points of the sphere in nested cubes; a cube of few sites is a leaf. Places are tiled by cubes as well. Going down, each tile
keeps the site cubes that can hold a nearest site of any place in it: whose least distance to the tile is no more than the
largest distance to the cube that is surely nearest. Every step is an equi-join of a tile with its parts and of a cube with its
parts, so a far cluster costs a tile few cubes however many sites are in it; neither sites nor places pass the driver or
meet in one task. Distances are great circles, and chords of the sphere bound them, so poles and date line need no care.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions import grid

#: Sites of a leaf at most, levels of halving a step for sites and for places, and the finest levels.
LEAF, STEP, TILE_STEP, DEEPEST, TILE_DEEPEST = 16, 3, 4, 21, 12
#: Up to so many positions of sites, 100 KB, every place is compared with all of them in the task instead.
FEW = 4096
#: Chords that differ by less are ties: 2e-6 km, and rounding.
SLACK = 2e-6 / grid.EARTH_KM + 1e-12


def on_sphere(lat: Column, lon: Column) -> list[Column]:
    phi, lam = F.radians(lat), F.radians(lon)
    return [(F.cos(phi) * F.cos(lam)).alias("x"), (F.cos(phi) * F.sin(lam)).alias("y"), F.sin(phi).alias("z")]


def cube(level: int) -> Column:
    """The number of the level's cube that holds (x, y, z): 21 bits an axis."""
    at = lambda c: F.least(F.floor((F.col(c) + 1) * (2.0**level / 2)), F.lit(2**level - 1))
    return (F.shiftleft(at("x"), 42) + F.shiftleft(at("y"), 21) + at("z")).cast("long")


def _axes(number: Column) -> list[Column]:
    return [F.shiftright(number, s).bitwiseAND((1 << 21) - 1) for s in (42, 21, 0)]


def bounds(tile: Column, tile_level: int, node: Column, node_level: Column) -> tuple[Column, Column]:
    """Least and largest squared chord between a point of a tile and one of a cube."""
    side, node_side = F.lit(2.0 / 2**tile_level), F.lit(2.0) / F.pow(F.lit(2.0), node_level)
    half = (side + node_side) / 2
    near = far = F.lit(0.0)
    for a, b in zip(_axes(tile), _axes(node), strict=True):
        apart = F.abs((a + 0.5) * side - (b + 0.5) * node_side)
        near = near + F.pow(F.greatest(apart - half, F.lit(0.0)), F.lit(2.0))
        far = far + F.pow(apart + half, F.lit(2.0))
    return near, far


def nearest_site(cells: DataFrame, sites: DataFrame, lat: Column, lon: Column, keep) -> DataFrame:
    """Adds site_idx and km of the nearest of ``sites`` (site_idx, site_lat, site_lon), the least index on ties (distances rounded to 1e-6 km).

    Places are compared once each; cells without a place, and all where there is no site, have nulls. Sites of one position
    count as the least index. ``keep(df, name)`` writes what several steps read.
    """
    some = sites.where("site_idx is not null and site_lat is not null and site_lon is not null")
    held = some.groupBy(F.col("site_lat").cast("double").alias("site_lat"), F.col("site_lon").cast("double").alias("site_lon")).agg(F.min("site_idx").alias("site_idx"))
    few = held.limit(FEW + 1).select("site_idx", "site_lat", "site_lon").orderBy("site_idx").collect()  # bounded by the limit
    if len(few) <= FEW:
        return cells.withColumn("_near", _of_few(few, lat.cast("double"), lon.cast("double"))).select(*cells.columns, F.col("_near.site_idx").alias("site_idx"), F.col("_near.km").alias("km"))
    places = keep(cells.select(lat.cast("double").alias("lat"), lon.cast("double").alias("lon")).where("lat is not null and lon is not null").distinct(), "places")
    held = keep(held.select("*", *on_sphere(F.col("site_lat"), F.col("site_lon"))), "site-places")
    found = _compared(places, held, keep)
    named = cells.withColumn("_lat", lat.cast("double")).withColumn("_lon", lon.cast("double"))
    best = found.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("best.site_idx").alias("site_idx"), F.col("best.km").alias("km"))
    return named.join(best, ["_lat", "_lon"], "left").select(*cells.columns, "site_idx", "km")


def _of_few(sites: list, lat: Column, lon: Column) -> Column:
    """struct(km, site_idx) of the nearest of a few sites, in numpy blocks; null without a place or a site."""
    index = np.array([r[0] for r in sites], np.int64)
    phi2, lam2 = (np.radians(np.array([r[i] for r in sites], float)) for i in (1, 2))

    @F.pandas_udf("struct<km: double, site_idx: long>")
    def near(lat: pd.Series, lon: pd.Series) -> pd.DataFrame:
        km, best = np.full(len(lat), np.nan), np.zeros(len(lat), np.int64)
        some = np.flatnonzero((lat.notna() & lon.notna()).to_numpy()) if len(index) else np.zeros(0, int)
        for a in range(0, len(some), 256):
            at = some[a : a + 256]
            phi1, lam1 = (np.radians(x.to_numpy(float)[at, None]) for x in (lat, lon))
            h = np.sin((phi2 - phi1) / 2) ** 2 + np.cos(phi1) * np.cos(phi2) * np.sin((lam2 - lam1) / 2) ** 2
            d = np.round(2 * grid.EARTH_KM * np.arcsin(np.sqrt(np.clip(h, 0, 1))), 6)
            first = d.argmin(1)
            km[at], best[at] = d[np.arange(len(at)), first], index[first]
        return pd.DataFrame({"km": pd.Series(km).astype("Float64").where(~np.isnan(km)), "site_idx": pd.Series(best).astype("Int64").where(~np.isnan(km))})

    return near(lat, lon)


def _compared(places: DataFrame, sites: DataFrame, keep) -> DataFrame:
    """(lat, lon, best) of the places, best of least (km, site_idx)."""
    km = lambda lat, lon: F.round(grid.haversine_km(F.col("lat"), F.col("lon"), lat, lon), 6)
    levels = list(range(0, DEEPEST + 1, STEP))
    crowd = sites.select(F.posexplode(F.array(*(cube(n) for n in levels))).alias("step", "node")).groupBy("step", "node").agg(F.count(F.lit(1)).alias("n"))
    crowd = keep(crowd, "site-cubes")
    most = {r.step: r.most for r in crowd.groupBy("step").agg(F.max("n").alias("most")).collect()}  # a row a level
    if most.get(0, 0) <= LEAF:
        least = F.min(F.struct(km(F.col("site_lat"), F.col("site_lon")).alias("km"), "site_idx")).alias("best")
        return places.join(F.broadcast(sites)).groupBy("lat", "lon").agg(least)  # at most LEAF sites
    depth = next((k for k in range(len(levels)) if most[k] <= LEAF), len(levels) - 1)
    last = F.lit(depth)
    nodes = crowd.where(F.col("step") <= depth).withColumn("leaf", (F.col("n") <= LEAF) | (F.col("step") == last)).drop("n")
    tile_levels = [min(TILE_STEP * k, TILE_DEEPEST) for k in range(depth + 1)]
    tiled = keep(places.select("lat", "lon", *on_sphere(F.col("lat"), F.col("lon"))).select("lat", "lon", *(cube(n).alias(f"t{k}") for k, n in enumerate(tile_levels))), "tiles")
    pairs = places.sparkSession.range(1).select(F.lit(0).cast("long").alias("tile"), F.lit(0).alias("step"), F.lit(0).cast("long").alias("node"), F.lit(False).alias("leaf"))
    for k in range(1, depth + 1):
        tiles = tiled.select(F.col(f"t{k - 1}").alias("tile"), F.col(f"t{k}").alias("part")).distinct()
        parts = nodes.where(F.col("step") == k).select(_parent("node", STEP).alias("node"), F.col("node").alias("inner"), F.col("leaf").alias("inner_leaf"))
        opened = pairs.where(~F.col("leaf")).join(parts, "node").select("tile", F.lit(k).alias("step"), F.col("inner").alias("node"), F.col("inner_leaf").alias("leaf"))
        pairs = opened.unionByName(pairs.where("leaf")).join(tiles, "tile").select(F.col("part").alias("tile"), "step", "node", "leaf")
        near, far = bounds(F.col("tile"), tile_levels[k], F.col("node"), F.col("step") * STEP)
        sure = F.min(far).over(Window.partitionBy("tile"))
        pairs = pairs.withColumn("_near", near).withColumn("_sure", sure).where(F.sqrt("_near") <= F.sqrt("_sure") + SLACK).drop("_near", "_sure")
        pairs = keep(pairs, "tile-cubes")
    own = sites.select("*", F.posexplode(F.array(*(cube(n) for n in levels[: depth + 1]))).alias("step", "node")).join(nodes.where("leaf"), ["step", "node"])
    first = Window.partitionBy("site_lat", "site_lon").orderBy("step")
    leaves = own.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("step", "node", "site_idx", "site_lat", "site_lon")
    asked = pairs.join(leaves, ["step", "node"]).groupBy("tile").agg(F.collect_list(F.struct("site_idx", "site_lat", "site_lon")).alias("near"))
    # a place stays one row, so that no task sorts places by candidates, and the tiles are dealt over all tasks however small
    spread = tiled.select("lat", "lon", F.col(f"t{depth}").alias("tile")).repartition(int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tile")
    best = F.array_min(F.transform("near", lambda x: F.struct(km(x["site_lat"], x["site_lon"]).alias("km"), x["site_idx"].alias("site_idx"))))
    return spread.join(asked, "tile").select("lat", "lon", best.alias("best"))


def _parent(node: str, levels: int) -> Column:
    x, y, z = (F.shiftright(a, levels) for a in _axes(F.col(node)))
    return (F.shiftleft(x, 42) + F.shiftleft(y, 21) + z).cast("long")
