"""Neighbourhood joins on the grid: buffered overlap, kernel pooling, window medians."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions import grid
from cellweave.operators.climate import CELL

def _around(rows: DataFrame, steps: Column, *columns: str) -> DataFrame:
    """Each row once for every combination of steps added to the columns."""
    for c in columns:
        rows = rows.withColumn("_step", F.explode(steps)).withColumn(c, F.col(c) + F.col("_step")).drop("_step")
    return rows


def overlapping_days(cells: DataFrame, steps: DataFrame, buffer: int) -> DataFrame:
    """The days of ``steps`` (day, prev_day) of which a cell lies within ``buffer`` rows and columns of one of prev_day.

    Both sides are tiled by the buffer, so a cell meets only the nine tiles around it, and a semi-join stops at the first
    near one.
    """
    tile = lambda c: F.floor(F.col(c) / buffer).cast("int")
    near = F.array(*map(F.lit, (-1, 0, 1)))
    now = cells.join(steps, "day").select("day", "prev_day", F.col("cell_row").alias("r1"), F.col("cell_col").alias("c1"), tile("cell_row").alias("tr"), tile("cell_col").alias("tc"))
    now = _around(now, near, "tr", "tc")
    before = cells.select(F.col("day").alias("prev_day"), F.col("cell_row").alias("r2"), F.col("cell_col").alias("c2"), tile("cell_row").alias("tr"), tile("cell_col").alias("tc"))
    same = (now["prev_day"] == before["prev_day"]) & (now["tr"] == before["tr"]) & (now["tc"] == before["tc"])
    near_cell = (F.abs(F.col("r1") - F.col("r2")) <= buffer) & (F.abs(F.col("c1") - F.col("c2")) <= buffer)
    return now.join(before, same & near_cell, "left_semi").select("day").distinct()


#: Least side of a tile.
SIDE = 64


def window_median(targets: DataFrame, cells: DataFrame, half: int, rows: int, cols: int) -> DataFrame:
    """Adds the median over the (2 half + 1)^2 window around each target, absent cells 0, edges replicated."""
    return targets.join(_tiled_medians(targets, cells, half, rows, cols), ["day", *CELL])


def _tiled_medians(targets: DataFrame, cells: DataFrame, half: int, rows: int, cols: int) -> DataFrame:
    """Windows are cut from a dense tile with a rim of ``half`` cells: a cell moves once for each of the tiles, four at most,
    that it can be in a window of, and a group is a tile of one day."""
    side = max(SIDE, 2 * half)
    spread = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-half, half) for c in (-half, half)))
    tile = lambda c: F.floor(c / side).cast("int")
    near = cells.select("day", *CELL, F.col("mm").cast("double").alias("mm"), F.lit(False).alias("asked"), F.explode(spread).alias("d"))
    near = near.select("day", tile(F.col("cell_row") + F.col("d.r")).alias("_tr"), tile(F.col("cell_col") + F.col("d.c")).alias("_tc"), *CELL, "mm", "asked").distinct()
    every = near.unionByName(targets.select("day", tile(F.col("cell_row")).alias("_tr"), tile(F.col("cell_col")).alias("_tc"), *CELL, F.lit(0.0).alias("mm"), F.lit(True).alias("asked")))

    def cut(part: pd.DataFrame) -> pd.DataFrame:
        asked = part[part["asked"]]
        held = part[~part["asked"]]
        row0, col0 = int(part["_tr"].iloc[0]) * side - half, int(part["_tc"].iloc[0]) * side - half
        dense = np.zeros((side + 2 * half, side + 2 * half))
        dense[held["cell_row"].to_numpy() - row0, held["cell_col"].to_numpy() - col0] = held["mm"].to_numpy()
        step, r, c = np.arange(-half, half + 1), asked["cell_row"].to_numpy()[:, None], asked["cell_col"].to_numpy()[:, None]
        r, c = np.clip(r + step, 0, rows - 1) - row0, np.clip(c + step, 0, cols - 1) - col0
        medians = [np.median(dense[r[a : a + 4096, :, None], c[a : a + 4096, None, :]].reshape(min(4096, len(r) - a), -1), axis=1) for a in range(0, len(r), 4096)]
        return asked[["day", *CELL]].assign(med=np.concatenate([np.zeros(0), *medians]))

    return every.groupBy("day", "_tr", "_tc").applyInPandas(cut, "day date, cell_row int, cell_col int, med double")


def pooled(stats: DataFrame, radius_km: float, decay_km: float, half: int, lat: Column, lon: Column, sums: list[str], plain: tuple[str, ...] = ()) -> DataFrame:
    """Kernel-weighted sums of additive statistics over the cells within ``radius_km`` and ``half`` rows and columns.

    Weights are exp(-km / decay_km); those of ``plain`` are summed without weight. Statistics are summed before they are pooled, so a pair of cells moves one row;
    tiles of side ``half`` bound the partners of a cell.
    """
    tile = lambda c: F.floor(F.col(c) / half).cast("int")
    near = F.array(*map(F.lit, (-1, 0, 1)))
    placed = stats.withColumn("_lat", lat).withColumn("_lon", lon).withColumn("_tr", tile("cell_row")).withColumn("_tc", tile("cell_col"))
    target = placed.select(*CELL, F.col("_lat").alias("lat0"), F.col("_lon").alias("lon0"), "_tr", "_tc")
    target = _around(target, near, "_tr", "_tc")
    source = placed.select(F.col("cell_row").alias("r2"), F.col("cell_col").alias("c2"), "_lat", "_lon", "_tr", "_tc", *sums, *plain)
    pairs = target.join(source, ["_tr", "_tc"]).where((F.abs(F.col("cell_row") - F.col("r2")) <= half) & (F.abs(F.col("cell_col") - F.col("c2")) <= half))
    pairs = pairs.withColumn("km", F.round(grid.haversine_km(F.col("lat0"), F.col("lon0"), F.col("_lat"), F.col("_lon")), 6)).where(F.col("km") <= radius_km)
    w = F.exp(-F.col("km") / decay_km)
    return pairs.groupBy(*CELL).agg(F.count(F.lit(1)).alias("partners"), F.sum(w).alias("weight"), *(F.sum(w * F.col(s)).alias(s) for s in sums), *(F.sum(s).alias(s) for s in plain))


def joint_exceedance(cells: DataFrame, bands: tuple[tuple[int, int], ...], north: float = 50.0) -> DataFrame:
    """(km_from, pairs, chi) of cells (cell, lat, lon, hit): per distance band the share of pairs that both hit, over the
    square of the share of cells that hit.

    Tiles as wide as the farthest band, at the latitude ``north`` where a degree is shortest, make it an equi-join: a
    cell meets the nine tiles around it.
    """
    far = max(b for _, b in bands)
    high = far / 111.0
    wide = high / float(np.cos(np.radians(north)))
    near = F.array(*map(F.lit, (-1, 0, 1)))
    tiled = cells.withColumn("_tr", F.floor(F.col("lat") / high).cast("int")).withColumn("_tc", F.floor(F.col("lon") / wide).cast("int"))
    one = _around(tiled, near, "_tr", "_tc")
    two = tiled.select(F.col("cell_row").alias("r2"), F.col("cell_col").alias("c2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("hit").alias("hit2"), "_tr", "_tc")
    first = (F.col("cell_row") < F.col("r2")) | ((F.col("cell_row") == F.col("r2")) & (F.col("cell_col") < F.col("c2")))
    pairs = one.join(two, ["_tr", "_tc"]).where(first).withColumn("km", F.round(grid.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 6))
    band = F.coalesce(*(F.when((F.col("km") >= a) & (F.col("km") < b), a) for a, b in bands))
    share = cells.agg(F.avg(F.col("hit").cast("int"))).scalar()
    out = pairs.groupBy(band.alias("km_from")).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("hit") & F.col("hit2")).alias("joint")).where("km_from is not null")
    return out.select("km_from", "pairs", (F.col("joint") / F.col("pairs") / F.greatest(share * share, F.lit(1e-9))).alias("chi"))
