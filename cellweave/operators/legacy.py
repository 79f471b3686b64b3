"""Coarser and older variants: counties, block sums, decay fits, volume indices, masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.climate import CELL
from cellweave.operators.verification import correlation


def month_climatology(rows: DataFrame, chunk: str, month: str, value: str, needed: tuple[int, ...] = ()) -> DataFrame:
    """Per month the mean over chunks of each chunk's mean, so a long chunk doesn't outweigh a short one.

    ``needed`` months that no chunk has are an error when the result is computed.
    """
    if needed:
        has = rows.select(F.collect_set(F.col(month).cast("int")).alias("has"))
        missing = F.array_except(F.array(*map(F.lit, needed)), "has")
        checked = has.select(F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("missing months: "), F.array_join(missing.cast("array<string>"), ", ")))).cast("int").alias("_fault"))
        rows = rows.crossJoin(checked).where("_fault is null").drop("_fault")
    return rows.groupBy(chunk, month).agg(F.avg(value).alias("_chunk_mean")).groupBy(month).agg(F.avg("_chunk_mean").alias("mean"), F.count(F.lit(1)).alias("n_chunks"))


def decode_index(flat: Column, n_lon: int, n_lat: int) -> Column:
    """struct(i, j, k) of a flat volume index, longitude fastest."""
    return F.struct((flat % n_lon).alias("i"), (F.floor(flat / n_lon) % n_lat).alias("j"), F.floor(flat / (n_lon * n_lat)).alias("k"))


def clean_county(name: Column) -> Column:
    """Upper case, without a trailing kind of county, punctuation as single spaces, SAINT as ST."""
    up = F.regexp_replace(F.upper(F.trim(name)), r"[^A-Z0-9]+", " ")
    up = F.regexp_replace(up, r"\b(COUNTY|PARISH|BOROUGH|CITY)$", "")
    return F.trim(F.regexp_replace(up, r"^SAINT ", "ST "))


def with_neighbours(values: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Rows of each key and of its neighbours (edges (a, b)), keyed by the former."""
    own = values.select("*", F.col(key).alias("center"))
    near = values.join(edges.withColumnRenamed("b", key), key).withColumnRenamed("a", "center")
    return own.unionByName(near)


def block_sum(cells: DataFrame, block: int, most: int = 65535) -> DataFrame:
    rows = cells.withColumn("cell_row", F.floor(F.col("cell_row") / block).cast("int")).withColumn("cell_col", F.floor(F.col("cell_col") / block).cast("int"))
    return rows.groupBy("band", *CELL).agg(F.least(F.sum("n"), F.lit(most)).alias("n"))


def masked(levels: DataFrame, flags: DataFrame) -> DataFrame:
    """Levels times the cell's factor inside the mask, 0 outside; a new table, so a rerun doesn't compound it."""
    rows = levels.join(flags, CELL, "left")
    return rows.withColumn("mm", F.when(F.coalesce("inside", F.lit(False)), F.least(F.col("mm") * F.coalesce("factor", F.lit(1.0)), F.lit(300.0))).otherwise(0.0)).drop("inside", "factor")


def near_manhattan(cells: DataFrame, steps: DataFrame, reach: int) -> DataFrame:
    """Days of ``steps`` with a cell within ``reach`` 4-neighbour steps of one of prev_day (a diamond, not a square)."""
    moves = [(r, c) for r in range(-reach, reach + 1) for c in range(-reach, reach + 1) if abs(r) + abs(c) <= reach]
    spread = cells.withColumn("m", F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in moves))))
    before = spread.select(F.col("day").alias("prev_day"), (F.col("cell_row") + F.col("m.r")).alias("cell_row"), (F.col("cell_col") + F.col("m.c")).alias("cell_col")).distinct()
    return cells.join(steps, "day").join(before, ["prev_day", *CELL], "left_semi").select("day").distinct()


def spearman(rows: DataFrame, group: list[str], x: str, y: str, least: int = 5) -> DataFrame:
    """Rank correlation of each group, average ranks on ties."""
    def ranked(c):
        w = Window.partitionBy(*group)
        low = F.rank().over(w.orderBy(c))
        ties = F.count(F.lit(1)).over(Window.partitionBy(*group, c))
        return low + (ties - 1) / 2

    out = rows.withColumn("_x", ranked(x)).withColumn("_y", ranked(y)).groupBy(*group).agg(F.count(F.lit(1)).alias("n"), correlation("_x", "_y").alias("rho"))
    return out.where(F.col("n") >= least)


def fit_gpd(over: DataFrame, group: str, size: int = 400, rounds: int = 6) -> DataFrame:
    """Maximum-likelihood shape and scale of excesses ``x`` by a profile over theta = xi / scale, location 0.

    Each round sums ln(1 + theta * x) over all rows for a grid of thetas a group, partition by partition, then narrows the
    grid around the likeliest; no row moves. The driver holds ``size`` numbers a group, of which there are few (regions).
    """
    import numpy as np
    import pandas as pd

    kind = over.schema[group].dataType.simpleString()
    rows = over.where(F.col(group).isNotNull() & (F.col("x") > 0)).select(F.col(group).cast("string").alias("g"), F.col("x").cast("double").alias("x"))
    stats = {r.g: r for r in rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("top"), F.avg("x").alias("mean")).collect()}
    half = size // 2
    grids = {g: np.concatenate([-np.geomspace(0.999 / r.top, 1e-4 / r.mean, half), np.geomspace(1e-4 / r.mean, 20 / r.mean, half)]) for g, r in stats.items()}
    best: dict = {}
    for _ in range(rounds):
        now = dict(grids)

        def sums(batches, now=now):
            total: dict = {}
            for batch in batches:
                for g, x in batch.groupby("g")["x"]:
                    for part in np.array_split(x.to_numpy(float), max(1, len(x) // 4096)):
                        total[g] = total.get(g, 0) + np.log1p(np.outer(now[g], part)).sum(1)
            for g, s in total.items():
                yield pd.DataFrame({"g": g, "i": np.arange(len(s)), "s": s})

        found = rows.mapInPandas(sums, "g string, i long, s double").groupBy("g", "i").agg(F.sum("s").alias("s")).collect() if stats else []
        for g, r in stats.items():
            grid, z = grids[g], np.full(len(grids[g]), np.nan)
            for f in (f for f in found if f.g == g):
                z[f.i] = f.s / r.n
            flat = np.abs(grid) < 1e-12
            safe = np.where(flat, 1.0, grid)
            cost = np.where(flat, np.log(r.mean) + 1, np.log(np.where(flat, 1.0, z / safe)) + z + 1)
            at = int(np.nanargmin(cost))
            best[g] = (float(grid[at]), float(z[at]))
            grids[g] = np.linspace(grid[max(at - 1, 0)], grid[min(at + 1, len(grid) - 1)], 60)
    out = []
    for g, (theta, xi) in best.items():
        out.append((g, stats[g].n, xi, xi / theta if abs(theta) > 1e-12 else float(stats[g].mean)))
    fitted = over.sparkSession.createDataFrame(out, "g string, n long, xi double, scale double")
    return fitted.select(F.col("g").cast(kind).alias(group), "n", "xi", "scale")
