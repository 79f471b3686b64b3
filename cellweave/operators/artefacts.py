"""Sensor artefacts: passes over one day's cells that set some to 0, each on the last one's output.

Cells are sparse: a cell without a row is 0. ``annuli`` gives every grid cell its site, range bin and, for spokes,
azimuth bin; it is one small table, joined by broadcast up to Spark's own threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.climate import CELL
from cellweave.operators.spatial import window_median

ACTIVE_MM = 5.0
KEY = ["day", *CELL]


def zeroed(cells: DataFrame, hit: Column) -> DataFrame:
    """``cells`` with mm set to 0 where ``hit``; other columns as they were."""
    return cells.withColumn("mm", F.when(F.coalesce(hit, F.lit(False)), 0.0).otherwise(F.col("mm")))


def removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: cells that a pass set to 0."""
    rows = before.select(*KEY, F.col("mm").alias("was")).join(after.select(*KEY, "mm"), KEY)
    return rows.agg(F.count_if((F.col("was") > 0) & (F.col("mm") == 0)).alias("n_removed"))


def speckle(cells: DataFrame, rows: int, cols: int, factor: float = 2.5) -> DataFrame:
    """Active cells over ``factor`` times the median of their 3 x 3 window (at least 1 mm) go."""
    active = cells.where(F.col("mm") >= ACTIVE_MM)
    hit = window_median(active, cells, 1, rows, cols).where(F.col("mm") > F.greatest("med", F.lit(1.0)) * factor).select(*KEY, F.lit(True).alias("_hit"))
    return zeroed(cells.join(hit, KEY, "left"), F.col("_hit")).drop("_hit")


def filament(cells: DataFrame, rows: int, cols: int, half: int = 10, background: float = 15.0, margin: float = 20.0) -> DataFrame:
    """Cells well above a low window median go; only cells over the margin need their window."""
    high = cells.where(F.col("mm") > margin)
    hit = window_median(high, cells, half, rows, cols).where((F.col("med") < background) & (F.col("mm") > F.col("med") + margin)).select(*KEY, F.lit(True).alias("_hit"))
    return zeroed(cells.join(hit, KEY, "left"), F.col("_hit")).drop("_hit")


def annulus_medians(cells: DataFrame, annuli: DataFrame, by: list[str], least: int) -> DataFrame:
    """Median over the active cells of each day's annulus that has at least ``least``."""
    active = cells.where(F.col("mm") >= ACTIVE_MM).join(annuli, CELL)
    return active.groupBy("day", *by).agg(F.median("mm").alias("med"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("n")


def above_median(cells: DataFrame, annuli: DataFrame, by: list[str], least: int, factor: float) -> DataFrame:
    """Active cells over ``factor`` times their annulus's median (at least 1 mm) go: azimuthal and spoke passes.

    An annulus with under ``least`` active cells is left alone."""
    medians = annulus_medians(cells, annuli, by, least)
    rows = cells.join(annuli, CELL, "left").join(medians, ["day", *by], "left")
    return zeroed(rows, F.col("med").isNotNull() & (F.col("mm") >= ACTIVE_MM) & (F.col("mm") > F.greatest("med", F.lit(1.0)) * factor)).select(*cells.columns)


def radial_rings(cells: DataFrame, annuli: DataFrame, width: float = 10.0, least: int = 5, ring: float = 1.12, far_ring: float = 1.18, far_km: float = 100.0, inner_km: float = 75.0, outer_km: float = 50.0, margin: float = 5.0) -> DataFrame:
    """Annuli whose median stands out of the two bins on either side and of the inner range lose their high cells."""
    medians = annulus_medians(cells, annuli, ["site_idx", "bin"], least)
    here = ["day", "site_idx"]
    other = medians.select(*here, F.col("bin").alias("b2"), F.col("med").alias("m2"))
    near = medians.join(other, here).where(F.abs(F.col("bin") - F.col("b2")).between(1, 2)).groupBy(*here, "bin").agg(F.median("m2").alias("nbr"))
    center = (F.col("bin") + 0.5) * width
    inner = medians.where(center <= inner_km).groupBy(*here).agg(F.median("med").alias("inner_ref"))
    rows = medians.join(near, [*here, "bin"], "left").join(inner, here, "left").where("nbr is not null or inner_ref is not null")
    ref = F.greatest(F.coalesce("nbr", F.lit(0.0)), F.lit(1.0))
    ref = F.when((center >= outer_km) & F.col("inner_ref").isNotNull(), F.greatest(ref, F.col("inner_ref"))).otherwise(ref)
    rows = rows.withColumn("ref", ref).where(F.col("med") > F.col("ref") * F.when(center > far_km, far_ring).otherwise(ring))
    limit = F.col("ref") + F.greatest(F.lit(margin), (F.col("med") - F.col("ref")) * 0.5)
    hits = rows.select(*here, "bin", limit.alias("limit"))
    placed = cells.join(annuli, CELL, "left").join(hits, [*here, "bin"], "left")
    return zeroed(placed, (F.col("mm") >= ACTIVE_MM) & (F.col("mm") > F.col("limit"))).select(*cells.columns)


#: Fixed value: from here on a cell counts as active for the persistence pass.
PERSISTENT_MM = 25.4
#: Frames of a group of the persistence pass; those of the history before it come with it.
SPAN = 256


def padded_median(values: np.ndarray, total: int) -> float:
    """Median of ``total`` numbers that are 0 but for ``values``, which are not negative."""
    zeros = total - len(values)
    low, high = (total - 1) // 2 - zeros, total // 2 - zeros
    if high < 0:
        return 0.0
    part = np.partition(values, [max(low, 0), high])
    return ((part[low] if low >= 0 else 0.0) + part[high]) / 2


def chronic(number: np.ndarray, cell: np.ndarray, mm: np.ndarray, v: np.ndarray, first: int, n_cells: int, frames: int, least_frames: int, range_frac: float, cell_frac: float, burst: float, storm: float, active: float) -> np.ndarray:
    """Rows of an annulus that go: (frame number, cell, mm to be filtered, v as history shows it), NaN where a row has none.

    The last ``frames`` frames are a ring of columns, a row a cell: a frame that enters overwrites the one that leaves. Frames
    before ``first`` are history only.
    """
    order = np.argsort(number, kind="stable")
    cells, at = np.unique(cell, return_inverse=True)
    held, last, gone = np.zeros((len(cells), frames)), None, []
    heads = np.flatnonzero(np.concatenate([[True], number[order][1:] != number[order][:-1]]))
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(order)], strict=True):
        rows = order[a:b]
        f = int(number[rows[0]])
        if last is not None:
            held[:, [k % frames for k in range(max(last + 1, f - frames), f)]] = 0
        last, n = f, min(frames, f - 1)
        high = rows[mm[rows] >= active]  # NaN is not
        if f >= first and n >= least_frames and len(high) and (held >= active).any(0).sum() >= range_frac * n:
            today = padded_median(mm[rows][mm[rows] > 0], n_cells)
            usual = padded_median(held[held > 0], n * n_cells)
            if not (today >= storm * max(usual, 1.0) and today >= active):
                own = np.sort(held[at[high]], axis=1)[:, frames - n :]
                med = (own[:, (n - 1) // 2] + own[:, n // 2]) / 2
                gone.append(high[((own >= active).sum(1) >= cell_frac * n) & (mm[high] < burst * np.maximum(med, 1.0))])
        held[:, f % frames] = 0
        seen = rows[v[rows] > 0]
        held[at[seen], f % frames] = v[seen]
    return np.concatenate([np.zeros(0, int), *gone])


def persistent(rows: DataFrame, days: DataFrame, annuli: DataFrame, step: int = 0, frames: int = 21, least_frames: int = 7, least_cells: int = 5, range_frac: float = 0.6, cell_frac: float = 0.35, burst: float = 1.75, storm: float = 1.5, active: float = PERSISTENT_MM) -> DataFrame:
    """Rows (day, cell, mm, v, site_idx, bin, .., step) with chronic cells of chronic annuli set to 0 and ``step`` noted.

    ``days`` (day) are all frames. History moves once: a group is an annulus over ``SPAN`` frames, with the ``frames`` before them,
    so its size is bounded by the annulus's cells whatever the length of the archive. Rows without mm are history only and
    not given back.
    """
    numbered = days.withColumn("_f", F.row_number().over(Window.orderBy("day")).cast("int"))  # a row a day
    sizes = annuli.groupBy("site_idx", "bin").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    names = rows.columns
    inside = rows.where("site_idx is not null").join(numbered, "day").join(sizes, ["site_idx", "bin"])
    span = F.floor((F.col("_f") - 1) / SPAN).cast("int")
    spans = F.when(F.pmod(F.col("_f") - 1, F.lit(SPAN)) >= SPAN - frames, F.array(span, span + 1)).otherwise(F.array(span))
    spread = inside.withColumn("_span", F.explode(spans))
    rules = (frames, least_frames, range_frac, cell_frac, burst, storm, active)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        first = key[2].as_py() * SPAN + 1
        number = table.column("_f").to_numpy()
        mm, v = (table.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("mm", "v"))
        cell = table.column("cell_row").to_numpy().astype(np.int64) << 32 | table.column("cell_col").to_numpy()
        n_cells = int(table.column("_n")[0].as_py())
        gone = chronic(number, cell, mm, v, first, n_cells, *rules) if n_cells >= least_cells else np.zeros(0, int)
        steps = table.column("step").fill_null(-1).to_numpy().copy()
        steps[gone], mm[gone] = step, 0.0
        own = pa.array(np.flatnonzero((number >= first) & ~np.isnan(mm)))
        changed = {"mm": pa.array(mm), "step": pa.array(steps, pa.int32(), mask=steps < 0)}
        return pa.table({c: changed.get(c, table.column(c)) for c in names}).take(own)

    schema = rows.schema.simpleString()[7:-1].replace(":", " ")
    found = spread.groupBy("site_idx", "bin", "_span").applyInArrow(run, schema)
    return found.unionByName(rows.where("site_idx is null and mm is not null"))


def persistence(cells: DataFrame, annuli: DataFrame, inputs: DataFrame | None = None, **rules) -> DataFrame:
    """Chronic cells of chronic annuli go, unless the cell or its annulus is far above its own history.

    The history of a day is the 21 frames before it as they came in (``inputs``, else ``cells``), so days don't wait for each
    other; ``rules`` are those of ``persistent``.
    """
    none = F.lit(None).cast("double")
    rows = cells.select(*KEY, F.col("mm").cast("double").alias("mm"), (F.col("mm").cast("double") if inputs is None else none).alias("v"))
    if inputs is not None:
        rows = rows.unionByName(inputs.select(*KEY, none.alias("mm"), F.col("mm").cast("double").alias("v")))
    placed = rows.join(annuli.select(*CELL, "site_idx", "bin"), CELL, "left").withColumn("step", F.lit(None).cast("int"))
    out = persistent(placed, (cells if inputs is None else inputs).select("day").distinct(), annuli, **rules).select(*KEY, "mm")
    extra = [c for c in cells.columns if c not in (*KEY, "mm")]
    return out.join(cells.select(*KEY, *extra), KEY).select(*cells.columns) if extra else out.select(*cells.columns)


#: Side of a tile of a volume, in voxels.
TILE = 64


def echo_counts(echo: DataFrame, levels: int) -> DataFrame:
    """(vol, k, j, i, n): echoes in the 3 x 3 x 3 surroundings of every echo. A group is a tile of all levels with a rim of one
    voxel, so an echo moves to four tiles at most and no volume is one task."""
    corners = F.array(*(F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j in (-1, 1) for i in (-1, 1)))
    tile = lambda c: F.floor(c / TILE).cast("int")
    spread = echo.select("vol", *(F.col(c).cast("long").alias(c) for c in ("k", "j", "i")), F.explode(corners).alias("d"))
    spread = spread.select("vol", tile(F.col("j") + F.col("d.j")).alias("_tj"), tile(F.col("i") + F.col("d.i")).alias("_ti"), "k", "j", "i").distinct()

    def count(table: pa.Table) -> pa.Table:
        k, j, i = (table.column(c).to_numpy() for c in ("k", "j", "i"))
        j0, i0 = (int(table.column(c)[0].as_py()) * TILE - 1 for c in ("_tj", "_ti"))
        dense = np.zeros((levels + 2, TILE + 4, TILE + 4), np.int16)
        dense[k + 1, j - j0 + 1, i - i0 + 1] = 1
        for axis in range(3):
            near = np.zeros_like(dense)
            inner = [slice(None)] * 3
            for step in (-1, 0, 1):
                inner[axis] = slice(1, -1)
                near[tuple(inner)] += np.roll(dense, step, axis)[tuple(inner)]
            dense = near
        own = np.flatnonzero((j > j0) & (j <= j0 + TILE) & (i > i0) & (i <= i0 + TILE))
        out = {c: table.column(c).take(pa.array(own)) for c in ("vol", "k", "j", "i")}
        return pa.table(out | {"n": pa.array(dense[k[own] + 1, j[own] - j0 + 1, i[own] - i0 + 1].astype(np.int64))})

    kind = dict(spread.dtypes)["vol"]
    return spread.groupBy("vol", "_tj", "_ti").applyInArrow(count, f"vol {kind}, k long, j long, i long, n long")


def remove_clutter(voxels: DataFrame, levels: int, echo_dbz: float = 5.0, coverage: float = 0.32, weak_dbz: float = 20.0, shallow: bool = True) -> DataFrame:
    """``voxels`` (vol, k, j, i, dbz) without echoes of low coverage, weak echoes of the lowest level with none above,
    the lower third under a clear middle with echo aloft, and echoes whose coverage is low after that.

    Voxels without echo stay, but for those below an anvil; outside a volume there is no echo.
    """
    key, column = ["vol", "k", "j", "i"], ["vol", "j", "i"]
    is_echo = F.col("dbz") >= echo_dbz
    few = lambda echo: echo.join(echo_counts(echo.select(*key), levels), key).where(F.col("n") / 27.0 < coverage).select(*key)
    mid, high = max(1, levels // 3), min(levels - 1, 2 * levels // 3)
    any_of = lambda c: F.max(F.when(is_echo & c, 1).otherwise(0)) == 1
    k = F.col("k")
    stats = voxels.groupBy(*column).agg(any_of(k >= 1).alias("_above"), any_of(k >= high).alias("_aloft"), any_of((k >= mid) & (k < high)).alias("_mid"), any_of(k < mid).alias("_low"))
    rows = voxels.join(few(voxels.where(is_echo)).withColumn("_few", F.lit(True)), key, "left").join(stats, column)
    gone = F.coalesce("_few", F.lit(False))
    if shallow and levels >= 3:
        gone = gone | ((k == 0) & is_echo & (F.col("dbz") < weak_dbz) & ~F.col("_above"))
    if levels >= 4:
        gone = gone | ((k < mid) & F.col("_aloft") & ~F.col("_mid") & F.col("_low"))
    left = rows.where(~gone).select(*voxels.columns)
    return left.join(few(left.where(is_echo)), key, "left_anti")


def native_qc(voxels: DataFrame, levels: int, **how) -> DataFrame:
    """Voxels (vol, k, j, i, dbz, nobs, necho, weight) of enough confidence, then without clutter."""
    from cellweave.functions.quality import keep_reflectivity

    kept = voxels.where(keep_reflectivity(F.col("nobs"), F.col("necho"), F.col("weight")))
    return remove_clutter(kept.select("vol", "k", "j", "i", "dbz"), levels, **how)
