"""The artefact passes over whole days: one shuffle by day, then every pass on the day's grid in numpy.

A day has at most as many cells as the grid, so its group is bounded whatever the length of the archive, and windows and
annuli of the day need no further exchange. Rules are those of ``artefacts``; each row keeps the number of the pass that set
it to 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.artefacts import ACTIVE_MM, KEY
from cellweave.operators.climate import CELL

#: What rows carry through the passes, besides day and cell: the value, what history shows, annulus, and the pass that took it.
PLACE = ["site_idx", "bin", "coarse", "sector", "flagged"]
ROW = "day date, cell_row int, cell_col int, mm double, v double, site_idx long, bin int, coarse int, sector int, flagged boolean, step int"
_SCHEMA = pa.schema([("day", pa.date32()), ("cell_row", pa.int32()), ("cell_col", pa.int32()), ("mm", pa.float64()), ("v", pa.float64()), ("site_idx", pa.int64()), ("bin", pa.int32()), ("coarse", pa.int32()), ("sector", pa.int32()), ("flagged", pa.bool_()), ("step", pa.int32())])


def placed(cells: DataFrame, annuli: DataFrame, inputs: str = "mm") -> DataFrame:
    """``ROW`` of daily cells, their annulus attached once; ``flagged`` cells are those of sites in ``annuli.flagged``."""
    rows = cells.select(*KEY, F.col("mm").cast("double").alias("mm"), F.col(inputs).cast("double").alias("v")).join(annuli.select(*CELL, *PLACE), CELL, "left")
    return rows.select(*KEY, "mm", "v", F.col("site_idx").cast("long").alias("site_idx"), *(F.col(c).cast("int").alias(c) for c in ("bin", "coarse", "sector")), F.coalesce("flagged", F.lit(False)).alias("flagged"), F.lit(None).cast("int").alias("step"))


@dataclass
class Day:
    """A day's cells as arrays; cells of no annulus have site -1."""

    row: np.ndarray
    col: np.ndarray
    mm: np.ndarray
    site: np.ndarray
    bin: np.ndarray
    coarse: np.ndarray
    sector: np.ndarray
    shape: tuple[int, int]

    def windows(self, at: np.ndarray, half: int) -> np.ndarray:
        """Medians over (2 half + 1)^2 cells around the cells ``at``, absent ones 0, edges replicated."""
        dense = np.zeros(self.shape)
        dense[self.row, self.col] = self.mm
        step = np.arange(-half, half + 1)
        out = np.zeros(len(at))
        for a in range(0, len(at), 4096):
            part = at[a : a + 4096]
            r = np.clip(self.row[part, None] + step, 0, self.shape[0] - 1)
            c = np.clip(self.col[part, None] + step, 0, self.shape[1] - 1)
            out[a : a + 4096] = np.median(dense[r[:, :, None], c[:, None, :]].reshape(len(part), -1), axis=1)
        return out

    def medians(self, least: int, *by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every cell, the median of its group's active cells, NaN where they are under ``least`` or the cell has no site; and
        the group's number."""
        key = np.zeros(len(self.mm), np.int64)
        for x in (self.site, *by):
            key = key * 4096 + x
        _, group = np.unique(key, return_inverse=True)
        some = np.flatnonzero((self.mm >= ACTIVE_MM) & (self.site >= 0))
        order = some[np.lexsort((self.mm[some], group[some]))]
        n = np.bincount(group[order], minlength=int(group.max(initial=-1)) + 1)
        start = np.cumsum(n) - n
        out = np.full(len(n), np.nan)
        full = np.flatnonzero(n >= least)
        values = self.mm[order]
        out[full] = (values[start[full] + (n[full] - 1) // 2] + values[start[full] + n[full] // 2]) / 2
        return np.where(self.site >= 0, out[group], np.nan), group


def isolated(day: Day, factor: float = 2.5) -> np.ndarray:
    at = np.flatnonzero(day.mm >= ACTIVE_MM)
    return at[day.mm[at] > factor * np.maximum(day.windows(at, 1), 1)]


def filaments(day: Day, margin: float = 20.0, half: int = 10, background: float = 15.0) -> np.ndarray:
    at = np.flatnonzero(day.mm > margin)
    med = day.windows(at, half)
    return at[(med < background) & (day.mm[at] > med + margin)]


def over_median(day: Day, least: int, factor: float, *by: np.ndarray) -> np.ndarray:
    med, _ = day.medians(least, *by)
    with np.errstate(invalid="ignore"):
        return np.flatnonzero((day.mm >= ACTIVE_MM) & (day.mm > factor * np.maximum(med, 1)))


def rings(day: Day, ring: float = 1.12, far_ring: float = 1.18, width: float = 10.0, least: int = 5, far_km: float = 100.0, inner_km: float = 75.0, outer_km: float = 50.0, margin: float = 5.0) -> np.ndarray:
    if not (day.site >= 0).any():
        return np.zeros(0, int)
    med, _ = day.medians(least, day.bin)
    sites, s = np.unique(day.site, return_inverse=True)
    n_bins = int(day.bin.max()) + 1
    table = np.full((len(sites), n_bins), np.nan)
    table[s, day.bin] = np.where(day.site >= 0, med, np.nan)
    center = (np.arange(n_bins) + 0.5) * width
    wide = np.pad(table, ((0, 0), (2, 2)), constant_values=np.nan)
    near = _nanmedian(np.stack([wide[:, k : k + n_bins] for k in (0, 1, 3, 4)]), 0)
    inner = _nanmedian(table[:, center <= inner_km], 1)[:, None]
    ref = np.maximum(np.nan_to_num(near, nan=0.0), 1.0)
    ref = np.where((center >= outer_km) & ~np.isnan(inner), np.fmax(ref, inner), ref)
    with np.errstate(invalid="ignore"):
        stands = (~np.isnan(near) | ~np.isnan(inner)) & (table > ref * np.where(center > far_km, far_ring, ring))
        limit = np.where(stands, ref + np.maximum(margin, (table - ref) * 0.5), np.nan)[s, day.bin]
        return np.flatnonzero((day.mm >= ACTIVE_MM) & (day.site >= 0) & (day.mm > limit))


def _nanmedian(x: np.ndarray, axis: int) -> np.ndarray:
    """Median of the numbers along an axis; NaN where there are none."""
    x = np.sort(np.moveaxis(x, axis, -1), axis=-1)  # NaN last
    n = (~np.isnan(x)).sum(-1, keepdims=True)
    at = lambda k: np.take_along_axis(x, np.clip(k, 0, max(x.shape[-1] - 1, 0)), -1)[..., 0] if x.shape[-1] else np.full(x.shape[:-1], np.nan)
    return np.where(n[..., 0] > 0, (at((n - 1) // 2) + at(n // 2)) / 2, np.nan)


#: The passes before the persistence pass, in order, and those over flagged sites after it.
EARLY: list[tuple[str, Callable[[Day], np.ndarray]]] = [
    ("isolated", isolated),
    ("radial_ring", rings),
    ("azimuthal", lambda d: over_median(d, 8, 2.5, d.bin)),
    ("filament", filaments),
]
SITE: list[tuple[str, Callable[[Day], np.ndarray]]] = [
    ("site_isolated", lambda d: isolated(d, 2.0)),
    ("site_radial_ring", lambda d: rings(d, 1.05, 1.10)),
    ("site_azimuthal", lambda d: over_median(d, 8, 1.6, d.coarse)),
    ("site_filament", lambda d: filaments(d, 12.0)),
    ("site_polar_spoke", lambda d: over_median(d, 4, 1.5, d.bin, d.sector)),
]
PERSISTENT = "persistent_range"
NAMES = [*(n for n, _ in EARLY), PERSISTENT, *(n for n, _ in SITE)]


def by_day(rows: DataFrame, passes: list[tuple[str, Callable[[Day], np.ndarray]]], n_rows: int, n_cols: int, flagged_only: bool = False) -> DataFrame:
    """``ROW`` after the passes, each on the last one's output; ``step`` numbers the pass by ``NAMES``."""
    numbers = [NAMES.index(n) for n, _ in passes]

    def run(table: pa.Table) -> pa.Table:
        ints = lambda c: table.column(c).fill_null(-1).to_numpy().astype(np.int64)
        mm = table.column("mm").to_numpy().copy()
        flagged, step = table.column("flagged").to_numpy(zero_copy_only=False), table.column("step").fill_null(-1).to_numpy().copy()
        day = Day(ints("cell_row"), ints("cell_col"), mm, ints("site_idx"), ints("bin"), ints("coarse"), ints("sector"), (n_rows, n_cols))
        for number, (_, hits) in zip(numbers, passes, strict=True):
            at = hits(day)
            at = at[flagged[at]] if flagged_only else at
            step[at[mm[at] > 0]] = number
            mm[at] = 0.0
        changed = {"mm": pa.array(mm), "step": pa.array(step, pa.int32(), mask=step < 0)}
        return pa.table([changed.get(c, table.column(c)) for c in _SCHEMA.names], schema=_SCHEMA)

    return rows.select(*_SCHEMA.names).groupBy("day").applyInArrow(run, ROW)


def all_passes(cells: DataFrame, annuli: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """``ROW`` of daily cells after all passes: shuffled by day, by annulus and span of frames, and by day again."""
    from cellweave.operators.artefacts import persistent

    early = by_day(placed(cells, annuli), EARLY, n_rows, n_cols)
    days = cells.select("day").distinct()
    return by_day(persistent(early, days, annuli, NAMES.index(PERSISTENT)), SITE, n_rows, n_cols, True)
