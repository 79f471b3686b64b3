"""Passes over whole days against the passes as joins; the persistence pass against a dense restatement, over any span."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import artefacts, daypasses

ROWS, COLS = 24, 30


@pytest.fixture(scope="module")
def grid(spark):
    """Two sites' annuli, of which one is flagged; a corner of the grid has none."""
    rng = np.random.default_rng(1)
    rows = [(r, c, int(c >= 15), int(np.hypot(r - 12, c % 15 - 7) // 2), int(np.hypot(r - 12, c % 15 - 7) // 5), int(rng.integers(0, 6)), bool(c >= 15)) for r in range(ROWS) for c in range(COLS) if (r, c) not in {(0, 0), (0, 1), (23, 29)}]
    return spark.createDataFrame(rows, "cell_row int, cell_col int, site_idx int, bin int, coarse int, sector int, flagged boolean").cache()


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(2)
    out = {(0, 0): 90.0, (0, 29): 4.0, (5, 5): 30.0}
    rows = [(dt.date(2014, 1, 1) + dt.timedelta(d), r, c, float(mm)) for d in range(6) for (r, c), mm in (out if d == 0 else {(int(r), int(c)): mm for r, c, mm in zip(rng.integers(0, ROWS, 420), rng.integers(0, COLS, 420), np.round(rng.gamma(2, 9, 420), 1), strict=True)}).items()]
    return spark.createDataFrame(rows, "day date, cell_row int, cell_col int, mm double").cache()


def values(frame):
    return {(r.day, r.cell_row, r.cell_col): r.mm for r in frame.collect()}


def as_joins(name, cells, grid):
    return {
        "isolated": lambda: artefacts.speckle(cells, ROWS, COLS),
        "radial_ring": lambda: artefacts.radial_rings(cells, grid),
        "azimuthal": lambda: artefacts.above_median(cells, grid, ["site_idx", "bin"], 8, 2.5),
        "filament": lambda: artefacts.filament(cells, ROWS, COLS),
        "site_azimuthal": lambda: artefacts.above_median(cells, grid, ["site_idx", "coarse"], 8, 1.6),
        "site_polar_spoke": lambda: artefacts.above_median(cells, grid, ["site_idx", "bin", "sector"], 4, 1.5),
        "site_radial_ring": lambda: artefacts.radial_rings(cells, grid, ring=1.05, far_ring=1.10),
    }[name]()


@pytest.mark.parametrize("name", ["isolated", "radial_ring", "azimuthal", "filament", "site_azimuthal", "site_polar_spoke", "site_radial_ring"])
def test_a_pass_equals_its_joins(cells, grid, name):
    passes = [p for p in [*daypasses.EARLY, *daypasses.SITE] if p[0] == name]
    out = daypasses.by_day(daypasses.placed(cells, grid), passes, ROWS, COLS)
    want = values(as_joins(name, cells, grid))
    assert values(out) == want
    before = values(cells)
    taken = {(r.day, r.cell_row, r.cell_col): r.step for r in out.where("step is not null").collect()}
    assert set(taken.values()) <= {daypasses.NAMES.index(name)} and set(taken) == {k for k, mm in want.items() if mm == 0 < before[k]}
    assert name in ("filament",) or taken


def test_flagged_sites_only(cells, grid):
    passes = [p for p in daypasses.SITE if p[0] == "site_azimuthal"]
    out = values(daypasses.by_day(daypasses.placed(cells, grid), passes, ROWS, COLS, True))
    everywhere = values(as_joins("site_azimuthal", cells, grid))
    assert out == {k: everywhere[k] if k[2] >= 15 and k != (k[0], 23, 29) else mm for k, mm in values(cells).items()}


def test_no_cells(spark, cells, grid):
    assert daypasses.all_passes(cells.limit(0), grid, ROWS, COLS).collect() == []


def plain_persistence(rows, grid):
    """The rules on dense arrays, day by day."""
    days = sorted({d for d, *_ in rows})
    mm = np.zeros((len(days), ROWS, COLS))
    for d, r, c, v in rows:
        mm[days.index(d), r, c] = v
    out = mm.copy()
    rings = {}
    for r in grid:
        rings.setdefault((r.site_idx, r.bin), []).append((r.cell_row, r.cell_col))
    for f in range(7, len(days)):
        past = mm[max(0, f - 21) : f]
        for places in rings.values():
            if len(places) < 5:
                continue
            at = tuple(np.array(places).T)
            held, today = past[:, at[0], at[1]], mm[f][at]
            if (held >= 25.4).any(1).mean() < 0.6 or (np.median(today) >= 1.5 * max(np.median(held), 1) and np.median(today) >= 25.4):
                continue
            gone = (today >= 25.4) & ((held >= 25.4).mean(0) >= 0.35) & (today < 1.75 * np.maximum(np.median(held, 0), 1))
            out[f][at] = np.where(gone, 0, today)
    return {(d, r, c): out[days.index(d), r, c] for d, r, c, _ in rows}


@pytest.mark.parametrize("span", [22, 30, 256])
def test_persistence_over_spans(spark, grid, monkeypatch, span):
    """Days with gaps, annuli that are silent for long, chronic cells; spans shorter than the history's reach end amid it."""
    monkeypatch.setattr(artefacts, "SPAN", span)
    rng = np.random.default_rng(5)
    rows = []
    for d in range(90):
        if d % 7 == 3:
            continue
        for r in range(6, 18):
            for c in range(3, 27):
                chronic = c < 15 or (c >= 20 and not 30 <= d < 60)
                if rng.random() < (0.75 if chronic else 0.05):
                    rows.append((dt.date(2012, 1, 1) + dt.timedelta(d), r, c, float(np.round(rng.uniform(15, 60), 1))))
    frame = spark.createDataFrame(rows, "day date, cell_row int, cell_col int, mm double")
    want = plain_persistence(rows, grid.collect())
    assert values(artefacts.persistence(frame, grid)) == want
    assert sum(mm == 0 for mm in want.values()) > 500
    assert values(artefacts.persistence(frame, grid, inputs=frame.withColumn("mm", F.col("mm")))) == want


def test_padded_medians():
    rng = np.random.default_rng(6)
    for _ in range(200):
        v = rng.integers(1, 9, int(rng.integers(0, 12))).astype(float)
        total = len(v) + int(rng.integers(0 if len(v) else 1, 14))
        assert artefacts.padded_median(v, total) == np.median(np.concatenate([v, np.zeros(total - len(v))]))
