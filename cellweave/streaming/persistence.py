"""The persistence pass over a stream of daily frames, with each annulus's trailing frames in the state store.

A frame is final when the watermark has passed its day, so a day's rows may come in several files and batches. Until then it
waits in the state; then a timer filters it by the frames before it, and frames that no later one can ask for are dropped. The
state of an annulus is the cells with signal of its last frames, whatever the length of the stream; it is part of the query's
checkpoint, so a restarted query goes on where the last one stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cellweave.operators.artefacts import PERSISTENT_MM, padded_median
from cellweave.operators.climate import CELL

#: The state store that keyed state needs; to be set before the query starts.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUT = "day date, cell_row int, cell_col int, mm double"
_DAY_MS = 86_400_000
_EPOCH = pd.Timestamp("1970-01-01")


class Frame:
    """An annulus's cells with signal on one day: places, what the pass filters, and what later days see as history."""

    def __init__(self, number: int, day: int, n_cells: int, row: np.ndarray, col: np.ndarray, mm: np.ndarray, v: np.ndarray, done: bool = False):
        self.number, self.day, self.n_cells, self.row, self.col, self.mm, self.v, self.done = number, day, n_cells, row, col, mm, v, done

    def packed(self) -> tuple:
        return self.day, self.n_cells, self.row.astype("<i4").tobytes(), self.col.astype("<i4").tobytes(), self.mm.astype("<f8").tobytes(), self.v.astype("<f8").tobytes(), self.done

    @classmethod
    def unpacked(cls, number: int, value) -> Frame:
        row, col = (np.frombuffer(value[i], "<i4") for i in (2, 3))
        mm, v = (np.frombuffer(value[i], "<f8") for i in (4, 5))
        return cls(number, value[0], value[1], row, col, mm, v, value[6])

    def with_rows(self, other: Frame) -> Frame:
        """Both frames' cells; a cell that both have has the larger values."""
        cells = pd.DataFrame({c: np.concatenate([getattr(self, c), getattr(other, c)]) for c in ("row", "col", "mm", "v")}).groupby(["row", "col"], as_index=False).max()
        return Frame(self.number, self.day, self.n_cells, *(cells[c].to_numpy() for c in ("row", "col", "mm", "v")), self.done)


def filtered(frame: Frame, history: list[Frame], frames: int, least_frames: int, least_cells: int, range_frac: float, cell_frac: float, burst: float, storm: float, active: float) -> np.ndarray:
    """The frame's mm with its chronic cells set to 0, by the rules of ``artefacts.persistence``."""
    n = min(frames, frame.number - 1)
    past = [h for h in history if frame.number - frames <= h.number < frame.number]
    if n < least_frames or frame.n_cells < least_cells or sum((h.v >= active).any() for h in past) < range_frac * n:
        return frame.mm
    today = padded_median(frame.mm[frame.mm > 0], frame.n_cells)
    usual = padded_median(np.concatenate([h.v[h.v > 0] for h in past]), n * frame.n_cells)
    if today >= storm * max(usual, 1.0) and today >= active:
        return frame.mm
    out = frame.mm.copy()
    for i in np.flatnonzero(frame.mm >= active):
        own = np.concatenate([h.v[(h.row == frame.row[i]) & (h.col == frame.col[i])] for h in past])
        if (own >= active).sum() >= cell_frac * n and frame.mm[i] < burst * max(padded_median(own[own > 0], n), 1.0):
            out[i] = 0.0
    return out


class Trailing(StatefulProcessor):
    """State of an annulus: its frames by number, those not yet final among them, and the next timer."""

    def __init__(self, rules: dict):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getMapState("frames", "number int", "day int, n_cells int, cells_row binary, cells_col binary, mm binary, v binary, done boolean")
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, at: int) -> None:
        """Have a timer at the end of a day, unless an earlier one is set; that one sets the next."""
        if not self.timer.exists() or self.timer.get()[0] > at:
            self.timer.update((at,))
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows))
        every["day_number"] = (pd.to_datetime(every["day"]) - _EPOCH).dt.days
        for number, part in every.groupby("frame"):
            frame = Frame(int(number), int(part["day_number"].iloc[0]), int(part["n_cells"].iloc[0]), *(part[c].to_numpy() for c in ("cell_row", "cell_col", "mm", "v")))
            if self.frames.containsKey((frame.number,)):
                frame = Frame.unpacked(frame.number, self.frames.getValue((frame.number,))).with_rows(frame)
            self.frames.updateValue((frame.number,), frame.packed())
        self._wake((int(every["day_number"].min()) + 1) * _DAY_MS)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        held = sorted((Frame.unpacked(k[0], v) for k, v in self.frames.iterator()), key=lambda f: f.number)
        final = timerValues.getCurrentWatermarkInMs()
        ready = [f for f in held if not f.done and (f.day + 1) * _DAY_MS <= final]
        waiting = [f for f in held if not f.done and (f.day + 1) * _DAY_MS > final]
        out = []
        for f in ready:
            mm = filtered(f, held, **self.rules)
            out.append(pd.DataFrame({"day": (_EPOCH + pd.to_timedelta(np.full(len(mm), f.day), "D")).date, "cell_row": f.row, "cell_col": f.col, "mm": mm}))
        if ready:
            oldest = min(f.number for f in waiting) if waiting else max(f.number for f in ready) + 1
            for f in held:
                if f.number < oldest - self.rules["frames"]:
                    self.frames.removeKey((f.number,))
                elif f in ready:
                    f.done = True
                    self.frames.updateValue((f.number,), f.packed())
        if waiting:
            self._wake((min(f.day for f in waiting) + 1) * _DAY_MS)
        return iter(out)


def persistence_stream(frames: DataFrame, annuli: DataFrame, lateness: str = "0 seconds", history: int = 21, least_frames: int = 7, least_cells: int = 5, range_frac: float = 0.6, cell_frac: float = 0.35, burst: float = 1.75, storm: float = 1.5, active: float = PERSISTENT_MM) -> DataFrame:
    """``artefacts.persistence`` of a stream of (day, frame, cell_row, cell_col, mm, v), as a stream of (day, cell, mm).

    ``frame`` numbers the days that have a frame from 1 on; v is what a day's history shows, mm what the pass filters. ``annuli`` (cell,
    site_idx, bin) is a static table. A day is given out when a row of a later day, by ``lateness`` later, has been seen; rows of
    days already given out are dropped. Cells of no annulus pass at once as they are. The session must use the state store in
    ``ROCKSDB``.
    """
    sizes = annuli.groupBy("site_idx", "bin").agg(F.count(F.lit(1)).cast("int").alias("n_cells"))
    places = annuli.select(*CELL, "site_idx", "bin").join(sizes, ["site_idx", "bin"])
    timed = frames.withColumn("ts", F.col("day").cast("timestamp")).withWatermark("ts", lateness)
    rows = timed.join(places, CELL, "left")
    rules = {"frames": history, "least_frames": least_frames, "least_cells": least_cells, "range_frac": range_frac, "cell_frac": cell_frac, "burst": burst, "storm": storm, "active": active}
    inside = rows.where("site_idx is not null").select("site_idx", "bin", "n_cells", "day", "ts", "frame", *CELL, "mm", "v")
    passed = inside.groupBy("site_idx", "bin").transformWithStateInPandas(statefulProcessor=Trailing(rules), outputStructType=OUT, outputMode="Append", timeMode="eventTime")
    return passed.unionByName(rows.where("site_idx is null").select("day", *CELL, F.col("mm").cast("double").alias("mm")))
