"""The persistence stream against the batch pass: restarts, days in several files, replays, bounded state."""

import datetime as dt
import os
import random

import numpy as np
import pytest

from cellweave.operators import artefacts
from cellweave.streaming import persistence as P

SCHEMA = "day date, frame int, cell_row int, cell_col int, mm double, v double"


@pytest.fixture
def rocksdb(spark):
    before = {k: spark.conf.get(k, None) for k in P.ROCKSDB}
    for k, v in P.ROCKSDB.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def chronic(n_days=40, seed=1):
    """Days with gaps of a grid of 6 x 8 cells, half of them nearly always active, with bursts and storms."""
    rng = random.Random(seed)
    rows, day = [], dt.date(2015, 3, 1)
    for f in range(1, n_days + 1):
        day += dt.timedelta(rng.randrange(1, 4))
        storm = rng.random() < 0.1
        for r in range(6):
            for c in range(8):
                if (c < 4 and rng.random() < 0.8) or rng.random() < 0.1 or storm:
                    mm = rng.uniform(20, 45) * (3 if storm or rng.random() < 0.05 else 1)
                    rows.append((day, f, r, c, mm, mm * 0.9))
    return rows


@pytest.fixture
def annuli(spark):
    """Four annuli of 12 or fewer cells and a ring of 3 that is too small; cell (5, 7) is in none and passes at once."""
    return spark.createDataFrame([(r, c, 1, c // 4 * 2 + (r < 3)) for r in range(6) for c in range(8) if (r, c) != (5, 7)][:-3] + [(5, c, 2, 9) for c in (4, 5, 6)], "cell_row int, cell_col int, site_idx int, bin int").dropDuplicates(["cell_row", "cell_col"])


def start(spark, path, annuli, **source):
    frames = spark.readStream.schema(SCHEMA).options(**source).parquet(f"{path}/in")
    return P.persistence_stream(frames, annuli).writeStream.option("checkpointLocation", f"{path}/checkpoint").format("parquet")


def deliver(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")


def left(spark, path):
    return sorted((str(r.day), r.cell_row, r.cell_col, round(r.mm, 9)) for r in spark.read.schema(P.OUT).parquet(f"{path}/out").collect())


def batch(spark, rows, annuli):
    frame = spark.createDataFrame(rows, SCHEMA)
    last = max(r[0] for r in rows)
    out = artefacts.persistence(frame.drop("v", "frame"), annuli, inputs=frame.select("day", "cell_row", "cell_col", frame["v"].alias("mm")))
    return sorted((str(r.day), r.cell_row, r.cell_col, round(r.mm, 9)) for r in out.collect() if r.day < last or (r.cell_row, r.cell_col) == (5, 7))


def test_stream_equals_batch_over_restarts(spark, rocksdb, annuli, tmp_path):
    rows = chronic()
    for a in (0, 9, 10, 31):
        part = [r for r in rows if a < r[1] <= {0: 9, 9: 10, 10: 31, 31: 40}[a]]
        deliver(spark, tmp_path, part[::2])  # a day's rows come in two files
        deliver(spark, tmp_path, part[1::2])
        start(spark, tmp_path, annuli).trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    want = batch(spark, rows, annuli)
    assert left(spark, tmp_path) == want
    removed = sum(mm == 0 for *_, mm in want)
    assert 50 < removed < len(want) / 2


def test_a_killed_stream_goes_on(spark, rocksdb, annuli, tmp_path):
    """Stopped between batches, and with its last commit lost, so that a batch is replayed: nothing twice, nothing missing."""
    rows = chronic(24, seed=2)
    for f in range(1, 25):
        deliver(spark, tmp_path, [r for r in rows if r[1] == f])
        if f == 12:
            query = start(spark, tmp_path, annuli, maxFilesPerTrigger=4).trigger(processingTime="0 seconds").start(f"{tmp_path}/out")
            query.processAllAvailable()
            query.stop()
    commits = tmp_path / "checkpoint" / "commits"
    newest = max((int(x) for x in os.listdir(commits) if x.isdigit()))
    for name in (str(newest), f".{newest}.crc"):
        os.rename(commits / name, tmp_path / f"lost-{name}")
    start(spark, tmp_path, annuli, maxFilesPerTrigger=5).trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    assert left(spark, tmp_path) == batch(spark, rows, annuli)


def test_state_holds_the_last_frames_only(spark):
    rng = np.random.default_rng(3)
    held = {}

    class States:
        def __init__(self):
            self.value = None

        exists = lambda self: self.value is not None
        get = lambda self: self.value
        update = lambda self, x: setattr(self, "value", x)
        clear = lambda self: setattr(self, "value", None)
        containsKey = lambda self, k: k in held
        getValue = lambda self, k: held[k]
        updateValue = lambda self, k, v: held.__setitem__(k, v)
        removeKey = lambda self, k: held.pop(k)
        iterator = lambda self: iter(list(held.items()))

    class Handle:
        getMapState = lambda self, *a: States()
        getValueState = lambda self, *a: States()
        registerTimer = lambda self, at: None

    class At:
        def __init__(self, day):
            self.day = day

        getCurrentWatermarkInMs = lambda self: self.day * 86_400_000

    import pandas as pd

    p = P.Trailing({"frames": 21, "least_frames": 7, "least_cells": 5, "range_frac": 0.6, "cell_frac": 0.35, "burst": 1.75, "storm": 1.5, "active": 25.4})
    p.init(Handle())
    for f in range(1, 60):
        cells = pd.DataFrame({"day": dt.date(2000, 1, 1) + dt.timedelta(f), "frame": f, "n_cells": 9, "cell_row": 1, "cell_col": range(6), "mm": rng.uniform(0, 60, 6), "v": 30.0})
        assert list(p.handleInputRows((1, 1), iter([cells]), None)) == []
        out = list(p.handleExpiredTimer((1, 1), At(10957 + f), None))
        assert sum(map(len, out)) == (6 if f > 1 else 0)  # the day before is final
        assert len(held) <= 22


def test_medians_with_zeros():
    rng = np.random.default_rng(4)
    for _ in range(50):
        values = rng.uniform(0, 9, int(rng.integers(0, 12)))
        total = len(values) + int(rng.integers(0 if len(values) else 1, 9))
        assert P.padded_median(values, total) == pytest.approx(np.median(np.concatenate([values, np.zeros(total - len(values))])))
