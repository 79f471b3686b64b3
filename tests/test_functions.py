"""Small cases with known answers."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cellweave.functions import clock, grid, quality, specfun
from cellweave.operators import artefacts, checks, events, extremes, ingest, simulation, spatial

D = dt.date


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_convective_day_is_half_open(spark):
    rows = spark.createDataFrame([("2016-07-21 08:00:00",), ("2016-07-21 12:00:00",), ("2016-07-22 12:00:00",)], "s string").select(clock.convective_day(F.col("s").cast("timestamp")).alias("d"))
    assert [r.d for r in rows.collect()] == [D(2016, 7, 20), D(2016, 7, 21), D(2016, 7, 22)]


def test_name_time(spark):
    rows = spark.createDataFrame([("a/x_20160721T081530Z.gz",), ("y_20160721-081530.nc",), ("z_20161321-081530",), ("none",)], "n string").select(clock.name_time(F.col("n")).alias("t"))
    assert [r.t for r in rows.collect()] == [dt.datetime(2016, 7, 21, 8, 15, 30)] * 2 + [None, None]


def test_eras(spark):
    rows = spark.createDataFrame([(D(2010, 6, 1),), (D(2015, 6, 1),), (D(2022, 6, 1),)], "d date").select(clock.era(F.col("d")).alias("e"))
    assert [r.e for r in rows.collect()] == ["MYRORSS", "GridRad", "MRMS"]


def test_doy_distance(spark):
    assert one(spark, clock.doy_distance(F.lit(360), F.lit(5))) == 11


def test_sanitize(spark):
    rows = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 300.0, 300.1, float("nan"), float("inf"), None)], "v double").select(quality.sanitize(F.col("v")).alias("v"))
    assert [r.v for r in rows.collect()] == [0, 0, 300, 0, 0, 0, 0]


def test_recalibration_is_increasing(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 10.0, 20.0, 40.0)], "v double").select(quality.recalibrate(F.col("v")).alias("v"))
    got = [r.v for r in rows.collect()]
    assert got[0] == 0 and got == sorted(set(got))


def test_environment_filter(spark):
    rows = spark.createDataFrame([(x,) for x in (4.0, 10.0, 30.0)], "v double").select(quality.environment_filter(F.col("v"), F.lit(29.0), F.lit(10)).alias("v"))
    assert [r.v for r in rows.collect()] == [0, 0, 30]


def test_topo_factor(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 1000.0, 3000.0)], "e double").select(quality.topo_factor(F.col("e"), F.lit(4.0)).alias("f"))
    got = [r.f for r in rows.collect()]
    assert got == sorted(set(got)) and got[0] >= 1 and got[-1] <= 1.25


def test_grid_edges(spark):
    rows = spark.createDataFrame([(50.02, -100.0), (23.0, -100.0), (49.99, -124.99)], "lat double, lon double").select(grid.latlon_to_cell(F.col("lat"), F.col("lon")).alias("c"))
    assert [tuple(r.c) for r in rows.collect()] == [(0, 500), (-1, -1), (0, 0)]


def test_normal_approximations(spark):
    for x in (-3.0, -0.5, 0.0, 1.2, 4.0):
        assert abs(one(spark, F.expr(specfun.normal_cdf(specfun.lit(x)))) - 0.5 * math.erfc(-x / math.sqrt(2))) < 2e-7
    for p in (0.001, 0.3, 0.5, 0.99):
        q = one(spark, F.expr(specfun.normal_quantile(specfun.lit(p))))
        assert abs(0.5 * math.erfc(-q / math.sqrt(2)) - p) < 1e-7


@pytest.mark.parametrize("p,want", [(0.0, 0.0), (0.001, 0.0)])
def test_return_level_without_occurrence(spark, p, want):
    row = spark.createDataFrame([(0, 0, p, 3.0, 0.5, 0.1, 10.0, 50.8)], "cell_row int, cell_col int, p_occ double, mu double, sigma double, xi double, scale double, u double")
    assert extremes.return_levels(row, (100,)).first().mm == want


def test_return_level_of_a_light_tail(spark):
    row = spark.createDataFrame([(0, 0, 0.5, 3.9, 0.5, 0.0, 10.0, 50.8)], "cell_row int, cell_col int, p_occ double, mu double, sigma double, xi double, scale double, u double")
    assert extremes.return_levels(row, (100,)).first().mm >= 50.8


def cells(spark, rows):
    return spark.createDataFrame(rows, "day date, cell_row int, cell_col int, mm double")


def grouped(spark, rows, buffer=15):
    lat, lon = grid.cell_center(F.col("cell_row"), F.col("cell_col"))
    return [(r.event_id, r.day) for r in events.event_days(cells(spark, rows), lat, lon, buffer).orderBy("day").collect()]


def test_adjacent_days_join_unless_the_peak_jumps(spark):
    a, b = D(2010, 5, 1), D(2010, 5, 2)
    assert [e for e, _ in grouped(spark, [(a, 10, 10, 30.0), (b, 10, 11, 35.0)])] == [0, 0]
    assert [e for e, _ in grouped(spark, [(a, 10, 10, 30.0), (b, 10, 11, 200.0)])] == [0, 1]


def test_far_cells_are_two_events(spark):
    assert [e for e, _ in grouped(spark, [(D(2010, 5, 1), 1, 1, 30.0), (D(2010, 5, 2), 48, 48, 30.0)])] == [0, 1]


def test_long_events_are_cut(spark):
    rows = [(D(2010, 5, d), 10, 10, 30.0) for d in range(1, 13)]
    assert [e for e, _ in grouped(spark, rows)] == [0] * 5 + [1] * 5 + [2] * 2


def test_overlap_equals_brute_force(spark):
    import random

    rng = random.Random(1)
    a, b = D(2010, 1, 1), D(2010, 1, 2)
    for buffer in (1, 3, 15):
        for _ in range(3):
            rows = [(d, rng.randrange(80), rng.randrange(80), 30.0) for d in (a, b) for _ in range(6)]
            steps = spark.createDataFrame([(b, a)], "day date, prev_day date")
            want = any(abs(x[1] - y[1]) <= buffer and abs(x[2] - y[2]) <= buffer for x in rows[:6] for y in rows[6:])
            assert (spatial.overlapping_days(cells(spark, rows), steps, buffer).count() == 1) == want


def test_speckle(spark):
    day = D(2013, 5, 1)
    lone = artefacts.speckle(cells(spark, [(day, 5, 5, 40.0)]), 20, 20)
    assert lone.first().mm == 0
    patch = cells(spark, [(day, r, c, 40.0) for r in range(6) for c in range(6)])
    assert artefacts.removed(patch, artefacts.speckle(patch, 20, 20)).first().n_removed <= 4  # the patch's outer corners
    whole = cells(spark, [(day, r, c, 40.0) for r in range(6) for c in range(6)])
    assert artefacts.removed(whole, artefacts.speckle(whole, 6, 6)).first().n_removed == 0


def test_filament_keeps_broad_swaths(spark):
    day = D(2013, 5, 1)
    wide = cells(spark, [(day, r, c, 40.0) for r in range(9) for c in range(9)])
    assert artefacts.removed(wide, artefacts.filament(wide, 9, 9, half=2)).first().n_removed == 0
    thin = cells(spark, [(day, 4, c, 40.0) for c in range(9)])
    assert artefacts.removed(thin, artefacts.filament(thin, 9, 9, half=2)).first().n_removed == 9


def test_radial_ring(spark):
    annuli = spark.createDataFrame([(r, c, 0, c // 2) for r in range(10) for c in range(16)], "cell_row int, cell_col int, site_idx long, bin int")
    day = D(2013, 5, 1)
    ringed = cells(spark, [(day, r, c, 40.0 if c in (6, 7) else 10.0) for r in range(10) for c in range(16)])
    out = artefacts.radial_rings(ringed, annuli, width=25.0)
    assert {r.cell_col for r in out.where("mm = 0").collect()} == {6, 7}
    uniform = cells(spark, [(day, r, c, 35.0) for r in range(10) for c in range(16)])
    assert artefacts.removed(uniform, artefacts.radial_rings(uniform, annuli, width=25.0)).first().n_removed == 0


def test_persistence_keeps_bursts(spark):
    annuli = spark.createDataFrame([(0, c, 0, 0) for c in range(6)], "cell_row int, cell_col int, site_idx long, bin int")
    rows = [(D(2013, 5, d), 0, c, 30.0) for d in range(1, 12) for c in (0, 1)] + [(D(2013, 5, 12), 0, 0, 30.0), (D(2013, 5, 12), 0, 1, 80.0)]
    out = artefacts.persistence(cells(spark, rows), annuli).where("day = date'2013-05-12'")
    assert {r.cell_col: r.mm for r in out.collect()} == {0: 0.0, 1: 80.0}
    weak = cells(spark, [(d, r, c, 20.0) for d, r, c, _ in rows])  # under 25.4 mm a cell isn't active here
    assert weak.exceptAll(artefacts.persistence(weak, annuli)).isEmpty()


def test_an_annulus_with_few_active_cells_is_left_alone(spark):
    annuli = spark.createDataFrame([(0, c, 0, 0) for c in range(9)], "cell_row int, cell_col int, site_idx long, bin int")
    few = cells(spark, [(D(2013, 5, 1), 0, c, 60.0) for c in range(7)])
    assert few.exceptAll(artefacts.above_median(few, annuli, ["site_idx", "bin"], 8, 2.5)).isEmpty()
    enough = cells(spark, [(D(2013, 5, 1), 0, c, 60.0 if c == 8 else 10.0) for c in range(9)])
    assert {r.cell_col for r in artefacts.above_median(enough, annuli, ["site_idx", "bin"], 8, 2.5).where("mm = 0").collect()} == {8}


def test_mann_kendall_of_a_rising_series(spark):
    row = checks.mann_kendall(spark.range(12).withColumn("v", F.col("id") * 2.0), "id", "v").first()
    assert row.s == 66 and row.status == "warn"


def test_interpolation_clamps(spark):
    rows = spark.createDataFrame([(v, [1.0, 2.0, 4.0], [10.0, 20.0, 30.0]) for v in (0.5, 1.0, 1.5, 3.0, 9.0)], "v double, xs array<double>, ys array<double>")
    assert [r.y for r in rows.select(ingest.interpolate(F.col("v"), F.col("xs"), F.col("ys")).alias("y")).collect()] == [10, 10, 15, 25, 30]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in ingest.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_l_moment_fit_recovers_a_pareto(spark):
    import numpy as np

    u = np.random.default_rng(0).random(20_000)
    rows = spark.createDataFrame([(0, float(x)) for x in 10 / 0.2 * (u**-0.2 - 1)], "g int, x double")
    fit = extremes.gpd_from_l_moments(extremes.l_moments(rows, ["g"], "x")).first()
    assert abs(fit.xi - 0.2) < 0.03 and abs(fit.scale - 10) < 0.5


def test_uniforms_are_uniform(spark):
    rows = spark.range(20_000).select(F.expr(simulation.uniform("id", "3", 1)).alias("u"), F.expr(simulation.normal("id", "3", 5)).alias("z"))
    got = rows.agg(F.avg("u").alias("m"), F.stddev("u").alias("s"), F.avg("z").alias("zm"), F.stddev("z").alias("zs"), F.min("u").alias("lo"), F.max("u").alias("hi")).first()
    assert abs(got.m - 0.5) < 0.01 and abs(got.s - 12**-0.5) < 0.01 and abs(got.zm) < 0.03 and abs(got.zs - 1) < 0.03 and 0 < got.lo < got.hi < 1


def test_empirical_rank_past_the_nonzero_years_is_zero(spark):
    annual = spark.createDataFrame([(1, 0, 0, 50.0), (2, 0, 0, 40.0)], "sim_year int, cell_row int, cell_col int, mm double")
    out = {r.rp: r.mm for r in simulation.empirical_levels(annual, 100, (10, 50, 100, 1000)).collect()}
    assert out == {10: 0.0, 50: 40.0, 100: 50.0, 1000: 50.0}


def test_reports_are_found_under_their_header(spark, tmp_path):
    from cellweave.sources.reports import read_reports

    (tmp_path / "a.csv").write_bytes("Préambule\nTime,Size,Location,Lat,Lon\n1830,125,Here,40.1,-100.2\n,100,x,bad,-100\n9,175,x,40,-100\n0100,0,x,40,-100\n0100,100,x,70,-100\n".encode("latin-1"))
    (tmp_path / "b.csv").write_text("nothing here\n")
    got = [(r.lat, r.lon, r.size_in, r.hour) for r in read_reports(spark, str(tmp_path)).orderBy("line").collect()]
    assert got == [(40.1, -100.2, 1.25, 18), (40.0, -100.0, 1.75, 9)]


def test_cell_days_round_trip_and_repair(spark, tmp_path):
    from cellweave.sources import sinks

    rows = [(D(2010, 1, 1), 0, 0, 10.0), (D(2011, 1, 1), 0, 1, 500.0), (D(2011, 1, 2), 0, 1, 20.0)]
    sinks.write_cell_days(cells(spark, rows), str(tmp_path / "a"))
    found = {r.year: (r.n, r.n_bad) for r in sinks.repair_cell_days(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()}
    assert found == {2010: (1, 0), 2011: (2, 1)}
    assert [r.mm for r in sinks.read_cell_days(spark, str(tmp_path / "b"), first=D(2011, 1, 1)).collect()] == [20.0]
    assert sinks.every_nth_day(cells(spark, rows), 2).count() == 2
    assert '"a":"1"' in sinks.run_manifest(spark, {"a": 1}).first().json


def test_stream_upsert_is_idempotent_by_version(spark, tmp_path):
    from cellweave.streaming import daily

    source = spark.createDataFrame([("2024-01-01 13:00:00", 0, 0, 5.0), ("2024-01-02 11:00:00", 0, 0, 9.0), ("2024-01-02 12:00:00", 0, 0, 400.0)], "s string, cell_row int, cell_col int, mm double").select(F.col("s").cast("timestamp").alias("ts"), "cell_row", "cell_col", "mm")
    source.write.parquet(str(tmp_path / "in"))
    stream = daily.daily_max_stream(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")))
    writer = daily.upsert_batches(stream, str(tmp_path / "cp"), str(tmp_path / "out"))
    writer.trigger(availableNow=True).start().awaitTermination()
    table = daily.read_upserts(spark, str(tmp_path / "out"), ["day", "cell_row", "cell_col"])
    assert {(r.day, r.mm) for r in table.collect()} == {(D(2024, 1, 1), 9.0), (D(2024, 1, 2), 0.0)}
    late = spark.createDataFrame([("2024-01-01 14:00:00", 0, 0, 50.0)], "s string, cell_row int, cell_col int, mm double").select(F.col("s").cast("timestamp").alias("ts"), "cell_row", "cell_col", "mm")
    late.write.mode("append").parquet(str(tmp_path / "in"))
    writer.trigger(availableNow=True).start().awaitTermination()
    table = daily.read_upserts(spark, str(tmp_path / "out"), ["day", "cell_row", "cell_col"])
    assert {(r.day, r.mm) for r in table.collect()} == {(D(2024, 1, 1), 50.0), (D(2024, 1, 2), 0.0)}
    table.write.parquet(str(tmp_path / "table"))
    daily.reprocess(spark, str(tmp_path / "table"), source, [D(2024, 1, 1)], str(tmp_path / "again"))
    assert {(r.day, r.mm) for r in spark.read.parquet(str(tmp_path / "again")).collect()} == {(D(2024, 1, 1), 9.0), (D(2024, 1, 2), 0.0)}


def test_trailing_frames_resume(spark):
    from cellweave.streaming import daily

    every = cells(spark, [(D(2024, 1, d), 0, 0, float(d)) for d in range(1, 31)])
    state = daily.trailing_frames(every.where("day <= date'2024-01-20'"), None)
    resumed = daily.trailing_frames(every.where("day >= date'2024-01-18'"), state)
    assert sorted(r.day.day for r in resumed.collect()) == list(range(10, 31))
    assert resumed.exceptAll(daily.trailing_frames(every, None)).isEmpty()


def listed_medians(targets, table, half, rows, cols):
    """A row for each cell of a window."""
    steps, clamp = F.sequence(F.lit(-half), F.lit(half)), lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1))
    around = targets.select("day", "cell_row", "cell_col", F.explode(steps).alias("dr")).select("*", F.explode(steps).alias("dc"))
    around = around.select("day", "cell_row", "cell_col", clamp(F.col("cell_row") + F.col("dr"), rows).alias("r"), clamp(F.col("cell_col") + F.col("dc"), cols).alias("c"))
    values = table.select("day", F.col("cell_row").alias("r"), F.col("cell_col").alias("c"), F.col("mm").alias("v"))
    return around.join(values, ["day", "r", "c"], "left").groupBy("day", "cell_row", "cell_col").agg(F.median(F.coalesce("v", F.lit(0.0))).alias("med"))


def test_echo_counts_over_tiles(spark):
    """Echoes of two volumes on the borders of tiles, and below the grid's lower corner."""
    import numpy as np

    from cellweave.operators import artefacts

    rng = np.random.default_rng(9)
    echo = {(int(v), int(k), int(j), int(i)) for v, k, j, i in zip(rng.integers(0, 2, 3000), rng.integers(0, 5, 3000), rng.integers(-3, 140, 3000), rng.integers(55, 75, 3000))}
    out = artefacts.echo_counts(spark.createDataFrame(sorted(echo), "vol int, k int, j int, i int"), 5).collect()
    step = (-1, 0, 1)
    assert {(r.vol, r.k, r.j, r.i): r.n for r in out} == {(v, k, j, i): sum((v, k + a, j + b, i + c) in echo for a in step for b in step for c in step) for v, k, j, i in echo}
    assert len(out) == len(echo)


def test_tiled_medians_are_the_listed_ones(spark, monkeypatch):
    import random

    from cellweave.operators import spatial

    monkeypatch.setattr(spatial, "SIDE", 16)

    rng = random.Random(7)
    rows = {(D(2013, 5, 1 + rng.randrange(2)), rng.randrange(90), rng.randrange(140)): float(rng.randrange(1, 90)) for _ in range(6000)}
    table = cells(spark, [(*k, v) for k, v in rows.items()])
    targets = table.where("mm > 60 or cell_row < 3 or cell_col > 137")
    for half in (1, 4, 12):
        tiled = spatial._tiled_medians(targets, table, half, 90, 140)
        listed = listed_medians(targets, table, half, 90, 140)
        assert tiled.count() == targets.count() and tiled.exceptAll(listed).isEmpty()


def test_quantiles_and_ranks_of_large_groups(spark):
    import numpy as np

    from cellweave.operators import extremes, ranks

    rng = np.random.default_rng(3)
    data = {"a": np.round(rng.gamma(2, 20, 500), 1), "b": rng.random(7) * 300, "c": np.array([5.0])}
    rows = spark.createDataFrame([(g, float(x)) for g, xs in data.items() for x in xs] + [("a", None)], "g string, x double")
    ps = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]
    for r in ranks.quantiles(rows, ["g"], "x", ps).collect():
        assert abs(r.q - np.quantile(data[r.g], ps[r.k])) < 1e-9
    some = rows.where("x is not null")
    wide, plain = ({r.g: r for r in extremes.l_moments(some, ["g"], "x", wide=w).collect()} for w in (True, False))
    assert set(wide) == set(plain) == {"a", "b"}
    assert all(abs(wide[g][c] - plain[g][c]) < 1e-9 for g in wide for c in ("n", "l1", "l2", "l_cv", "l_skew"))
