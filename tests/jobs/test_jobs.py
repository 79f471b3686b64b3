"""The jobs over growing input, after failures, from the command line, and against their SQL."""

import datetime as dt
import json
import os
import shutil
import subprocess
import sys

import pytest


SF = "/root/testdata/sf0.001"


def rows_of(frame):
    return sorted(tuple(map(str, r)) for r in frame.collect())


def files_of(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")
@pytest.mark.parametrize("name", ["job1_hazard_update", "job2_page_catalog"])
def test_job_matches_sql(spark, name):
    import duckdb
    import pandas as pd

    from jobs import registered

    before = dict(spark.conf.getAll)
    con = duckdb.connect()
    for t in ("lineitem", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = (x[sorted(x.columns)] for x in (registered.QUERIES[name](spark, SF).toPandas(), con.sql(registered.SQL[name]).df()))
    texts = [c for c in got.columns if got[c].dtype == object]
    got, want = (x.sort_values([*texts, *(c for c in x.columns if c not in texts)]).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-6, rtol=1e-9)
    assert before == dict(spark.conf.getAll)
    assert registered.new_folder(spark, name) != registered.new_folder(spark, name)


OBSERVATIONS = "seq long, ts timestamp, r int, c int, mm double"
SETTINGS = {"arrived": "seq", "day": "to_date(ts - interval 12 hours)", "cell_row": "r", "cell_col": "c", "mm": "mm", "periods": [10, 100]}


def observations(seed, first, n, years):
    import random

    rng = random.Random(seed)
    return [(first + i // 3, dt.datetime(rng.choice(years), rng.randrange(1, 13), rng.randrange(2, 28), rng.randrange(24)), rng.randrange(3), rng.randrange(3), rng.choice([rng.uniform(1, 120), 500.0, float("nan"), None])) for i in range(n)]


@pytest.fixture
def archive(spark, tmp_path):
    with open(tmp_path / "settings.json", "w") as f:
        json.dump(SETTINGS, f)

    def add(rows):
        spark.createDataFrame(rows, OBSERVATIONS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def update(out="out"):
        from jobs.hazard_update import run

        return run(spark, f"{tmp_path}/in", f"{tmp_path}/{out}", f"{tmp_path}/settings.json")

    return add, update, tmp_path


def test_updates_take_only_what_is_new(spark, archive):
    from jobs.hazard_update import output

    add, update, path = archive
    add(observations(1, 0, 900, range(2000, 2008)) + [(0, None, 1, 1, 50.0), (None, dt.datetime(2001, 5, 5), 1, 1, 299.0)])
    first = update()
    assert first["n_rows"] == 900 and first["since"] == -1 and first["mark"] == 299
    kept = files_of(path / "out")
    assert update() == {"mark": 299, "n_rows": 0} and files_of(path / "out") == kept
    add(observations(2, 300, 60, [2003, 2009]))  # late rows of 2003 and a new year
    second = update()
    assert (second["n_rows"], second["since"], second["mark"]) == (60, 299, 319)
    untouched = {f for f in kept if "/annual_max/" in f and "year=2003" not in f and "_SUCCESS" not in f and ".crc" not in f}
    assert untouched and untouched <= set(files_of(path / "out"))
    whole = update("whole")
    assert whole["n_rows"] == 960
    assert rows_of(output(spark, f"{path}/out")) == rows_of(output(spark, f"{path}/whole"))
    assert {r.what for r in output(spark, f"{path}/out").collect()} == {"day", "year", "level"}


@pytest.mark.parametrize("table", ["cell_day", "annual_max", "level", "run"])
def test_an_update_that_died_is_repeated(spark, archive, monkeypatch, table):
    """It dies before it writes ``table``; meanwhile more arrives; the next run ends as if nothing had happened."""
    from jobs import hazard_update as H

    add, update, path = archive
    add(observations(3, 0, 600, range(2000, 2006)))
    update()
    add(observations(4, 200, 90, [2001, 2006]))
    put = H.put

    def dies(rows, to, *parts, **how):
        if to.endswith(f"/{table}"):
            raise RuntimeError("lost")
        return put(rows, to, *parts, **how)

    monkeypatch.setattr(H, "put", dies)
    with pytest.raises(RuntimeError):
        update()
    monkeypatch.setattr(H, "put", put)
    add(observations(5, 230, 30, [2002]))
    assert update()["n_rows"] == 120
    update("whole")
    assert rows_of(H.output(spark, f"{path}/out")) == rows_of(H.output(spark, f"{path}/whole"))


def test_scans_read_what_is_new_and_the_years_it_touches(spark, archive, capsys):
    from jobs import hazard_update as H
    from jobs.common import config

    add, update, path = archive
    add(observations(7, 0, 300, [2000, 2001, 2002]))
    update()
    rows = H.observed(spark.read.parquet(f"{path}/in"), config(f"{path}/settings.json", "hazard_update.json"))
    rows.where("arrived > 40").explain("formatted")
    assert "GreaterThan(seq,40)" in capsys.readouterr().out
    H.cell_days(spark, f"{path}/out").where("year in (2001)").explain("formatted")
    assert "PartitionFilters: [isnotnull(year" in capsys.readouterr().out


def test_falling_levels_are_counted(spark):
    from jobs.hazard_update import LEVEL, falls

    rows = [(0, 0, 10.0, 10), (0, 0, 9.7, 50), (0, 0, 20.0, 100), (0, 1, 30.0, 10), (0, 1, 29.0, 50), (1, 1, None, 10)]
    assert falls(spark.createDataFrame(rows, LEVEL)) == 1 and falls(spark.createDataFrame([], LEVEL)) == 0


def test_an_update_of_nothing(spark, archive):
    from jobs.hazard_update import output

    add, update, path = archive
    add([])
    assert update() == {"mark": None, "n_rows": 0} and output(spark, f"{path}/out").collect() == []


def test_unknown_settings_are_refused(tmp_path):
    from jobs.common import config

    (tmp_path / "s.json").write_text('{"thresh": 3}')
    with pytest.raises(ValueError, match="thresh"):
        config(str(tmp_path / "s.json"), "hazard_update.json")


HTML = {
    1: ("http://A.example.com/y/2020/index.html", '<a href="mesh_20200501-120500.netcdf.gz#x">n</a> <A class=k HREF=\'../up.csv\'>u</A><a href="#top">t</a><a href="mailto:x@y">m</a>'),
    2: ("http://a.example.com", '<a href="/y/">y</a><a href="/y/">y</a><a href="//b.example.org/d.GRIB2?v=1&amp;w=2">g</a><a href="HTTPS://B.example.org/d.nc">n</a>'),
    3: ("http://a.example.com/z?page=2", "no links at all"),
    4: ("http://c.example.com/", None),
    5: (None, '<a href="/lost">l</a><a href="https://d.example.net/x20200501T010203Z">k</a>'),
    6: ("http://a.example.com/y/2020/", '<a href="?page=3">more</a><a href="/y/">y</a>'),
}


def test_pages_and_targets(spark):
    from jobs import page_catalog as P

    pages = spark.createDataFrame([(i, *x) for i, x in HTML.items()], P.PAGES)
    kinds = {"netcdf": [".nc", ".netcdf.gz"], "grib": [".grib2"], "table": [".csv"], "page": ["/"]}
    got = {r.target: (r.host, r.kind, r.first_page, r.n_refs, str(r.ts)) for r in P.target_rows(pages, kinds).collect()}
    assert got == {
        "http://a.example.com/y/2020/mesh_20200501-120500.netcdf.gz": ("a.example.com", "netcdf", 1, 1, "2020-05-01 12:05:00"),
        "http://a.example.com/y/2020/../up.csv": ("a.example.com", "table", 1, 1, "None"),
        "http://a.example.com/y/": ("a.example.com", "page", 2, 3, "None"),
        "http://b.example.org/d.GRIB2?v=1&w=2": ("b.example.org", "grib", 2, 1, "None"),
        "https://b.example.org/d.nc": ("b.example.org", "netcdf", 2, 1, "None"),
        "https://d.example.net/x20200501T010203Z": ("d.example.net", "other", 5, 1, "2020-05-01 01:02:03"),
        "http://a.example.com/y/2020/?page=3": ("a.example.com", "page", 6, 1, "None"),
    }
    assert {r.page_id: (r.status, r.n_links, r.host) for r in P.page_rows(pages).collect()} == {1: ("ok", 4, "a.example.com"), 2: ("ok", 4, "a.example.com"), 3: ("no_links", 0, "a.example.com"), 4: ("unreadable", 0, "c.example.com"), 5: ("ok", 2, None), 6: ("ok", 2, "a.example.com")}


@pytest.fixture
def landed(spark, tmp_path):
    def land(*ids):
        from jobs.page_catalog import PAGES

        spark.createDataFrame([(i, *HTML[i]) for i in ids], PAGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def catalog(out="out"):
        from jobs.page_catalog import run

        return run(spark, f"{tmp_path}/in", f"{tmp_path}/{out}", f"{tmp_path}/{out}-checkpoint")

    return land, catalog, tmp_path


def test_the_stream_takes_only_new_files(spark, landed):
    from jobs.page_catalog import output

    land, catalog, path = landed
    land(1, 2, 4)
    assert catalog() == {"batches": 1, "pages": 3, "targets": 5}
    once = rows_of(output(spark, f"{path}/out"))
    assert catalog() == {"batches": 0, "pages": 0, "targets": 0} and rows_of(output(spark, f"{path}/out")) == once
    land(3, 5, 6)
    assert catalog() == {"batches": 1, "pages": 3, "targets": 2}
    catalog("whole")
    names = lambda out: sorted((r.what, str(r.name), r.kind, str(r.first_page)) for r in output(spark, f"{path}/{out}").collect())
    assert names("out") == names("whole")
    hosts = {r.name: (r.kind, r.n) for r in output(spark, f"{path}/out").where("what = 'host'").collect()}
    assert hosts == {"a.example.com": ("ok", 4), "c.example.com": ("error", 1), None: ("ok", 1)}


def test_a_batch_that_was_not_finished_is_repeated(spark, landed):
    """The last batch's commit is lost after its writes: it runs again and leaves the same tables."""
    from jobs.page_catalog import output

    land, catalog, path = landed
    land(1, 2)
    catalog()
    land(5, 6)
    catalog()
    once = rows_of(output(spark, f"{path}/out"))
    for f in files_of(path / "out-checkpoint" / "commits"):
        if os.path.basename(f) in ("1", ".1.crc"):
            shutil.move(f, tmp := path / os.path.basename(f).replace(".", "lost"))
            assert os.path.exists(tmp)
    assert catalog()["batches"] == 1 and rows_of(output(spark, f"{path}/out")) == once


def called(job, *options):
    """The counts that a job's command line prints, and its log."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", *options], cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return json.loads(done.stdout.strip().splitlines()[-1]), done.stderr


def test_command_line_of_the_update(spark, archive):
    add, _, path = archive
    add(observations(6, 0, 200, [2000, 2001]))
    counts, log = called("hazard_update", "--observations", f"{path}/in", "--out", f"{path}/cli", "--config", f"{path}/settings.json")
    assert counts["n_rows"] == 200 and "200 new rows" in log and f"to {path}/cli/level by rp" in log


def test_command_line_of_the_catalog(spark, landed):
    land, _, path = landed
    land(1, 2)
    counts, log = called("page_catalog", "--pages", f"{path}/in", "--out", f"{path}/cli", "--checkpoint", f"{path}/mark")
    assert counts == {"batches": 1, "pages": 2, "targets": 5} and "read 2 pages" in log and f"to {path}/cli/target by batch, kind" in log
