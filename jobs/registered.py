"""The jobs as queries: each runs its function twice over a whole table into one new folder and reads the output back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.plans import extremes as plans
from cellweave.plans.climate import ANNUAL, YEARS
from jobs import hazard_update, page_catalog
from jobs.common import config


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for each call, where all executors reach it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="cellweave-")
    return f"{shared.rstrip('/')}/jobs/{name}-{uuid.uuid4().hex}"


def job1_hazard_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive that an update and a second one, which finds nothing new, make of all of ``lineitem``."""
    out = new_folder(spark, "hazard_update")
    for _ in range(2):
        hazard_update.run(spark, f"{sf_dir}/lineitem.parquet", out)
    found = hazard_update.output(spark, out)
    digits = F.when(F.col("what") == "level", F.round("mm", 4)).otherwise(F.round("mm", 6))
    return found.withColumn("mm", digits)


def job2_page_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run of the stream over all of ``pages`` and a second one, which finds no new file, leave.

    The path is a pattern, because a stream takes a folder or a pattern and the table may be a single file.
    """
    out = new_folder(spark, "page_catalog")
    for _ in range(2):
        page_catalog.run(spark, f"{sf_dir}/pages*.parquet", f"{out}/out", f"{out}/checkpoint")
    return page_catalog.output(spark, f"{out}/out")


def _job1_sql() -> str:
    chosen = config(None, "hazard_update.json")
    raw = chosen["mm"].replace("310", "310e0")
    days = f"""cell_day AS (SELECT day, cell_row, cell_col, max(CASE WHEN raw IS NULL OR isnan(raw) OR raw < 0 OR raw > 300 THEN 0e0 ELSE raw END) AS mm
    FROM (SELECT CAST(l_shipdate AS DATE) AS day, {chosen['cell_row']} AS cell_row, {chosen['cell_col']} AS cell_col, {raw} AS raw FROM lineitem WHERE l_orderkey IS NOT NULL)
    WHERE day IS NOT NULL AND cell_row IS NOT NULL AND cell_col IS NOT NULL GROUP BY ALL HAVING mm > 0)"""
    ctes = ", ".join([days, ANNUAL, YEARS, plans.BODY, plans.TAIL, plans.PARAMETERS, plans.levels_sql(chosen["periods"])])
    return f"""WITH {ctes} SELECT 'day' AS what, CAST(day AS VARCHAR) AS "at", cell_row, cell_col, round(mm, 6) AS mm FROM cell_day
  UNION ALL SELECT 'year', CAST(year AS VARCHAR), cell_row, cell_col, round(mm, 6) FROM annual
  UNION ALL SELECT 'level', CAST(rp AS VARCHAR), cell_row, cell_col, round(mm, 4) FROM levels"""


def _job2_sql() -> str:
    base = "lower(regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1))"
    host = "regexp_replace({0}, '^[^/]*//', '')"
    link = page_catalog.LINK.replace("'", "''")
    kinds = " ".join(f"WHEN {' OR '.join(f'''ends_with(path, '{s}')''' for s in suffixes)} THEN '{name}'" for name, suffixes in config(None, "page_catalog.json")["kinds"].items())
    return f"""WITH found AS (SELECT page_id, url, coalesce(html, '') AS html, regexp_extract_all(coalesce(html, ''), '{link}', 1) AS links,
    nullif({base.format('url')}, '') AS base, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1) AS path FROM pages),
  listed AS (SELECT page_id, base, path, regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '') AS folder,
    trim(replace(regexp_replace(unnest(links), '#.*$', ''), '&amp;', '&')) AS link FROM found),
  named AS (SELECT page_id, CASE WHEN link = '' THEN NULL
      WHEN regexp_matches(link, '^(?i)https?://') THEN {base.format('link')} || regexp_replace(link, '^[^/]*//[^/?#]*', '')
      WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
      WHEN starts_with(link, '//') THEN regexp_extract(base, '^[^/]*') || link
      WHEN starts_with(link, '/') THEN base || link
      WHEN starts_with(link, '?') THEN base || path || link
      ELSE base || folder || link END AS target FROM listed),
  targets AS (SELECT target, {host.format(base.format('target'))} AS host, min(page_id) AS first_page, count(*) AS n, lower(regexp_replace(target, '\\?.*$', '')) AS path,
    regexp_extract(regexp_extract(target, '[^/]*$'), '(\\d{{8}})[T-](\\d{{6}})Z?', 1) || regexp_extract(regexp_extract(target, '[^/]*$'), '(\\d{{8}})[T-](\\d{{6}})Z?', 2) AS t
    FROM named WHERE target IS NOT NULL GROUP BY target),
  pages_ AS (SELECT page_id, url, {host.format('base')} AS host, CASE WHEN trim(html) = '' THEN 'unreadable' WHEN len(links) = 0 THEN 'no_links' ELSE 'ok' END AS status, len(links) AS n FROM found),
  hosts AS (SELECT host, min(page_id) AS first_page, count(*) AS n, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'unreadable') AS bad FROM pages_ GROUP BY host)
SELECT 'page' AS what, url AS name, host, status AS kind, '' AS time, page_id AS first_page, CAST(n AS BIGINT) AS n FROM pages_
UNION ALL SELECT 'target', target, host, CASE {kinds} ELSE 'other' END, coalesce(strftime(try_strptime(t, '%Y%m%d%H%M%S'), '%Y-%m-%d %H:%M:%S'), ''), first_page, n FROM targets
UNION ALL SELECT 'host', host, host, CASE WHEN bad >= n THEN 'error' WHEN bad > 0 AND ok > 0 THEN 'ok_with_read_errors' WHEN bad > 0 THEN 'no_hail_pixels_with_read_errors' WHEN ok = 0 THEN 'no_hail_pixels' ELSE 'ok' END, '', first_page, n FROM hosts"""


QUERIES = {"job1_hazard_update": job1_hazard_update, "job2_page_catalog": job2_page_catalog}
SQL = {"job1_hazard_update": _job1_sql(), "job2_page_catalog": _job2_sql()}
