"""Reads newly landed catalogue pages and plans what they point at, each target once.

    python -m jobs.page_catalog --pages PATH --out PATH --checkpoint PATH [--config FILE]

Archives are published as trees of HTML listings. Pages (page_id, url, html) land as Parquet files; the job streams
the files it has not seen, follows no link itself, and leaves under ``out``

- ``page/batch=``: a row a page with its host, size, links and status;
- ``target/batch=/kind=``: every target that a page of the batch links to and no earlier batch did: its kind by suffix,
  the time that its name holds, the least page_id that has it and the number of links in the batch;
- ``host/status=``: pages, pages with links and unreadable pages of each host with the status of that, made again from
  all pages when the stream has ended.

The stream's checkpoint says which files are done. A batch writes the partitions of its own number, so one that is run again
after a failure overwrites itself; what earlier batches planned is looked up in batches of smaller number only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.clock import name_time
from cellweave.functions.quality import day_status
from jobs.common import command, config, log, put, stored

PAGES = "page_id long, url string, html string"
PAGE = "page_id long, url string, host string, n_chars long, n_links long, status string, batch long"
TARGET = "target string, host string, ts timestamp_ntz, first_page long, n_refs long, batch long, kind string"
HOST = "host string, first_page long, n_pages long, n_linking long, n_unreadable long, status string"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""


def base(url: Column) -> Column:
    """Scheme and host of an absolute address, in lower case; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)), F.lit(""))


def host(url: Column) -> Column:
    return F.regexp_replace(base(url), r"^[^/]*//", "")


def resolved(url: Column, link: Column) -> Column:
    """The address that ``link`` means on the page ``url``, without its fragment; null for other schemes, links within the
    page and relative ones on a page without address."""
    link = F.trim(F.regexp_replace(F.regexp_replace(link, "#.*$", ""), "&amp;", "&"))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", "")
    return (
        F.when(link == "", None)
        .when(link.rlike(r"^(?i)https?://"), F.concat(base(link), F.regexp_replace(link, r"^[^/]*//[^/?#]*", "")))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base(url), "^[^/]*", 0), link))
        .when(link.startswith("/"), F.concat(base(url), link))
        .when(link.startswith("?"), F.concat(base(url), path, link))
        .otherwise(F.concat(base(url), folder, link))
    )


def kind(target: Column, kinds: dict[str, list[str]]) -> Column:
    """The first kind that has a suffix of the target's path, in any case; ``other`` without one."""
    path = F.lower(F.regexp_replace(target, r"\?.*$", ""))
    out = F
    for name, suffixes in kinds.items():
        fits = F.lit(False)
        for s in suffixes:
            fits = fits | path.endswith(s)
        out = out.when(fits, name)
    return out.otherwise("other") if kinds else F.lit("other")


def page_rows(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, n_chars, n_links, status) of each page; one without HTML is unreadable."""
    n = F.size(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).cast("long")
    unreadable = F.trim(F.coalesce("html", F.lit(""))) == ""
    status = F.when(unreadable, "unreadable").when(n == 0, "no_links").otherwise("ok")
    return pages.select("page_id", "url", host(F.col("url")).alias("host"), F.coalesce(F.length("html"), F.lit(0)).cast("long").alias("n_chars"), n.alias("n_links"), status.alias("status"))


def target_rows(pages: DataFrame, kinds: dict[str, list[str]]) -> DataFrame:
    """(target, host, ts, first_page, n_refs, kind) of what the pages link to, a row a target; links of one page count each."""
    links = pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("link"))
    named = links.select("page_id", resolved(F.col("url"), F.col("link")).alias("target")).where("target is not null")
    found = named.groupBy("target").agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n_refs"))
    name = F.regexp_extract("target", r"[^/]*$", 0)
    return found.select("target", host(F.col("target")).alias("host"), name_time(name).cast("timestamp_ntz").alias("ts"), "first_page", "n_refs", kind(F.col("target"), kinds).alias("kind"))


def host_rows(pages: DataFrame) -> DataFrame:
    """(host, first_page, n_pages, n_linking, n_unreadable, status): the status of a source day, a host's pages as its files."""
    counts = pages.groupBy("host").agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("status") == "ok").alias("n_linking"), F.count_if(F.col("status") == "unreadable").alias("n_unreadable"))
    return counts.withColumn("status", day_status(F.col("n_pages"), F.col("n_linking"), F.col("n_unreadable")))


def run(spark: SparkSession, pages: str, out: str, checkpoint: str, settings: str | None = None) -> dict:
    """Take all files that landed since the last run; returns the batches' counts."""
    chosen = config(settings, "page_catalog.json")
    counts = {"batches": 0, "pages": 0, "targets": 0}

    def batch(rows: DataFrame, number: int) -> None:
        session = rows.sparkSession
        tag = F.lit(number).cast("long")
        counts["pages"] += put(page_rows(rows).withColumn("batch", tag), f"{out}/page", "batch")
        planned = stored(session, f"{out}/target", TARGET, "batch", "kind").where(F.col("batch") < number)
        new = target_rows(rows, chosen["kinds"]).join(planned.select("target"), "target", "left_anti")
        counts["targets"] += put(new.withColumn("batch", tag), f"{out}/target", "batch", "kind")
        counts["batches"] += 1
        log.info("batch %d of %s is done", number, pages)

    reader = spark.readStream.schema(PAGES)
    if chosen["files_per_batch"]:
        reader = reader.option("maxFilesPerTrigger", chosen["files_per_batch"])
    query = reader.parquet(pages).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %d pages of %s in %d batches", counts["pages"], pages, counts["batches"])
    hosts = host_rows(stored(spark, f"{out}/page", PAGE, "batch"))
    hosts.hint("rebalance", "status").write.mode("overwrite").partitionBy("status").parquet(f"{out}/host")
    log.info("wrote %s", f"{out}/host")
    return counts


def output(spark: SparkSession, out: str) -> DataFrame:
    """(what, name, host, kind, time, first_page, n): pages by address with their links, targets with their links and the time in
    their name, empty without one, hosts with their pages; kind is the status of pages and hosts."""
    no_time = F.lit("").alias("time")
    pages = stored(spark, f"{out}/page", PAGE, "batch").select(F.lit("page").alias("what"), F.col("url").alias("name"), "host", F.col("status").alias("kind"), no_time, F.col("page_id").alias("first_page"), F.col("n_links").alias("n"))
    time = F.coalesce(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    targets = stored(spark, f"{out}/target", TARGET, "batch", "kind").select(F.lit("target").alias("what"), F.col("target").alias("name"), "host", "kind", time.alias("time"), "first_page", F.col("n_refs").alias("n"))
    hosts = stored(spark, f"{out}/host", HOST, "status").select(F.lit("host").alias("what"), F.col("host").alias("name"), "host", F.col("status").alias("kind"), no_time, "first_page", F.col("n_pages").alias("n"))
    return pages.unionByName(targets).unionByName(hosts)


if __name__ == "__main__":
    command("page_catalog", __doc__.split("\n")[0], {"pages": "folder of Parquet files of pages, or a pattern of files", "out": "folder of the plan", "checkpoint": "folder of the stream's checkpoint"}, run)
