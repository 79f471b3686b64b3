"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, row_hash, salted_rank, stash, whole


def word_count(column: str = "text") -> Column:
    return F.regexp_count(whole(column), F.lit(WORD)).cast("long")


def size_band(size: str) -> Column:
    """Bit length and three leading bits of a size: sizes in a band differ by an eighth at most."""
    bits = F.bin(size)
    return F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 1, 4))


def doc_salt(column: str = "doc_id") -> Column:
    return F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit(""))), 1, 2)


def row_salt(doc_id: str, *columns: str) -> Column:
    """``doc_salt``, and for rows without a doc_id one by a hash of other columns, so that they don't share a cell."""
    return F.when(F.col(doc_id).isNotNull(), doc_salt(doc_id)).otherwise(F.lpad(F.hex(F.pmod(row_hash(*columns), F.lit(256))), 2, "0"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size): ``share`` of all sizes dealt out by weight, a target
    at most ``most`` times its source's size and the excess dealt again by weight until none is above.

    That is the level x with sum(min(cap, x * weight)) = total: with sources in order of cap / weight, the first whose
    own level reaches x and all after it are uncapped. The window holds one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.select("source", "source_size", weight.cast("double").alias("w"), (F.col("source_size") * most).cast("double").alias("cap"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rows = rows.select("*", (F.sum("source_size").over(everything) * F.lit(float(share))).alias("total"), F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("capped"), F.sum("w").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("rest"))
    rows = rows.withColumn("level", F.greatest((F.col("total") - F.col("capped")) / F.col("rest"), F.lit(0.0)))
    free = F.min(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.struct((F.col("cap") / F.col("w")).alias("r"), "level"))).over(everything)
    return rows.select("source", "source_size", F.coalesce(F.least("cap", free["level"] * F.col("w")), F.col("cap")).alias("target"))


def copies(docs: DataFrame, seed: int = 20, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """``docs`` (which has ``source``, ``doc_id`` and ``size``) with source_size, target and copies.

    A document's expected copies are target / source_size. Along a source, ordered by size band, a hash of the doc_id,
    size and doc_id, the prefix sums of expected copies plus one random offset cross an integer copies times; ordering
    by size keeps the words taken near the target. The offset comes from an MD5 of seed and source, so reruns agree.
    Sources of no words, and empty documents' words, count 0. Null sources form one source, null doc_ids one id. Equal
    rows are drawn one by one; an empty table gives no rows. Columns beyond those used are kept.
    """
    thin = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = stash(targets(thin, weights, share, most), "mix-targets").withColumnRenamed("source", "_source")
    banded = docs.withColumn("_band", size_band("size"))
    ranked = salted_rank(banded, ["source"], ["_band"], doc_salt(), ["size", "doc_id"], "_rank")
    joined = ranked.join(F.broadcast(goal) if goal.count() <= 10_000 else goal, F.col("source").eqNullSafe(F.col("_source")), "left")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    offset = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    crossed = F.floor((F.col("_rank") + 1) * expected + offset) - F.floor(F.col("_rank") * expected + offset)
    return joined.withColumn("copies", crossed.cast("int")).drop("_source", "_band", "_rank")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: each document as often as drawn, with the columns of ``docs``, whatever their names.

    A null or empty text has size 0; null sources and doc_ids, repeated rows and empty tables are as in ``copies``.
    """
    rows = copies(docs.select("doc_id", "source", word_count().alias("size"), F.struct(*docs.columns).alias("_row")), **how)
    return rows.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("_row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = stash(docs.select("doc_id", "source", word_count().alias("size")), "mix-sizes")
    rows = copies(sized)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS w, CAST(source_size * 3 AS DOUBLE) AS cap FROM sources),
levels AS (
  SELECT *, greatest((CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level FROM weighed),
goals AS (
  SELECT source, source_size, least(cap, (SELECT arg_min(level, cap / w) FROM levels WHERE cap >= level * w) * w) AS target FROM levels),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY
    lpad(CAST(length(bin(size)) AS VARCHAR), 2, '0') || substr(bin(size), 1, 4), substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 2), size, doc_id) - 1 AS r FROM sized),
drawn AS (
  SELECT k.doc_id, k.source, k.size, g.source_size, g.target, k.r,
    CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS e,
    CAST(CAST('0x' || substr(md5('20:' || coalesce('s' || k.source, 'n')), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM ranked k JOIN goals g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(CAST(floor((r + 1) * e + u) - floor(r * e + u) AS BIGINT) * size AS BIGINT) AS taken,
  source, CAST(floor((r + 1) * e + u) - floor(r * e + u) AS INTEGER) AS copies FROM drawn
"""
