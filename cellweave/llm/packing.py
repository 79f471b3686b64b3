"""Packing: optimal length buckets by dynamic programming over the global histogram, token-budget batches inside each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import salted_rank, stash
from .mixing import row_salt, word_count


def _least_cuts(best: np.ndarray, edges: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For j = 1..n the least of best[i] + edges[j-1] * (total[j] - total[i]) over i < j, and the first i that has it.

    The first best i never falls as j grows, so the middle j halves the choices of those on either side: a level of
    halvings reads each i about twice, all of a level at once.
    """
    n = len(edges)
    new, cut = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    lo, hi, left, right = (np.array([x], np.int64) for x in (1, n, 0, n - 1))
    while len(lo):
        mid = (lo + hi) // 2
        end = np.minimum(right, mid - 1)
        size = end - left + 1
        heads = np.cumsum(size) - size
        i = np.arange(int(size.sum())) - np.repeat(heads - left, size)
        j = np.repeat(mid, size)
        cost = best[i] + edges[j - 1] * (total[j] - total[i])
        least = np.minimum.reduceat(cost, heads)
        at = np.minimum.reduceat(np.where(cost == np.repeat(least, size), i, n), heads)
        new[mid], cut[mid] = least, at
        lo, hi, left, right = np.concatenate([lo, mid + 1]), np.concatenate([mid - 1, hi]), np.concatenate([left, at]), np.concatenate([at, right])
        some = lo <= hi
        lo, hi, left, right = lo[some], hi[some], left[some], right[some]
    return new, cut


def optimal_bounds(edges: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Bucket upper bounds, among the distinct lengths ``edges``, that minimise the total of counts * bound; the last
    length is one. In 64-bit integers, exactly.

    best[j]: least padded size of the lengths up to the j-th in so many buckets; a bucket more is one ``_least_cuts``.
    """
    n = len(edges)
    if not n:
        return []
    edges, total = np.asarray(edges, np.int64), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    best = np.concatenate([[0], edges * total[1:]])
    back: list[np.ndarray] = []
    for _ in range(1, min(buckets, n)):
        best, cut = _least_cuts(best, edges, total)
        back.append(cut)
    out, j = [], n
    for cut in reversed(back):
        out.append(int(edges[j - 1]))
        j = int(cut[j])
        if not j:
            return out[::-1]
    return [int(edges[j - 1]), *out[::-1]]


def bucket_bounds(sized: DataFrame, length: str = "n_tokens", buckets: int = 16) -> list[int]:
    """Bounds from the histogram of all rows by their exact length.

    The driver gets a row a distinct length; D of them take a corpus of D * D / 2 tokens at least, and 16 bytes each.
    """
    rows = sorted(map(tuple, sized.groupBy(F.col(length).alias("edge")).agg(F.count(F.lit(1)).alias("n")).collect()))
    return optimal_bounds(np.array([e for e, _ in rows]), np.array([c for _, c in rows]), buckets)


#: Columns that ``pack`` adds.
ADDED = ("bucket", "bucket_len", "batch_id", "slot")


def pack(sized: DataFrame, length: str = "n_tokens", buckets: int = 16, budget: int = 8192) -> DataFrame:
    """``sized`` with bucket, bucket_len, batch_id and slot: padded to bucket_len, a batch has at most ``budget`` tokens.

    A bucket longer than the budget has batches of one row, so every row is kept whole. Rows are numbered inside a
    bucket by a hash of the doc_id, then doc_id and length, without a task seeing the bucket. Null or negative lengths
    count as 0, null doc_ids come first; ties and repeated rows take a slot each; an empty table stays empty. The
    columns of ``sized`` stay as they are; an added column whose name one of them has, in whatever case, is called
    pack_bucket and so on.
    """
    taken = {c.lower() for c in sized.columns}
    names = {c: f"pack_{c}" if c in taken else c for c in ADDED}
    kept = [c for c in sized.columns if c != length]
    clean = sized.select(F.col("doc_id").cast("long").alias("_doc"), F.greatest(F.coalesce(F.col(length), F.lit(0)), F.lit(0)).cast("long").alias("_len"), F.struct(*kept).alias("_row") if kept else F.lit(None).alias("_row"))
    bounds = bucket_bounds(clean, "_len", buckets) or [0]
    edges = F.array(*map(F.lit, bounds))
    # one comparison a bound, so that generated code computes an expensive length once
    bucket = sum((F.when(F.col("_len") > b, 1).otherwise(0) for b in bounds), F.lit(0)).cast("int")
    placed = clean.withColumn("_bucket", bucket).withColumn("_bound", F.element_at(edges, F.col("_bucket") + 1).cast("long"))
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("_bound"), F.lit(1)))).cast("long")
    ranked = salted_rank(placed, ["_bucket"], [], row_salt("_doc", "_row"), ["_doc", "_len"], "_rank")
    added = (F.col("_bucket"), F.col("_bound"), F.floor(F.col("_rank") / capacity).cast("long"), F.pmod(F.col("_rank"), capacity).cast("int"))
    own = [F.col("_len").alias(c) if c == length else F.col(f"_row.`{c}`") for c in sized.columns]
    return ranked.select(*own, *(x.alias(names[c]) for x, c in zip(added, ADDED, strict=True)))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(stash(docs.select("doc_id", word_count().alias("n_tokens")), "lengths"))
