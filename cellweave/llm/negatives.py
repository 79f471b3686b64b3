"""Hard-negative mining over one-dimensional distance keys.

Largest inner product becomes nearest in Euclidean distance by one more coordinate, which gives all vectors the same norm.
The index stores these augmented vectors sorted by (pivot, distance to the pivot) and cut into annuli, ranges of distance
around a pivot, of bounded blocks. By the triangle inequality whatever is within r of a query lies, at every pivot, in the
keys within r of the query's own distance. So a search scans the annuli that meet this interval, takes the bound that the
best found give, and widens the interval until no annulus left can hold anything better: results are exact.

Components are integers, so scores are; they are computed in double precision where all sums are below 2^53, else in
Python's integers. Distances only choose annuli, with slack for their rounding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_count, stash

#: Vectors that pivots are fitted on, at most: those whose vec_id has the least hash. Every vector is indexed.
SAMPLE = 20_000
PIVOTS, ANNULI, BLOCK = 32, 32, 512
#: Rows of the first annuli scanned, and how much wider a search gets that found too little for a bound.
FIRST, WIDER = 4 * BLOCK, 16
#: Searches that visit a copy of a block, about.
VISITS = 50_000
#: Bytes of blocks a task gets, about.
TASK = 64 << 20
SLACK = 1e-9
_LEAST = np.iinfo(np.int64).min
_MOST = np.iinfo(np.int64).max


def quantized(x: Column, scale: int) -> Column:
    """floor(scale * x) of an array's components as longs; beyond a long the nearest one."""
    return F.transform(x.cast("array<double>"), lambda v: F.floor(v * scale).cast("long"))


def usable(rows: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, label, v, d): a row a vec_id, v of integers, d its length."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.coalesce(F.size(x), F.lit(0)) > 0) & F.coalesce(finite, F.lit(False)))
    one = good.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("long").alias("label"), quantized(x, scale).alias("v")).alias("r"))
    return one.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.v", F.size("r.v").alias("d"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, d)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(len(a), len(b)) integer inner products as longs; beyond a long the nearest one."""
    top = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if top(a) * top(b) * a.shape[1] < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, -_MOST, _MOST).astype(np.int64).reshape(len(a), len(b))


class Space:
    """The augmented space of the vectors of one length: its unit, largest norm and pivots, then its annuli."""

    def __init__(self, d: int, top: float, squared: float, sample: np.ndarray, seed: int = 11):
        self.d, self.unit = d, 2.0 ** -np.frexp(top)[1]
        self.squared = squared * self.unit**2
        self.pivots = fitted(self.lift(sample), seed) if len(sample) else np.zeros((1, d + 1))
        self.numbers = self.low = self.high = self.sizes = self.at = np.zeros(0)

    def lift(self, v: np.ndarray) -> np.ndarray:
        x = v * self.unit
        return np.column_stack([x, np.sqrt(np.maximum(self.squared - np.einsum("nd,nd->n", x, x), 0))])

    def from_pivots(self, x: np.ndarray) -> np.ndarray:
        squares = np.einsum("nd,nd->n", x, x)[:, None] + np.einsum("nd,nd->n", self.pivots, self.pivots) - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(squares, 0))

    def keys(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of stored vectors and the distance to it."""
        apart = self.from_pivots(self.lift(v))
        near = apart.argmin(1)
        return near, apart[np.arange(len(v)), near]

    def asked(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of queries: how far each annulus is at least (rows, annuli), and the squared norm."""
        x = np.column_stack([v * self.unit, np.zeros(len(v))])
        own = self.from_pivots(x)[:, self.at]
        return np.maximum(np.maximum(own - self.high, self.low - own), 0), np.einsum("nd,nd->n", x, x)

    def reach(self, norm: float, score: int) -> float:
        """A radius that holds all vectors of this score or a higher one."""
        return float(np.sqrt(max(norm + self.squared - 2 * float(score) * self.unit**2, 0)) * (1 + SLACK) + SLACK * np.sqrt(norm + self.squared) + SLACK)


def fitted(x: np.ndarray, seed: int, rounds: int = 8) -> np.ndarray:
    """At most ``PIVOTS`` means of the rows, by Lloyd's rounds."""
    means = x[np.random.default_rng(seed).permutation(len(x))[:PIVOTS]]
    for _ in range(rounds):
        near = (np.einsum("nd,nd->n", means, means) - 2 * x @ means.T).argmin(1)
        n = np.bincount(near, minlength=len(means))
        sums = np.zeros_like(means)
        np.add.at(sums, near, x)
        means = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], means)
    return np.unique(means, axis=0)


def spaces(vectors: DataFrame) -> dict[int, Space]:
    """The space of each length: extents from all vectors, pivots from the sample."""

    def extent(batches):
        for batch in batches:
            lengths = batch.column(1).to_numpy()
            for d in np.unique(lengths).tolist():
                v = _matrix(batch.filter(pa.array(lengths == d)).column(0), d).astype(float)
                with np.errstate(over="ignore"):
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (d, float(np.abs(v).max()), float(np.einsum("nd,nd->n", v, v).max()))], names=["d", "top", "squared"])

    sizes = vectors.select("v", "d").mapInArrow(extent, "d long, top double, squared double").groupBy("d").agg(F.max("top").alias("top"), F.max("squared").alias("squared")).collect()
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v", "d").toArrow()
    lengths = sample.column("d").to_numpy()
    return {r.d: Space(r.d, r.top, r.squared, _matrix(sample.filter(pa.array(lengths == r.d)).column("v").combine_chunks(), r.d).astype(float)) for r in sizes}


def _by_length(batch: pa.RecordBatch, column: str = "d"):
    lengths = batch.column(column).to_numpy()
    for d in np.unique(lengths).tolist():
        yield d, batch.filter(pa.array(lengths == d))


def keyed(vectors: DataFrame, space: dict[int, Space], keep: int) -> DataFrame:
    """(vec_id, label, v, d, pivot, dist): of equal vectors of one label the ``keep`` least vec_ids, as no more of them can
    be among so many first."""
    first = {d: n for d, n in zip(space, np.cumsum([0, *(len(s.pivots) for s in space.values())]).tolist(), strict=False)}

    def run(batches):
        for batch in batches:
            for d, part in _by_length(batch):
                pivot, dist = space[d].keys(_matrix(part.column("v"), d).astype(float))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pivot + first[d], pa.int32()), pa.array(dist)], names=[*part.schema.names, "pivot", "dist"])

    least = Window.partitionBy("v", "label").orderBy("vec_id")
    rows = vectors.withColumn("_r", F.row_number().over(least)).where(F.col("_r") <= keep).select("vec_id", "label", "v", "d")
    return rows.mapInArrow(run, "vec_id long, label long, v array<long>, d int, pivot int, dist double")


def built(keys: DataFrame, space: dict[int, Space]) -> DataFrame:
    """(annulus, block, n, bytes, ids, labels, x): the stored blocks. Fills the annuli of ``space``: at most ``ANNULI`` a
    pivot, of about equal counts, so the directory is bounded whatever the input."""
    cuts = [i / ANNULI for i in range(1, ANNULI)]
    pivots = keys.groupBy("pivot").agg(F.max("d").alias("d"), F.count(F.lit(1)).alias("n"), F.percentile_approx("dist", cuts, 1000).alias("q")).orderBy("pivot").collect()
    edges, start = {}, 0
    for r in pivots:
        step = ANNULI // min(ANNULI, 1 << int(r.n // BLOCK).bit_length())
        edges[r.pivot] = start, np.unique(r.q[step - 1 :: step])
        start += len(edges[r.pivot][1]) + 1

    def number(batches):
        for batch in batches:
            pivot, dist = batch.column("pivot").to_numpy(), batch.column("dist").to_numpy()
            out = np.zeros(len(pivot), np.int32)
            for p in np.unique(pivot).tolist():
                at, cut = edges[p]
                out[pivot == p] = at + np.searchsorted(cut, dist[pivot == p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "annulus"])

    rows = keys.mapInArrow(number, "vec_id long, label long, v array<long>, d int, pivot int, dist double, annulus int")

    def cut(batches):
        for batch in batches:
            annulus = batch.column("annulus").to_numpy()
            heads = np.flatnonzero(np.concatenate([[True], annulus[1:] != annulus[:-1]])) if len(annulus) else np.zeros(0, int)
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(annulus)], strict=False):
                for i in range(a, b, BLOCK):
                    part = batch.slice(i, min(BLOCK, b - i))
                    ids = part.column("vec_id").to_numpy()
                    order = np.argsort(ids, kind="stable")
                    v, dist = _matrix(part.column("v"), part.column("d")[0].as_py())[order], part.column("dist").to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((int(annulus[a]), pa.int32()), (part.column("d")[0].as_py(), pa.int32()), (int(part.column("pivot")[0].as_py()), pa.int32()), (dist.min(), pa.float64()), (dist.max(), pa.float64()), (len(ids), pa.int64()), (ids[order].tobytes(), pa.binary()), (part.column("label").to_numpy()[order].tobytes(), pa.binary()), (v.tobytes(), pa.binary()))], names=["annulus", "d", "pivot", "low", "high", "n", "ids", "labels", "x"])

    ordered = rows.repartitionByRange("annulus", "dist", "vec_id").sortWithinPartitions("annulus", "dist", "vec_id")
    blocks = ordered.mapInArrow(cut, "annulus int, d int, pivot int, low double, high double, n long, ids binary, labels binary, x binary")
    blocks = stash(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks", "zstd")
    rings = blocks.groupBy("annulus").agg(F.max("d").alias("d"), F.max("pivot").alias("pivot"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("annulus").collect()
    base = 0
    for d, s in space.items():
        own = [r for r in rings if r.d == d]
        s.numbers, s.at = np.array([r.annulus for r in own], np.int32), np.array([r.pivot - base for r in own], int)
        s.low, s.high, s.sizes = np.array([r.low for r in own]), np.array([r.high for r in own]), np.array([r.n for r in own])
        base += len(s.pivots)
    return blocks


#: A search: what it asks, the bands of scores it wants (null: any score of its own label), the radius it has scanned, and
#: the least score it needs of each band so far, null where it has too few.
SEARCH = "anchor_id long, label long, d int, v array<long>, low array<long>, high array<long>, r double, worst array<long>"
_SEARCH = ["anchor_id", "label", "d", "v", "low", "high", "r", "worst"]


def _wanted(space: Space, norm: float, gaps: np.ndarray, low, high, r: float, worst) -> float:
    """The radius that a search is to have scanned next."""
    if low is None and worst[0] is not None:
        return space.reach(norm, worst[0])
    if low is None:
        order = np.argsort(gaps)
        rows = space.sizes[order].cumsum()
        need = FIRST if r < 0 else WIDER * int(space.sizes[gaps <= r].sum())
        return float(gaps[order][min(int(np.searchsorted(rows, need)), len(rows) - 1)])
    if r < 0:
        return max(space.reach(norm, h - (h - lo) // 4) for lo, h in zip(low, high, strict=True))
    return max(space.reach(norm, lo if w is None else w) for lo, w in zip(low, worst, strict=True))


def visits(searches: DataFrame, space: dict[int, Space]) -> DataFrame:
    """(annulus, .. search): the annuli each open search scans next; none for one whose results are certain."""

    def run(batches):
        for batch in batches:
            for d, part in _by_length(batch):
                if d not in space or not len(space[d].numbers):
                    continue
                gaps, norms = space[d].asked(_matrix(part.column("v"), d).astype(float))
                at, to, radius = [], [], []
                for i, (low, high, r, worst) in enumerate(zip(*(part.column(c).to_pylist() for c in ("low", "high", "r", "worst")), strict=True)):
                    new = _wanted(space[d], float(norms[i]), gaps[i], low, high, r, worst)
                    some = np.flatnonzero((gaps[i] > r) & (gaps[i] <= new))
                    at.append(np.full(len(some), i))
                    to.append(space[d].numbers[some])
                    radius.append(np.full(len(some), new))
                at = np.concatenate(at)
                chosen = part.take(pa.array(at))
                columns = [chosen.column(c) for c in _SEARCH]
                columns[_SEARCH.index("r")] = pa.array(np.concatenate(radius))
                for a in range(0, len(at), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to), pa.int32()), *columns], names=["annulus", *_SEARCH]).slice(a, 4096)

    return searches.select(*_SEARCH).mapInArrow(run, f"annulus int, {SEARCH}")


def _best(scores: np.ndarray, ids: np.ndarray, same: np.ndarray, anchors: np.ndarray, low, high, want: int):
    """(row, slot, column) of each row's first ``want`` of its own label, or of others within each of its bands; columns
    are in the order of ids, so ties go to the less."""
    fits = (same & (ids[None] != anchors[:, None])) if low is None else ~same
    masked = np.where(fits, scores, _LEAST)
    order = np.argsort(~masked, axis=1, kind="stable")
    ranked = np.take_along_axis(masked, order, 1)
    out = []
    slots = 1 if low is None else max(map(len, low))
    for k in range(slots):
        lo = np.array([_LEAST + 1 if low is None else x[k] if k < len(x) else _MOST for x in (low or [()] * len(anchors))], np.int64)
        hi = np.array([_MOST if high is None else x[k] if k < len(x) else _LEAST for x in (high or [()] * len(anchors))], np.int64)
        first = (ranked > hi[:, None]).sum(1)
        at = first[:, None] + np.arange(want)
        inside = at < ranked.shape[1]
        at = np.minimum(at, ranked.shape[1] - 1)
        row, j = np.nonzero(inside & (np.take_along_axis(ranked, at, 1) >= lo[:, None]) & (lo <= hi)[:, None])
        out.append((row, np.full(len(row), k), order[row, at[row, j]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _first(want: int, anchors: np.ndarray, slots: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Rows that are among the first ``want`` of their anchor and slot."""
    order = np.lexsort((ids, ~scores, slots, anchors))
    new = np.ones(len(order), bool)
    new[1:] = (anchors[order][1:] != anchors[order][:-1]) | (slots[order][1:] != slots[order][:-1])
    heads = np.flatnonzero(new)
    place = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
    return order[place < want]


def scanned(blocks: DataFrame, asked: DataFrame, want: int, total: int) -> DataFrame:
    """(anchor_id, slot, vec_id, score): of the visited blocks the ``want`` best of each search and slot, a batch at a time.

    A task gets blocks: each comes first and is opened once, then the searches stream past it. A block that very many
    searches visit is copied, and the searches are dealt to its copies.
    """
    copies = asked.groupBy("annulus").agg(F.ceil(F.count(F.lit(1)) / VISITS).cast("int").alias("copies"))
    listed = stash(blocks.select("annulus", "block").join(copies, "annulus"), "visited")
    dealt = asked.join(listed, "annulus").withColumn("copy", F.pmod(F.xxhash64("anchor_id"), F.col("copies")).cast("int"))
    held = blocks.join(listed.select("block", "copies"), "block").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    rows = held.select("block", "copy", "d", "ids", "labels", "x").unionByName(dealt.select("block", "copy", *_SEARCH), allowMissingColumns=True)

    def search(batches):
        held = None
        for batch in batches:
            first = batch.column("ids").is_valid().to_numpy(zero_copy_only=False)
            block, copy = batch.column("block").to_numpy(), batch.column("copy").to_numpy()
            new = np.concatenate([[True], (block[1:] != block[:-1]) | (copy[1:] != copy[:-1])]) if len(block) else np.zeros(0, bool)
            cuts = np.flatnonzero(new | first).tolist()
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for a, b in zip(cuts, [*cuts[1:], len(batch)], strict=True):
                if first[a]:
                    d = batch.column("d")[a].as_py()
                    held = d, *(np.frombuffer(batch.column(c)[a].as_py(), np.int64) for c in ("ids", "labels", "x"))
                    a += 1
                for i in range(a, b, 1024):
                    part = batch.slice(i, min(1024, b - i))
                    d, ids, labels, x = held
                    anchors, label = part.column("anchor_id").to_numpy(), part.column("label").to_numpy()
                    scores = inner_products(_matrix(part.column("v"), d), x.reshape(-1, d))
                    low, high = (part.column(c).to_pylist() for c in ("low", "high"))
                    bands = (None, None) if low[0] is None else (low, high)
                    row, slot, at = _best(scores, ids, label[:, None] == labels[None], anchors, *bands, want)
                    found.append((anchors[row], slot.astype(np.int32), ids[at], scores[row, at]))
            every = [np.concatenate(x) for x in zip(*found, strict=True)]
            best = _first(want, *every)
            yield pa.RecordBatch.from_arrays([pa.array(x[best]) for x in every], names=["anchor_id", "slot", "vec_id", "score"])

    parts = max(shuffle_count(asked.sparkSession), -(-total // TASK))
    ordered = rows.repartition(parts, "block", "copy").sortWithinPartitions("block", "copy", F.col("ids").isNull())
    return ordered.select("block", "copy", "ids", "labels", "x", *_SEARCH).mapInArrow(search, "anchor_id long, slot int, vec_id long, score long")


def searched(blocks: DataFrame, space: dict[int, Space], searches: DataFrame, want: int, total: int) -> DataFrame:
    """(anchor_id, slot, rank, vec_id, score): the exact first ``want`` of each search and slot.

    Round by round, open searches scan the annuli between the radius they have scanned and the next, until none is left.
    """
    best, order = None, Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    while True:
        asked = stash(visits(searches, space), "visits", "zstd")
        if asked.isEmpty():
            break
        found = scanned(blocks, asked, want, total)
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = stash(found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= want), "best")
        worst = best.where(F.col("rank") == want).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("_w"))
        least = F.transform(F.sequence(F.lit(0), F.coalesce(F.size("low"), F.lit(1)) - 1), lambda k: F.col("_w")[k])
        open_ = asked.groupBy("anchor_id").agg(*(F.first(c).alias(c) for c in ("label", "d", "v", "low", "high")), F.max("r").alias("r"))
        searches = stash(open_.join(worst, "anchor_id", "left").withColumn("worst", least).drop("_w"), "searches", "zstd")
    if best is None:
        return searches.sparkSession.createDataFrame([], "anchor_id long, slot int, vec_id long, score long, rank int")
    return best


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each anchor and positive.

    ``vectors`` are (vec_id, label, v, d) as ``usable`` gives them, ``anchors`` (vec_id) name some of them. A score is the
    integer inner product with the anchor, higher first, ties to the less vec_id. Positives are the first of the anchor's
    label, without itself; negatives the first of other labels with low * positive <= 100 * negative <= high * positive.
    Rows with a null vec_id, label or vector, an empty vector or null or non-finite components take no part; zero vectors
    do. Of rows of one vec_id that of least (label, vector) counts. Vectors of other lengths than the anchor's have no
    score with it. Scores and components beyond a long are the nearest long. Other columns are ignored. An empty side, or
    an anchor without positives or fitting negatives, gives no rows.
    """
    vectors = stash(vectors, "vectors", "zstd")
    space = spaces(vectors)
    keys = stash(keyed(vectors, space, max(positives + 1, negatives)), "keys", "zstd")
    blocks = built(keys, space)
    total = sum(int(s.sizes.sum()) * (8 * d + 16) for d, s in space.items())
    own = vectors.join(anchors.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi").withColumnRenamed("vec_id", "anchor_id")
    none = F.lit(None).cast("array<long>")
    searches = own.select("anchor_id", "label", "d", "v", none.alias("low"), none.alias("high"), F.lit(-1.0).alias("r"), F.array(F.lit(None).cast("long")).alias("worst"))
    near = searched(blocks, space, searches, positives, total)
    listed = near.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))

    def bands(batches):
        for batch in batches:
            scores = batch.column("scores").to_pylist()
            found = [[[-(-low * s // 100) for s in x] for x in scores], [[high * s // 100 for s in x] for x in scores]]
            columns = {c: batch.column(c) for c in ("anchor_id", "label", "d", "v")} | {c: pa.array(x, pa.list_(pa.int64())) for c, x in zip(("low", "high"), found, strict=True)}
            yield pa.RecordBatch.from_pydict(columns)

    banded = own.join(listed, "anchor_id").mapInArrow(bands, "anchor_id long, label long, d int, v array<long>, low array<long>, high array<long>")
    searches = banded.select("*", F.lit(-1.0).alias("r"), F.transform("low", lambda _: F.lit(None).cast("long")).alias("worst"))
    hard = searched(blocks, space, stash(searches, "searches", "zstd"), negatives, total)
    near = near.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    hard = hard.select("anchor_id", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(hard, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


OP11_SQL = """WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
      list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  scores AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
  positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positives JOIN scores s USING (anchor_id) WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 3"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    noisy = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(usable(noisy), rows.where(F.col("vec_id") % 50 == 0))
