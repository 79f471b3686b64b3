"""Approximate nearest neighbours by robust-pruned directed graphs, one a shard, searched by beams.

Each shard inserts its vectors in batches: greedy searches from the medoid propose neighbours, relaxed pruning keeps
those not much nearer to a kept neighbour than to the point, and edges back are pruned alike. All searches of a batch
advance together in numpy. Largest inner product becomes nearest in Euclidean distance by one more coordinate. Graphs are built
and searched on vectors scaled by a power of two, queries on unit length, so no magnitude is out of a float's range; the
scores are those of the original vectors. Vectors are compared with those of their own length only: a shard holds one
length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash

DEGREE, BEAM, RELAX = 32, 64, 1.2
#: A shard's vectors at most, about, and the least number of shards a length is dealt to.
SHARD, SHARDS = 50_000, 12


def _distances(x: np.ndarray, norms: np.ndarray, points: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances, less the point's own norm, of each row's point to vectors ``ids`` (rows, m); -1 is far."""
    d = norms[ids] - 2 * np.einsum("bd,bmd->bm", points, x[ids])
    d[ids < 0] = np.inf
    return d


def beam_search(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, start: int, points: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest found for each point, nearest first (ids, -1 where fewer; distances less the point's norm)."""
    n, rows = len(points), np.arange(len(points))
    ids = np.full((n, beam), -1, np.int64)
    ids[:, 0] = start
    dist = np.full((n, beam), np.inf, np.float32)
    dist[:, 0] = _distances(x, norms, points, ids[:, :1])[:, 0]
    done = np.ones((n, beam), bool)
    done[:, 0] = False
    seen = np.zeros((n, len(x)), bool)
    seen[:, start] = True
    live = rows
    while len(live):
        best = np.where(done[live], np.inf, dist[live]).argmin(1)
        done[live, best] = True
        near = graph[ids[live, best]].astype(np.int64)
        fresh = (near >= 0) & ~seen[live[:, None], near]
        near = np.where(fresh, near, -1)
        at = np.nonzero(fresh)
        seen[live[at[0]], near[at]] = True
        d = _distances(x, norms, points[live], near)
        every_id = np.concatenate([ids[live], near], axis=1)
        every_d = np.concatenate([dist[live], d], axis=1)
        every_done = np.concatenate([done[live], ~fresh], axis=1)
        order = np.argpartition(every_d, beam - 1, axis=1)[:, :beam]
        ids[live] = np.take_along_axis(every_id, order, 1)
        dist[live] = np.take_along_axis(every_d, order, 1)
        done[live] = np.take_along_axis(every_done, order, 1) | np.isinf(dist[live])
        live = live[~done[live].all(1)]
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def robust_prune(x: np.ndarray, norms: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """At most ``degree`` out-edges of each point from its candidates (rows, m; -1 is none), nearest kept first.

    A kept neighbour k removes a candidate c when relax * |k - c| <= |point - c|.
    """
    rows = np.arange(len(points))
    c = candidates.copy()
    c[c == points[:, None]] = -1
    order = np.argsort(c, axis=1)
    c = np.take_along_axis(c, order, 1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    d = np.maximum(_distances(x, norms, x[points], c) + norms[points][:, None], 0)
    alive = c >= 0
    out = np.full((len(points), degree), -1, np.int32)
    for k in range(degree):
        masked = np.where(alive, d, np.inf)
        best = masked.argmin(1)
        some = np.isfinite(masked[rows, best])
        if not some.any():
            break
        kept = np.where(some, c[rows, best], -1)
        out[:, k] = kept
        alive[rows, best] = False
        apart = np.maximum(_distances(x, norms, x[kept], c) + norms[kept][:, None], 0)
        alive &= ~((relax * relax * apart <= d) & some[:, None])
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX, seed: int = 3) -> tuple[np.ndarray, int]:
    """(n, degree) out-edges, -1 where fewer, and the start: the vector nearest to the mean."""
    n = len(x)
    norms = np.einsum("nd,nd->n", x, x)
    start = int((norms - 2 * x @ x.mean(0)).argmin())
    graph = np.full((n, degree), -1, np.int32)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    at, size = 1, 1
    while at < n:
        batch = order[at : at + size]
        found, _ = beam_search(x, norms, graph, start, x[batch], beam)
        mates = np.tile(batch[: min(len(batch), 16)], (len(batch), 1))
        edges = robust_prune(x, norms, batch, np.concatenate([found, mates], axis=1), degree, relax)
        graph[batch] = edges
        source, target = np.repeat(batch, degree), edges.ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        heads, firsts, counts = np.unique(target, return_index=True, return_counts=True)
        most = int(counts.max()) if len(counts) else 0
        for lo in range(0, len(heads), 2048):
            part = slice(lo, lo + 2048)
            wide = np.full((len(heads[part]), most), -1, np.int64)
            for i, (f, c) in enumerate(zip(firsts[part], counts[part], strict=True)):
                wide[i, :c] = source[f : f + c]
            both = np.concatenate([graph[heads[part]].astype(np.int64), wide], axis=1)
            room = (both >= 0).sum(1) <= degree
            fits = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :degree]
            graph[heads[part]] = fits
            if (~room).any():
                graph[heads[part][~room]] = robust_prune(x, norms, heads[part][~room], both[~room], degree, relax)
        at += size
        size = min(size * 2, 512, max(1, at))
    return graph, start


def _matrix(column) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by powers of two of their largest component, then by their norm, in float64; zeros stay."""
    top = np.abs(x).max(1, initial=0)
    x = np.ldexp(x, -np.frexp(top)[1][:, None])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 0.1)


def inner_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; where products leave a double's range, of rows over powers of two, which are
    multiplied back last, so that a sum past the range is an infinity and none is undefined."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.einsum("nd,nd->n", x, y)
        bad = np.flatnonzero(~np.isfinite(out))
        ex, ey = (np.frexp(np.abs(v[bad]).max(1, initial=0))[1] for v in (x, y))
        out[bad] = np.ldexp(np.einsum("nd,nd->n", np.ldexp(x[bad], -ex[:, None]), np.ldexp(y[bad], -ey[:, None])), ex + ey)
    return out


def lift(x: np.ndarray) -> np.ndarray:
    """Vectors over a power of two, with a coordinate more that gives all the same norm, as float32."""
    x = np.ldexp(x, -int(np.frexp(np.abs(x).max(initial=0))[1]))
    squared = np.einsum("nd,nd->n", x, x)
    return np.concatenate([x, np.sqrt(np.maximum(squared.max() - squared, 0))[:, None]], axis=1).astype(np.float32)


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, d, v) of the vectors that take part: not null, of finite components, not all zero; d is the length."""
    v = F.col("embedding")
    good = rows.where(v.isNotNull() & F.col("vec_id").isNotNull() & (F.size(v) > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), F.size(v).alias("d"), v.cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return good.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def shard_table(vectors: DataFrame) -> DataFrame:
    """(d, first, shards): the shards of each length, at least ``SHARDS`` and one for ``SHARD`` vectors. A row a length."""
    counts = vectors.groupBy("d").agg(F.count(F.lit(1)).alias("n")).withColumn("shards", F.greatest(F.lit(SHARDS), F.ceil(F.col("n") / SHARD)).cast("int"))
    before = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    return stash(counts.select("d", F.coalesce(F.sum("shards").over(before), F.lit(0)).cast("int").alias("first"), "shards"), "shards")


#: A shard's graph; then, in the same shape, the queries put to it.
INDEX = "shard int, n long, start long, x binary, lifted binary, graph binary, ids binary, ends binary, query_id long, q array<double>"


def build_index(vectors: DataFrame, keep: int, table: DataFrame, shards: int) -> DataFrame:
    """``INDEX`` rows: a graph over each shard's distinct vectors, written to the shared folder.

    ids of a vector are its ``keep`` least vec_ids: more of equal vectors can't be among so many nearest.
    """
    least = Window.partitionBy("v").orderBy("vec_id")
    rows = vectors.withColumn("_r", F.row_number().over(least)).where(F.col("_r") <= keep)
    rows = rows.groupBy("d", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    rows = rows.join(table, "d").select((F.col("first") + F.pmod(F.xxhash64("v"), F.col("shards"))).cast("int").alias("shard"), "v", "ids")

    def build(rows: pa.Table) -> pa.Table:
        exact = _matrix(rows.column("v"))
        order = np.argsort(np.array([i[0].as_py() for i in rows.column("ids")]), kind="stable")
        exact = exact[order]
        lifted = lift(exact)
        graph, start = build_graph(lifted)
        ids = rows.column("ids").take(pa.array(order)).combine_chunks()
        flat, ends = ids.flatten().to_numpy(), ids.offsets.to_numpy()
        return pa.table({"shard": pa.array([rows.column("shard")[0].as_py()], pa.int32()), "n": pa.array([len(exact)], pa.int64()), "start": pa.array([start], pa.int64()), "x": [exact.tobytes()], "lifted": [lifted.tobytes()], "graph": [graph.tobytes()], "ids": [flat.astype(np.int64).tobytes()], "ends": [(ends - ends[0]).astype(np.int64).tobytes()], "query_id": pa.array([None], pa.int64()), "q": pa.array([None], pa.list_(pa.float64()))})

    return stash(rows.repartitionByRange(shards, "shard").groupBy("shard").applyInArrow(build, INDEX), "graphs")


class Graph:
    """A shard's index, opened."""

    def __init__(self, row: dict):
        n = row["n"]
        self.start, self.exact, self.lifted = row["start"], np.frombuffer(row["x"]).reshape(n, -1), np.frombuffer(row["lifted"], np.float32).reshape(n, -1)
        self.graph, self.ids, self.ends = np.frombuffer(row["graph"], np.int32).reshape(n, -1), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ends"], np.int64)
        self.norms = np.einsum("nd,nd->n", self.lifted, self.lifted)

    def search(self, names: np.ndarray, q: np.ndarray, k: int, beam: int) -> pa.RecordBatch:
        """(query_id, vec_id, score) of the k+1 nearest distinct vectors found, all their ids."""
        points = np.concatenate([unit(q), np.zeros((len(q), 1))], axis=1).astype(np.float32)
        found = beam_search(self.lifted, self.norms, self.graph, self.start, points, max(beam, k + 1))[0][:, : k + 1]
        asked, place = np.nonzero(found >= 0)
        near = found[asked, place]
        scores = inner_products(self.exact[near], q[asked])
        n = self.ends[near + 1] - self.ends[near]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - self.ends[near], n)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(names[asked], n)), pa.array(self.ids[at]), pa.array(np.repeat(scores, n))], names=["query_id", "vec_id", "score"])


def search_index(index: DataFrame, queries: DataFrame, table: DataFrame, shards: int, k: int, beam: int) -> DataFrame:
    """(query_id, vec_id, score) candidates: from every shard of the query's length the k+1 nearest distinct vectors
    found, with their ids.

    A task gets a shard: its graph comes first and is loaded once, then the queries stream past it, so a graph moves
    once and memory is a graph and a batch of queries.
    """
    dealt = queries.join(table, "d").select("query_id", "q", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("shards") - 1)).alias("shard"))
    rows = index.unionByName(dealt, allowMissingColumns=True)

    def search(batches):
        graph, held = None, None
        for batch in batches:
            shard = batch.column(0).to_numpy()
            first = batch.column(batch.schema.get_field_index("query_id")).is_null().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(first | np.concatenate([[True], shard[1:] != shard[:-1]])).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(batch)], strict=True):
                if first[a]:
                    graph, held = Graph({c: batch.column(c)[a].as_py() for c in batch.schema.names[1:8]}), shard[a]
                    a += 1
                for lo in range(a, b if held == shard[b - 1] else a, 1024):  # a shard may have no vector, so no graph
                    part = batch.slice(lo, min(1024, b - lo))
                    yield graph.search(part.column("query_id").to_numpy(), _matrix(part.column("q")), k, beam)

    ordered = rows.repartitionByRange(shards, "shard").sortWithinPartitions("shard", F.col("query_id").asc_nulls_first())
    return ordered.select(*index.columns).mapInArrow(search, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, by inner product, ties to the less vec_id.

    ``vectors`` and ``queries`` are (vec_id, embedding). A query's own vec_id is no candidate. Vectors null, empty, zero,
    or with null or non-finite components take no part, as queries neither. Vectors of different lengths have no inner
    product: a query's candidates are those of its length. Products past a double's range score an infinity. Rows that
    repeat an id and vector count once; of different vectors of one id the nearest counts. An empty side gives no rows.
    """
    good = stash(usable(vectors).distinct(), "vectors")
    asked = stash(usable(queries).distinct().select(F.col("vec_id").alias("query_id"), "d", F.col("v").alias("q")), "queries")
    table = shard_table(good)
    shards = max(1, table.agg(F.sum("shards")).first()[0] or 0)
    found = search_index(build_index(good, k + 1, table, shards), asked, table, shards, k, beam)
    found = found.where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0))
