"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, temperature.

Random indexing: every hashed word has a fixed sparse ternary index vector; its context vector is the sum of the index
vectors of its neighbours over the whole corpus. The sums are integers, so they do not depend on how tasks are cut, and
the table's size is fixed by parameters, not by the corpus. A document is the frequency-damped mean of its words'
context vectors, the mean of index vectors of its words' shapes, and a few ratios.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, text_bytes, whole
from .words import words

BUCKETS, DIM, NONZERO, WINDOW = 1 << 14, 32, 4, 2
SHAPES = 1 << 11
PORTION = 1 << 20
WIDTH = 2 * DIM + 6

_rng = np.random.default_rng(7)
_AT = np.argsort(_rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO].astype(np.int64)
_SIGN = _rng.choice(np.array([-1, 1], np.int64), (BUCKETS, NONZERO))
_SHAPE = _rng.normal(size=(SHAPES, DIM)).astype(np.float32)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SIGNS = ~(_LETTER | _DIGIT)


def _parts(column: pa.Array):
    data, offsets = text_bytes(column)
    for a, b in slices(offsets, PORTION):
        part = offsets[a : b + 1]
        yield a, b, data[part[0] : part[-1]], part - part[0]


def _context_sums(bucket: np.ndarray, doc: np.ndarray, sums: np.ndarray) -> None:
    """Add to ``sums`` (BUCKETS * DIM) every word's neighbours' index vectors, within its document."""
    for step in range(1, WINDOW + 1):
        near = np.flatnonzero(doc[step:] == doc[:-step])
        for word, other in ((near, near + step), (near + step, near)):
            for k in range(NONZERO):
                cell = bucket[word] * DIM + _AT[bucket[other], k]
                sums += np.bincount(cell, _SIGN[bucket[other], k], BUCKETS * DIM)


def context_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Unit context vectors (BUCKETS, DIM) and word frequencies, over every whole text."""

    def run(batches):
        sums, seen = np.zeros(BUCKETS * DIM), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, data, offsets in _parts(batch.column(0)):
                hashes, _, _, first = words(data, offsets)
                bucket = (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
                seen += np.bincount(bucket, minlength=BUCKETS)
                _context_sums(bucket, np.repeat(np.arange(len(first) - 1), np.diff(first)), sums)
        rows = np.flatnonzero(seen)
        table = np.rint(sums).astype(np.int64).reshape(BUCKETS, DIM)[rows]
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(seen[rows]), *(pa.array(np.ascontiguousarray(table[:, i])) for i in range(DIM))], names=["bucket", "n", *(f"v{i}" for i in range(DIM))])

    columns = ["n", *(f"v{i}" for i in range(DIM))]
    partial = docs.select(whole().alias("text")).mapInArrow(run, "bucket long, " + ", ".join(f"{c} long" for c in columns))
    rows = partial.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()
    vectors, counts = np.zeros((BUCKETS, DIM), np.float32), np.zeros(BUCKETS)
    at = rows["bucket"].to_numpy(np.int64)
    counts[at] = rows["n"].to_numpy(float)
    raw = rows[columns[1:]].to_numpy(float)
    vectors[at] = raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)
    return vectors, counts / max(counts.sum(), 1)


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, same: np.ndarray) -> np.ndarray:
    """A small number for each word's look: its last sign, capitals, digits, signs, length, and if it repeats."""
    total = lambda flags: (lambda c: c[ends] - c[starts])(np.concatenate([[0], np.cumsum(flags[data], dtype=np.int64)]))
    length = ends - starts
    capitals, digits, signs = total(_UPPER), total(_DIGIT), total(_SIGNS)
    last = data[ends - 1].astype(np.int64)
    code = np.where(_SIGNS[last], last, 0)
    for part, most in ((np.where(capitals == 0, 0, np.where(capitals == 1, 1, 2)), 3), (np.minimum(digits, 2), 3), (np.minimum(signs, 3), 4), (np.minimum(length // 3, 5), 6), (same, 2)):
        code = code * most + part
    return (code * 2654435761 >> 7) % SHAPES


def document_vectors(column: pa.Array, vectors: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """(documents, WIDTH) float64 features; zeros for an empty text."""
    out = np.zeros((len(column), WIDTH))
    weight = (1e-3 / (1e-3 + frequency)).astype(np.float32)
    damped = vectors * weight[:, None]
    for a, b, data, offsets in _parts(column):
        hashes, starts, ends, first = words(data, offsets)
        if not len(hashes):
            continue
        n = np.diff(first)
        full = np.flatnonzero(n)
        doc = np.repeat(np.arange(b - a), n)
        bucket = (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
        same = np.zeros(len(hashes), np.int64)
        same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        heads = first[:-1][full]
        mean = lambda rows: np.add.reduceat(rows, heads, axis=0) / n[full].reshape(-1, *[1] * (rows.ndim - 1))
        key = np.sort(doc.astype(np.uint64) << np.uint64(44) | hashes >> np.uint64(20))
        distinct = np.bincount((key[np.concatenate([[True], key[1:] != key[:-1]])] >> np.uint64(44)).astype(np.int64), minlength=b - a)
        shape = _shapes(data, starts, ends, same)
        rows = a + full
        out[rows, :DIM] = mean(damped[bucket])
        out[rows, DIM : 2 * DIM] = mean(_SHAPE[shape])
        out[rows, 2 * DIM] = np.log1p(n[full])
        out[rows, 2 * DIM + 1] = distinct[full] / n[full]
        out[rows, 2 * DIM + 2] = mean(same.astype(float))
        out[rows, 2 * DIM + 3] = mean((ends - starts).astype(float))
        out[rows, 2 * DIM + 4] = np.linalg.norm(out[rows, :DIM], axis=1)
        out[rows, 2 * DIM + 5] = distinct[full] / np.sqrt(n[full])
    return out


class Network:
    """Two layers, tanh then logistic, trained by Adam on standardised features; the logit is divided by a temperature."""

    def __init__(self, hidden: int = 32, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4, seed: int = 11):
        self.hidden, self.epochs, self.rate, self.decay, self.seed = hidden, epochs, rate, decay, seed
        self.temperature, self.base = 1.0, None

    def _logit(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def gradients(self, z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the mean log loss and half of ``decay`` times the squared weights, by w1, b1, w2 and b2."""
        h = np.tanh(z @ self.w1 + self.b1)
        error = (1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -40, 40))) - y) / len(y)
        back = np.outer(error, self.w2) * (1 - h * h)
        return z.T @ back + self.decay * self.w1, back.sum(0), h.T @ error + self.decay * self.w2, error.sum(keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        """Trains on most rows; the rest choose the epoch and the temperature. One class or none: a constant score."""
        if len(y) < 20 or y.min() == y.max():
            self.base = float((y.sum() + 1) / (len(y) + 2))
            return self
        rng = np.random.default_rng(self.seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z, order = (x - self.mean) / self.scale, rng.permutation(len(y))
        held, used = order[: max(10, len(y) // 6)], order[max(10, len(y) // 6) :]
        self.w1, self.b1 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], self.hidden)), np.zeros(self.hidden)
        self.w2, self.b2 = rng.normal(0, 1 / np.sqrt(self.hidden), self.hidden), np.zeros(1)
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in (self.w1, self.b1, self.w2, self.b2)]
        best, step = (np.inf, None), 0
        for _ in range(self.epochs):
            for part in np.array_split(rng.permutation(used), max(1, len(used) // 128)):
                step += 1
                for p, g, (m, v) in zip((self.w1, self.b1, self.w2, self.b2), self.gradients(z[part], y[part]), state, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= self.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            loss = self._loss(self._logit(z[held]), y[held])
            if loss < best[0]:
                best = (loss, [p.copy() for p in (self.w1, self.b1, self.w2, self.b2)])
        self.w1, self.b1, self.w2, self.b2 = best[1]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 81))
        logits = self._logit(z[held])
        self.temperature = float(grid[np.argmin([self._loss(logits / t, y[held]) for t in grid])])
        return self

    @staticmethod
    def _loss(logit: np.ndarray, y: np.ndarray) -> float:
        return float(np.mean(np.logaddexp(0, -np.where(y == 1, logit, -logit))))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.base is not None:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(self._logit((x - self.mean) / self.scale) / self.temperature, -500, 500)))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> tuple[np.ndarray, np.ndarray, Network]:
    """Context vectors and frequencies of all texts, and a network fitted on at most ``most`` labelled documents.

    ``most`` bounds what reaches the driver (some 600 bytes a row); the labelled rows of least hash are taken. A
    doc_id with several labels has the least of them, one with several texts that of least hash. Held-out rows (CRC-32
    of doc_id mod 5 is 0) are never used.
    """
    vectors, frequency = context_vectors(docs)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality"))
    share = docs.sparkSession.sparkContext.broadcast((vectors, frequency))

    def run(batches):
        for batch in batches:
            x = document_vectors(batch.column(2), *share.value)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * WIDTH), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), rows], names=["doc_id", "quality", "x"])

    rows = docs.join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("doc_id", "quality", whole().alias("text"))
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min_by("text", F.xxhash64("text")).alias("text"))
    found = rows.mapInArrow(run, "doc_id long, quality int, x array<double>").toPandas()
    x = np.array(found["x"].tolist(), float).reshape(-1, WIDTH)
    order = np.lexsort((*x.T[:3], found["doc_id"].to_numpy()))
    return vectors, frequency, Network().fit(x[order], found["quality"].to_numpy(float)[order])


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 20_000) -> DataFrame:
    """(row, score, predicted): each document as a struct, its score (0 to 1, higher: label 1 likelier), and 1 if
    score >= ``threshold``.

    A null text counts as empty and gets the score of an empty text. Without labels of both classes every score is the
    labels' smoothed mean. Labels, doc_id and other columns are never inputs of a score. Equal texts have equal scores;
    repeated rows and null doc_ids keep a row each; ``row`` holds the columns of ``docs`` whatever their names; an empty
    table gives no rows.
    """
    share = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most))

    def run(batches):
        vectors, frequency, network = share.value
        for batch in batches:
            s = network.score(document_vectors(batch.column(1), vectors, frequency))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["row", "score", "predicted"])

    rows = docs.select(F.struct(*docs.columns).alias("row"), whole().alias("text"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double, predicted int")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rows.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "score", "predicted")
