"""SimHash near-dedup: fingerprints within a few bits of each other are found by the generalised pigeonhole principle.

A fingerprint's 64 bits are dealt into four groups of 16, bits that go together in the corpus into the same group, and
the groups are taken singly or in pairs as the m parts of an index. Two fingerprints within ``most`` bits are within
t_i bits in some part i for any thresholds with t_1 + ... + t_m = most - m + 1, where -1 leaves a part out. So every
fingerprint chooses its own thresholds: dynamic programming over the parts takes those of least estimated work, from
counts of the groups' values in the whole corpus. It is looked up under its own value of every part and probes the values
within its thresholds; what meets in a bucket is verified on all bits.

Only distinct fingerprints enter, so copies never meet. A bucket of many is dealt anew by the bits that vary in it: of
``most + 1`` pieces of those, two fingerprints within ``most`` bits share one. Each time the members differ in fewer bits, and
distinct numbers over v bits are at most 2^v, so this ends. In a small bucket rows are compared in numpy and only links
that join two components leave it.
"""

from __future__ import annotations

from functools import cached_property
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stash, text_bytes, whole
from .components import components

SEED = 42
#: Shingles hashed at a time.
PORTION = 1 << 16
#: Bytes of text a result batch covers, about.
BATCH = 1 << 20
WIDTH, GROUPS = 16, 4
#: Members of a bucket that is compared pair by pair in a task; larger ones are dealt anew.
LEAF = 4096
#: What a row in the index costs, counted in comparisons.
ROW_COST = 200
_BIT = np.arange(64, dtype=np.uint64)


def shingle_hashes(text: bytes, size: int):
    """XXH64 of the ``size``-word shingles, repeats included, a portion at a time, as (n, 8) big-endian bytes."""
    words = text.lower().split()  # of bytes: only A-Z, and only space and \t to \r
    if not words:
        return
    line = b" ".join(words)
    if len(words) < size:
        yield np.frombuffer(xxhash.xxh64_digest(line, SEED), np.uint8).reshape(1, 8)
        return
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = np.append(0, blanks + 1)[: len(words) - size + 1]
    ends = np.append(blanks, len(line))[size - 1 :]
    digest = xxhash.xxh64_digest
    for a in range(0, len(starts), PORTION):
        part = zip(starts[a : a + PORTION].tolist(), ends[a : a + PORTION].tolist(), strict=True)
        yield np.frombuffer(b"".join([digest(line[x:y], SEED) for x, y in part]), np.uint8).reshape(-1, 8)


def fingerprint(text: bytes, size: int) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes; 0 without words."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, size):
        ones += np.unpackbits(hashes, axis=1).sum(0, dtype=np.uint32)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, fp) of every whole text; fp as a signed long."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets, BATCH):
                found = [fingerprint(data[offsets[i] : offsets[i + 1]].tobytes(), size) for i in range(a, b)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).mapInArrow(run, "doc_id long, fp long")


def _fps(batch: pa.RecordBatch, column: int = 0) -> np.ndarray:
    return batch.column(column).to_numpy().view(np.uint64)


def _bits(fp: np.ndarray) -> np.ndarray:
    return (fp[:, None] >> _BIT & np.uint64(1)).astype(np.float32)


def together(distinct: DataFrame) -> np.ndarray:
    """(64, 64) in how many fingerprints two bits are both set, from all of them."""

    def run(batches):
        total = np.zeros((64, 64))
        for batch in batches:
            for a in range(0, len(batch), PORTION):
                bits = _bits(_fps(batch)[a : a + PORTION])
                total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(total.ravel().astype(np.int64))], names=["at", "n"])

    out = np.zeros(4096)
    for r in distinct.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(64, 64)


def grouped_bits(both: np.ndarray, n: int) -> np.ndarray:
    """(GROUPS, WIDTH) bit numbers: each group starts from the bit most correlated with those left and takes the bits most
    correlated with its own."""
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    linked = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(linked, 0)
    left, out = list(range(64)), []
    while left:
        group = [left.pop(int(linked[np.ix_(left, left)].sum(1).argmax()))]
        while len(group) < WIDTH:
            group.append(left.pop(int(linked[np.ix_(left, group)].sum(1).argmax())))
        out.append(group)
    return np.array(out)


def values(fp: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """(GROUPS, n) the groups' values."""
    return np.array([sum((fp >> np.uint64(b) & np.uint64(1)) << np.uint64(k) for k, b in enumerate(group)) for group in bits.tolist()]).astype(np.int64)


def histograms(distinct: DataFrame, bits: np.ndarray) -> np.ndarray:
    """(GROUPS, 2^WIDTH) how many fingerprints have each value; at most so many rows reach the driver at any input."""

    def run(batches):
        total = np.zeros((GROUPS, 1 << WIDTH), np.int64)
        for batch in batches:
            for g, v in enumerate(values(_fps(batch), bits)):
                total[g] += np.bincount(v, minlength=1 << WIDTH)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "n"])

    out = np.zeros(GROUPS << WIDTH, np.int64)
    found = distinct.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(GROUPS, -1)


def at_distance(counts: np.ndarray, most: int) -> np.ndarray:
    """(GROUPS, most + 1, values) how many fingerprints are exactly so many bits from a value: a bit at a time."""
    out = np.zeros((len(counts), most + 1, counts.shape[1]))
    out[:, 0] = counts
    flipped = np.arange(counts.shape[1])
    for k in range(WIDTH):
        out[:, 1:] += out[:, :-1][:, :, flipped ^ (1 << k)]
    return out


def _ball(width: int, radius: int) -> np.ndarray:
    """The masks of at most ``radius`` of ``width`` bits, fewest bits first."""
    return np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)], np.int64)


class Index:
    """How fingerprints are indexed: parts of ``joined`` groups each, and the counts that thresholds are chosen by."""

    def __init__(self, bits: np.ndarray, counts: np.ndarray, joined: int, most: int):
        self.bits, self.counts, self.joined, self.most = bits, counts, joined, most
        self.n, self.width, self.parts = max(1, int(counts[0].sum())), WIDTH * joined, GROUPS // joined

    @cached_property
    def near(self) -> np.ndarray:
        """Made in the task: only the counts travel."""
        return at_distance(self.counts, self.most)

    def keys(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts' values, and the estimated candidates of each part within each radius (parts, most + 1, n)."""
        v = values(fp, self.bits)
        exact = np.array([self.near[g][:, v[g]] for g in range(GROUPS)])
        if self.joined == 1:
            return v, exact.cumsum(1)
        a, b = exact[::2], exact[1::2]  # of two groups: as if they were independent
        both = np.array([sum(a[:, i] * b[:, r - i] for i in range(r + 1)) for r in range(self.most + 1)]).swapaxes(0, 1) / self.n
        return v[::2] | v[1::2] << WIDTH, both.cumsum(1)

    def thresholds(self, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(parts, n) thresholds of least cost, and the cost: best[s] over the parts so far, whose thresholds sum to s."""
        n = candidates.shape[2]
        cost = np.concatenate([np.zeros((self.parts, 1, n)), candidates + ROW_COST * np.cumsum([comb(self.width, r) for r in range(self.most + 1)])[:, None]], axis=1)
        best = {0: np.zeros(n)}
        chosen = []
        for part in cost:
            new, how = {}, {}
            for s, before in best.items():
                for t in range(-1, self.most + 1):
                    c = before + part[t + 1]
                    if s + t not in new:
                        new[s + t], how[s + t] = c, np.full(n, t)
                    else:
                        how[s + t] = np.where(c < new[s + t], t, how[s + t])
                        new[s + t] = np.minimum(c, new[s + t])
            best = new
            chosen.append(how)
        s = np.full(n, self.most - self.parts + 1)
        out = np.zeros((self.parts, n), np.int64)
        for i in range(self.parts - 1, -1, -1):
            low = min(chosen[i])
            stacked = np.array([chosen[i][at] for at in sorted(chosen[i])])
            out[i] = stacked[s - low, np.arange(n)]
            s = s - out[i]
        return out, best[self.most - self.parts + 1]

    def rows(self, fp: np.ndarray) -> tuple[np.ndarray, ...]:
        """(key, fp, holds, asks): every fingerprint under its own values, and as a question in the buckets it probes."""
        v, candidates = self.keys(fp)
        t, _ = self.thresholds(candidates)
        out = []
        for i in range(self.parts):
            key = v[i] | i << 40
            out.append((key, fp, np.ones(len(fp), bool), t[i] >= 0))
            for r in range(1, self.most + 1):
                some = np.flatnonzero(t[i] == r)
                if len(some):
                    masks = _ball(self.width, r)[1:]
                    probes = (key[some][:, None] ^ masks).ravel()
                    out.append((probes, np.repeat(fp[some], len(masks)), np.zeros(len(probes), bool), np.ones(len(probes), bool)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _table(*columns: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names=names)


ROW = "key long, fp long, holds boolean, asks boolean"
_NAMES = ["key", "fp", "holds", "asks"]


def cheapest(distinct: DataFrame, bits: np.ndarray, counts: np.ndarray, most: int) -> Index:
    """The index of least estimated work, of parts of one group or two: narrow parts cost candidates, wide ones probes."""
    plans = [Index(bits, counts, joined, most) for joined in (1, 2)]

    def run(batches):
        total = np.zeros(len(plans))
        for batch in batches:
            for a in range(0, len(batch), PORTION):
                for k, plan in enumerate(plans):
                    total[k] += plan.thresholds(plan.keys(_fps(batch)[a : a + PORTION])[1])[1].sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(plans))), pa.array(total)], names=["k", "cost"])

    costs = distinct.select("fp").mapInArrow(run, "k long, cost double").groupBy("k").agg(F.sum("cost").alias("cost")).orderBy("cost", "k").collect()
    return plans[costs[0]["k"] if costs else 0]


def pieces(varying: np.ndarray, count: int) -> np.ndarray:
    """(n, count) masks that deal the set bits of each number into ``count`` about equal pieces."""
    bits = _bits(varying).astype(np.int64)
    rank = bits.cumsum(1) - 1
    which = rank * count // np.maximum(bits.sum(1, keepdims=True), 1)
    return np.stack([((bits * (which == j)).astype(np.uint64) << _BIT).sum(1, dtype=np.uint64) for j in range(count)], axis=1)


def _redealt(rows: DataFrame, most: int) -> DataFrame:
    """Rows (.., varying) of large buckets under new keys: a bucket, a piece of its varying bits and their value."""

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), PORTION):
                part = batch.slice(a, PORTION)
                fp = _fps(part, 1)
                masks = pieces(_fps(part, 4), most + 1)
                for j in range(most + 1):
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(part), j)), pa.array((fp & masks[:, j]).view(np.int64)), *(part.column(k) for k in (1, 2, 3))], names=["old", "j", "value", *_NAMES[1:]])

    dealt = rows.select(*_NAMES, "varying").mapInArrow(run, f"old long, j long, value long, {ROW.partition(', ')[2]}")
    return dealt.select(F.xxhash64("old", "j", "value").alias("key"), *_NAMES[1:])


def spanning_links(key: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within ``most`` bits among rows of one key, which follow each other: enough to connect what they connect."""
    n = len(key)
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, n)
    left = ends[np.searchsorted(ends, np.arange(n), "right")] - np.arange(n)
    label, active, found = np.arange(n), np.arange(n), []
    for d in range(1, int(left.max(initial=1))):
        active = active[left[active] > d]
        a = active[np.bitwise_count(fp[active] ^ fp[active + d]) <= most]
        a = a[label[a] != label[a + d]]
        if not len(a):
            continue
        lo, hi = np.minimum(label[a], label[a + d]), np.maximum(label[a], label[a + d])
        a = a[np.unique(lo * n + hi, return_index=True)[1]]
        found.append((fp[a], fp[a + d]))
        while (apart := label[a] != label[a + d]).any():
            a = a[apart]
            lo, hi = np.minimum(label[a], label[a + d]), np.maximum(label[a], label[a + d])
            np.minimum.at(label, hi, lo)
            while (label[label] != label).any():
                label = label[label]
    none = np.zeros(0, np.uint64)
    return tuple(np.concatenate([none, *x]) for x in zip(*found, strict=True)) if found else (none, none)


def _leaf_links(rows: DataFrame, most: int) -> DataFrame:
    """Links (a, b) of the small buckets; rows of a key may span batches, so the last key's wait for the next."""

    def run(batches):
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            key, fp = np.append(key, batch.column(0).to_numpy()), np.append(fp, _fps(batch, 1))
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if cut:
                yield _table(*spanning_links(key[:cut], fp[:cut], most), names=["a", "b"])
                key, fp = key[cut:], fp[cut:]
        yield _table(*spanning_links(key, fp, most), names=["a", "b"])

    return rows.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, most: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints within ``most`` bits, enough of them to connect every component."""
    bits = grouped_bits(together(distinct), distinct.count())
    index = cheapest(distinct, bits, histograms(distinct, bits), most)

    def deal(batches):
        for batch in batches:
            for a in range(0, len(batch), PORTION):
                yield _table(*index.rows(_fps(batch)[a : a + PORTION]), names=_NAMES)

    rows, out = distinct.select("fp").mapInArrow(deal, ROW), None
    while True:
        rows = stash(rows, "buckets", "zstd")
        buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_or("fp").bitwiseXOR(F.bit_and("fp")).alias("varying"), F.bool_or("holds").alias("h"), F.bool_or("asks").alias("q"))
        buckets = stash(buckets.where("n > 1 and h and q").select("key", "n", "varying"), "bucket-sizes")
        found = stash(_leaf_links(rows.join(buckets.where(F.col("n") <= LEAF), "key"), most), "links")
        out = found if out is None else out.unionByName(found)
        large = buckets.where(F.col("n") > LEAF)
        if large.isEmpty():
            return out
        rows = _redealt(rows.join(large, "key"), most)


def simhash_duplicates(docs: DataFrame, size: int = 3, most: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, kept) of every document.

    Words are runs of other bytes than space and \\t to \\r, A-Z lower-cased; shingles are ``size`` words with a space
    between, repeats included, all words where there are fewer. A fingerprint's bit is set if it is set in over half of the
    shingles' XXH64 (seed 42). Fingerprints link at ``most`` or fewer differing bits, and component_id is the least doc_id
    reachable. A null, empty or blank text has fingerprint 0 and is linked like any other. Rows with a null doc_id link with
    nothing and are kept, component_id null. Rows with one doc_id are one node. Ties and repeated rows are equal
    fingerprints. Extra columns are ignored. An empty table gives no rows.
    """
    if not 0 <= most <= 7:
        raise ValueError("most must be 0 to 7")
    found = stash(fingerprints(docs, size), "fingerprints", "zstd")
    named = found.where("doc_id is not null")
    distinct = stash(named.groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct-fingerprints")
    several = named.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("_most")).where("a <> _most")
    same = named.join(several, "doc_id").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()
    labels = components(same.unionByName(links(distinct, most)))
    joined = stash(distinct.join(labels.withColumnRenamed("id", "_fp"), F.col("fp") == F.col("_fp")).select("fp", "comp", "id"), "linked")
    least = joined.groupBy("comp").agg(F.min("id").alias("least"))
    nodes = joined.join(least, "comp").select("fp", "least")
    one = distinct.join(nodes, "fp", "left").select(F.col("fp").alias("_fp"), F.coalesce("least", "id").alias("component"))
    rows = found.join(stash(one, "nodes"), F.col("fp") == F.col("_fp"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
