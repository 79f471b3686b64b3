"""MinHash near-dedup with odd sketches.

A document's set of word shingles gives K MinHash samples. Bands of them propose candidates; the same samples, folded
into a bitmap of parities (an odd sketch), tell from the XOR's population count how many samples differ, which near
similarity 1 is precise, and weed out candidates; those left are confirmed on the full sets.

No group is compared all against all. Equal sets collapse to their least doc_id first. In a bucket every member is
compared with the least one only; then buckets that still hold several components are searched in square tiles of
bounded blocks: the sketches pick rows that may join different components, full sets decide inside the tile.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_hash, slices, stash, text_bytes, whole
from .components import components
from .words import mix, shingles, words

BANDS, ROWS = 25, 5
#: Samples of a sketch; the first BANDS * ROWS of them make the bands.
SAMPLES = 250
BITS = 512
LONGS = BITS // 64
#: Members of a tile's side, at most about.
BLOCK = 512
#: Bytes of text hashed at a time.
PORTION = 1 << 20

_rng = np.random.default_rng(125)
_MUL = (_rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_ADD = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)[:, None]


def minhash(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, SAMPLES) MinHash samples of each slice of shingle hashes; all ones where empty."""
    short = (flat >> np.uint64(32)).astype(np.uint32)
    out = np.full((len(offsets) - 1, SAMPLES), 0xFFFFFFFF, np.uint32)
    for d in range(len(out)):
        for a in range(int(offsets[d]), int(offsets[d + 1]), 2048):
            np.minimum(out[d], (short[None, a : min(a + 2048, int(offsets[d + 1]))] * _MUL + _ADD).min(1), out=out[d])
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """(documents, LONGS) parities: sample i flips the bit that a hash of (i, sample) names."""
    n = len(samples)
    at = mix(samples.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)
    flips = np.bincount((at.astype(np.int64) + np.arange(n)[:, None] * BITS).ravel(), minlength=n * BITS).reshape(n, BITS)
    return np.packbits((flips & 1).astype(np.uint8), axis=1, bitorder="little").view(np.int64).reshape(n, LONGS)


def most_differing(percent: int, deviations: float = 4.5) -> int:
    """XOR population counts up to this can be sets of ``percent`` similarity: the mean there and some deviations.

    D differing samples flip 2D random bits; E[count] = BITS/2 * (1 - (1 - 2/BITS)^2D). D is binomial, and bits met
    twice add the occupancy's own spread.
    """
    miss = 1 - percent / 100
    flips, spread = 2 * SAMPLES * miss, 2 * math.sqrt(SAMPLES * miss * (1 - miss))
    decay = (1 - 2 / BITS) ** flips
    deviation = math.sqrt((decay * spread) ** 2 + BITS / 4 * (1 - decay**2))
    return math.ceil(BITS / 2 * (1 - decay) + deviations * deviation)


def estimate(differing: float) -> float:
    """The similarity that an XOR population count suggests."""
    return 1 + BITS / (4 * SAMPLES) * math.log(max(1 - 2 * differing / BITS, 1e-9))


def _sets(column: pa.Array, size: int):
    """For each portion of a batch: its index range, shingle hashes and offsets."""
    data, offsets = text_bytes(column)
    for a, b in slices(offsets, PORTION):
        part = offsets[a : b + 1]
        hashes, _, _, first = words(data[part[0] : part[-1]], part - part[0])
        yield a, b, *shingles(hashes, first, size)


def _set_id(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def features(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, sketch, bands) of every whole text."""

    def run(batches):
        for batch in batches:
            for a, b, flat, offsets in _sets(batch.column(1), size):
                samples = minhash(flat, offsets)
                keys = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.zeros((b - a, 1), np.uint64)
                for i in range(ROWS):
                    keys = mix(keys * np.uint64(31) + samples[:, i : BANDS * ROWS : ROWS].astype(np.uint64))
                n = np.diff(offsets)
                ids = [_set_id(flat[x:y]) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                listed = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(ids, pa.binary()), listed(odd_sketch(samples)), listed(keys)], names=["doc_id", "n_shingles", "set_id", "sketch", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_id binary, sketch array<long>, bands array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(id, shingles) of the wanted (id, set_id), the sorted hashes as bytes; a repeated row once a task."""

    def run(batches):
        last = None
        for batch in batches:
            ids, want = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b, flat, offsets in _sets(batch.column(2), size):
                out = []
                for i in range(a, b):
                    found = flat[offsets[i - a] : offsets[i - a + 1]]
                    if (ids[i], want[i]) != last and _set_id(found) == want[i]:
                        last = ids[i], want[i]
                        out.append((ids[i], found.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([s for _, s in out], pa.binary())], names=["id", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), whole().alias("text")).join(wanted, "id")
    return rows.select("id", "set_id", "text").mapInArrow(run, "id long, shingles binary")


def _confirm(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(j).take(pa.array(keep, pa.int64())) for j in (0, 1)], names=["a", "b"])

    rows = pairs.join(full.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    rows = rows.join(full.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return rows.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _differing(x: str, y: str) -> Column:
    return sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(1, LONGS)), F.bit_count(F.col(x)[0].bitwiseXOR(F.col(y)[0])))


def _sketched(pairs: DataFrame, sets: DataFrame, most: int) -> DataFrame:
    """The pairs (a, b) whose odd sketches differ in few enough bits."""
    one = lambda k, s: sets.select(F.col("id").alias(k), F.col("sketch").alias(s))
    return pairs.join(one("a", "x"), "a").join(one("b", "y"), "b").where(_differing("x", "y") <= most).select("a", "b")


def _possible(rows: DataFrame, most: int) -> DataFrame:
    """Of a tile's rows (key, i, j, side, id, comp, star, sketch, bands), those that the sketches leave a possible link
    to another component; a pair counts in the first of its common buckets only, and not with the star."""

    def mark(table: pa.Table) -> pa.Table:
        col = lambda c: table.column(c).to_numpy()
        ids, comp, star, side, key = (col(c) for c in ("id", "comp", "star", "side", "key"))
        matrix = lambda c: table.column(c).combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        sketch, bands = matrix("sketch").view(np.uint64), matrix("bands")
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = not len(right)
        right = left if same else right
        chosen = np.zeros(len(ids), bool)
        for n, i in enumerate(left):
            others = right[n + 1 :] if same else right
            differing = np.bitwise_count(sketch[others] ^ sketch[i]).sum(1)
            others = others[(differing <= most) & (comp[others] != comp[i]) & (ids[others] != star[i]) & (ids[i] != star[i])]
            others = others[bands[i][(bands[others] == bands[i]).argmax(1)] == key[0]]
            chosen[others] = True
            chosen[i] |= bool(len(others))
        return table.select(["key", "i", "j", "side", "id", "comp"]).take(pa.array(np.flatnonzero(chosen)))

    return rows.groupBy("key", "i", "j").applyInArrow(mark, "key long, i int, j int, side int, id long, comp long")


def _tile_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components among a tile's rows (key, i, j, side, id, comp, shingles), by full sets.

    Shared shingles are counted through the tile's sorted shingles; links that close no gap are left out.
    """

    def search(table: pa.Table) -> pa.Table:
        ids, comp, side = (table.column(c).to_numpy() for c in ("id", "comp", "side"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        right = right if len(right) else left
        sizes = np.array([len(sets[r]) for r in right])
        flat, owner = np.concatenate([sets[r] for r in right]), np.repeat(np.arange(len(right)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        up: dict = {}

        def top(x):
            while up.get(x, x) != x:
                up[x] = x = up.get(up[x], up[x])
            return x

        a, b = [], []
        for i in left:
            lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
            n = hi - lo
            hits = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
            shared = np.bincount(owner[hits], minlength=len(right))
            near = right[(100 * shared >= percent * (len(sets[i]) + sizes - shared)) & (comp[right] != comp[i])]
            for r in near.tolist():
                x, y = top(int(comp[i])), top(int(comp[r]))
                if x != y:
                    up[max(x, y)] = min(x, y)
                    a.append(ids[i])
                    b.append(ids[r])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("key", "i", "j").applyInArrow(search, "a long, b long")


def _open_tiles(members: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Tiles of the buckets that hold several components by ``labels``.

    A bucket of n members is cut into n / BLOCK blocks by a hash of the id; a tile is a pair of blocks.
    """
    labelled = members.where("n > 2").join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    split = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = labelled.join(stash(split, "unresolved"), "key").join(sets.select("id", "sketch", "bands"), "id")
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.select("key", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), F.when(F.col("blk") <= F.col("other"), 0).otherwise(1).alias("side"), "id", "comp", "star", "sketch", "bands")


def links(docs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between different sets, at least enough of them to connect every component.

    First members with their bucket's star; then, in buckets that still hold several components, tiles of bounded
    blocks: sketches tell which rows may link across components, and full sets are brought to those rows only.
    """
    most = most_differing(percent)
    rows = sets.select("id", "set_id", F.explode("bands").alias("key"))
    buckets = stash(rows.groupBy("key").agg(F.min("id").alias("star"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    members = stash(rows.join(buckets, "key").select("key", "star", "n", "id", "set_id"), "members")
    full = stash(_full_sets(docs, members.select("id", "set_id").distinct(), size), "sets", "zstd")
    stars = members.where("id <> star").select(F.col("id").alias("a"), F.col("star").alias("b")).distinct()
    first = stash(_confirm(stash(_sketched(stars, sets, most), "pairs"), full, percent), "links")
    possible = stash(_possible(_open_tiles(members, sets, components(first)), most), "possible")
    second = stash(_tile_links(possible.join(full, "id"), percent), "links")
    return first.unionByName(second)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Words are runs of other bytes than space and \\t to \\r, A-Z lower-cased; a set is the distinct ``size``-word
    shingles, or all words where there are fewer. Links: intersection at least ``percent`` of the union. A null, empty
    or blank text has an empty set and no links. Rows with a null doc_id link with nothing and are kept, component_id
    null. Rows with one doc_id are one node. Extra columns are ignored. An empty table gives no rows.
    """
    found = stash(features(docs, size), "features", "zstd")
    some = found.where("n_shingles > 0 and doc_id is not null")
    sets = some.groupBy("set_id").agg(F.min(F.struct("doc_id", "sketch", "bands")).alias("s"))
    sets = stash(sets.select("set_id", F.col("s.doc_id").alias("id"), "s.sketch", "s.bands"), "distinct-sets", "zstd")
    copies = some.select("doc_id", "set_id").join(sets.select("set_id", "id"), "set_id").where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    labels = components(copies.unionByName(links(docs, sets, size, percent)))
    rows = found.select("doc_id", "n_shingles").join(labels, F.col("doc_id") == F.col("id"), "left")
    rows = rows.withColumn("component_id", F.coalesce("comp", "doc_id"))
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, that of least doc_id; null doc_ids all stay.

    Of rows that share the kept doc_id the one of least text hash, then of least hash of the whole row, stays, so reruns
    agree. A null, empty or blank text links with nothing and stays. Extra columns, whatever their names, are kept. An
    empty table stays empty.
    """
    kept = near_duplicates(docs, size, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias("_keep")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.struct(F.xxhash64(whole()), row_hash(*(c for c in docs.columns if c.lower() not in ("doc_id", "text")))).alias("_order"), F.struct(*docs.columns).alias("_row"))
    one = rows.where("_id is not null").join(kept, F.col("_id") == F.col("_keep"), "left_semi").groupBy("_id").agg(F.min_by("_row", "_order").alias("_row"))
    return one.select("_row.*").unionByName(docs.where("doc_id is null"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=2)
