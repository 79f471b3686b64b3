"""Repeated-substring removal by prefix doubling over thinned positions.

A suffix array of every byte sorts each position once a round (``doubling`` does that). Here the positions that enter a
round are first thinned so that no match is lost: of every ``length``-byte window the position of its least ``GRAM``-byte
hash is an anchor, which depends on the window's bytes alone, so equal windows have equal anchors at equal places.

1. Anchors are ranked by their GRAM bytes, and by their context, all bytes of the windows they stand for (up to
   2 * length - GRAM). An anchor whose context also stands in a smaller document is settled, all its windows repeat; one
   whose GRAM bytes stand nowhere else is settled too, none repeats.
2. Of the others, one copy of each context goes on with all its windows, which are ranked by prefix doubling: a round
   sorts the pairs (rank at i, rank at i + step) of 16, then 32 bytes, and so on, the last step overlapping so that exactly
   ``length`` bytes are ranked. Only positions whose pair another document shares enter the next round.

A rank is a name, equal for equal strings, and not a place in an order: a hash of the pair, so any task can tell the rank
of any position. Ranks have 48 bits within a bucket of the GRAM hash for anchors, 32 within a bucket in rounds before the
last, where a collision costs a needless row and no error, and 64 in the last. Rounds are bucketed exchanges of packed
arrays, sorted bucket by bucket, so a position costs 4 to 12 bytes, not a row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts_for, shuffle_count, slices, small_batches, stash, text_bytes, whole
from .words import Rolling, mix

GRAM = 16
#: A context of a longer window would hold 1024 bytes, from where on texts exist (Thue-Morse words) that ``Rolling`` can't
#: tell apart.
LONGEST = 512
#: Bytes ranked at a time; a longer document is cut, windows overlapping.
PORTION = 1 << 19
#: Bytes of text of a team, and open windows packed at a time and packed bytes sorted at a time; a position takes up to 60
#: bytes while it is sorted, so neither a team's windows nor a bucket's are ever unpacked together.
TEAM, WINDOWS, SORTED = 16 << 20, 1 << 20, 4 << 20
#: Names of documents without a doc_id: the least numbers, by a hash of the text, so that they don't share a task. In order
#: they are equal to each other and before all others.
LEAST, UNNAMED = -(1 << 63), 1 << 40
#: What comes of a document, besides its doc_id.
OUTCOME = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
_LOW48 = np.uint64((1 << 48) - 1)
_LOW32 = np.uint64((1 << 32) - 1)
_PLACE = np.uint64((1 << 24) - 1)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """Rolling hashes and, per anchor: document, place, first and last window start."""
    rolling = Rolling(data)
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes >= length)
    none = np.zeros(0, np.int64)
    if not len(long):
        return rolling, none, none, none, none
    mark = np.zeros(len(data) - length + 2, np.int8)
    np.add.at(mark, offsets[long], 1)
    np.add.at(mark, offsets[long] + sizes[long] - length + 1, -1)
    inside = np.cumsum(mark[:-1], dtype=np.int8).view(bool)
    keys = rolling.every(GRAM)
    keys &= ~_PLACE
    keys |= np.arange(len(keys), dtype=np.uint64)
    least = _sliding_min(keys, length - GRAM + 1)
    edge = np.ones(len(least) + 1, bool)
    edge[1:-1] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
    lo, hi = np.flatnonzero(edge[:-1] & inside), np.flatnonzero(edge[1:] & inside)
    at = (least[lo] & _PLACE).astype(np.int64)
    return rolling, np.searchsorted(offsets, lo, "right") - 1, at, lo, hi


def _portions(column: pa.Array):
    """(index of the first document, data, offsets) of whole documents, about PORTION bytes each."""
    data, offsets = text_bytes(column)
    for a, b in slices(offsets, PORTION):
        yield a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """(shift of the first byte, data, offsets) of a portion, a very long document cut so that windows stay whole."""
    if len(data) <= 2 * PORTION:
        yield 0, data, offsets
    else:
        for s in range(0, len(data) - length + 1, PORTION):
            piece = data[s : s + PORTION + length - 1]
            yield s, piece, np.array([0, len(piece)])


def _ranks(rolling: Rolling, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    gram = rolling.slices(at, at + GRAM)
    return gram, mix(rolling.slices(lo, hi + length) + (at - lo).astype(np.uint64) * np.uint64(0x9E3779B1)) & _LOW48


def _key(doc: np.ndarray, *ranks: np.ndarray) -> np.ndarray:
    """One number for a document and ranks in it."""
    return _keyed(_seed(doc), *ranks)


def _seed(doc: np.ndarray) -> np.ndarray:
    return mix(doc.astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))


def _keyed(out: np.ndarray, *ranks: np.ndarray) -> np.ndarray:
    for r in ranks:
        out = mix(out + r * np.uint64(0xA0761D6478BD642F))
    return out


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(blob) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _dealt(groups: np.ndarray, doc: np.ndarray, values: list[np.ndarray], pack) -> pa.RecordBatch | None:
    """A row per group present: its documents, their counts, and each of ``values`` packed, documents in order."""
    order = np.lexsort((doc, groups))
    groups, doc = groups[order], doc[order]
    heads = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])[: len(groups)])
    ends = np.append(heads[1:], len(groups))[: len(heads)]
    rows: list[list] = [[] for _ in range(3 + len(values))]
    for a, b in zip(heads.tolist(), ends.tolist(), strict=True):
        names, counts = np.unique(doc[a:b], return_counts=True)
        for have, x in zip(rows, (int(groups[a]), names.tobytes(), counts.astype(np.uint32).tobytes(), *(pack(v[order[a:b]]) for v in values)), strict=True):
            have.append(x)
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])], names=["bucket", "docs", "counts", *(f"r{i}" for i in range(len(values)))])


def _gathered(table: pa.Table, unpack, low: int = 0):
    """(doc, values...) of a bucket's rows, some of the values at a time: equal first values together, told by their bits from ``low``."""
    parts = 1 + table.nbytes // SORTED
    for part in range(parts):
        found: list[list] = [[] for _ in range(table.num_columns - 2)]
        for row in zip(*(table.column(i) for i in range(1, table.num_columns)), strict=True):
            docs, counts, *values = (x.as_buffer() for x in row)
            doc = np.repeat(np.frombuffer(docs, np.int64), np.frombuffer(counts, np.uint32))
            values = [unpack(v) for v in values]
            if parts > 1:
                some = (values[0] >> values[0].dtype.type(low)) % values[0].dtype.type(parts) == part
                doc, values = doc[some], [v[some] for v in values]
            for have, x in zip(found, (doc, *values), strict=True):
                have.append(x)
        out = tuple(np.concatenate(x) for x in found)
        if len(out[0]):
            yield out


def _order(doc: np.ndarray) -> np.ndarray:
    return np.maximum(doc, LEAST + UNNAMED)


def _settled(doc: np.ndarray, gram: np.ndarray, context: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Documents and keys of anchors whose context a smaller document has, and of one copy of each context that shares
    its gram with another context of another document."""
    order = np.lexsort((doc, context, gram))
    doc, gram, context = doc[order], gram[order], context[order]
    new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
    new_class = new_gram | np.concatenate([[True], context[1:] != context[:-1]])
    which_gram = np.cumsum(new_gram) - 1
    heads = np.flatnonzero(new_gram)
    place = _order(doc)
    settled = place[np.flatnonzero(new_class)][np.cumsum(new_class) - 1] < place
    mixed = np.minimum.reduceat(place, heads) != np.maximum.reduceat(place, heads)
    mixed &= np.add.reduceat(new_class.astype(np.int32), heads) > 1
    is_open = ~settled & mixed[which_gram]
    keys = lambda m: (doc[m], _key(doc[m], gram[m], context[m]))
    return {"settled": keys(settled), "open": keys(is_open)}


def _by_team(teams: int, kinds: dict[str, tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """A row (team, and keys by kind) for each team whose documents have keys of any kind."""
    rows: dict[int, dict[str, bytes]] = {}
    for kind, (doc, key) in kinds.items():
        team = _team(doc, teams)
        order = np.argsort(team, kind="stable")
        heads, firsts = np.unique(team[order], return_index=True)
        for t, a, b in zip(heads.tolist(), firsts.tolist(), [*firsts[1:].tolist(), *[len(order)] * bool(len(heads))], strict=True):
            rows.setdefault(t, {})[kind] = np.unique(key[order[a:b]].astype(KINDS[kind])).tobytes()
    return pa.table({"team": pa.array(list(rows), pa.int32()), **{k: pa.array([r.get(k, b"") for r in rows.values()], pa.binary()) for k in KINDS}})


def _tables(found, teams: int) -> pa.Table:
    """The rows of ``_by_team`` for each of ``found``."""
    return pa.concat_tables([_by_team(teams, {}), *(_by_team(teams, x) for x in found)])


def _matched(table: pa.Table, last: bool, teams: int) -> pa.Table:
    """Of a bucket's windows in the last round those that a smaller document has, before it those that any other has."""

    def found():
        for doc, ranks in _gathered(table, lambda v: np.frombuffer(v, "<u8" if last else "<u4"), 44 if last else 12):
            order = np.lexsort((doc, ranks))
            doc, ranks = doc[order], ranks[order].astype(np.uint64)
            place = _order(doc)
            heads = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))
            ends = np.append(heads[1:], len(ranks))
            again = place > np.repeat(place[heads], ends - heads)
            if not last:
                again = np.repeat(np.logical_or.reduceat(again, heads), ends - heads)
            yield {"repeated" if last else "shared": (doc[again], _key(doc[again], ranks[again]))}

    return _tables(found(), teams)


def _team(doc: np.ndarray, teams: int) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(np.uint64)) % np.uint64(teams)).astype(np.int32)


#: Keys of settled and open contexts, of windows shared with another document in a round before the last (where a collision
#: only costs a row, so they are short), and of repeated windows.
KINDS = {"settled": "<u8", "open": "<u8", "shared": "<u4", "repeated": "<u8"}
_TEAM = "team int, " + ", ".join(f"{k} binary" for k in KINDS)


def _known(info: pa.Table, kind: str) -> np.ndarray:
    """All keys of a kind in a team's rows, sorted."""
    return np.sort(np.concatenate([np.zeros(0, KINDS[kind]), *(np.frombuffer(x.as_buffer(), KINDS[kind]) for x in info.column(kind))]))


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    keys = keys.astype(known.dtype, copy=False)
    at = np.searchsorted(known, keys)
    return known[np.minimum(at, len(known) - 1)] == keys if len(known) else np.zeros(len(keys), bool)


def spans(length: int) -> list[int]:
    """The bytes that each round ranks: doubled, and in the end ``length``."""
    out = [GRAM]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return out


def _rank(rolling: Rolling, start: np.ndarray, ranked: list[int]) -> np.ndarray:
    """Ranks of the ``ranked[-1]`` bytes from each start: pairs of ranks of the span before, the second at its end."""
    if len(ranked) == 1:
        return rolling.slices(start, start + ranked[0])
    first = _rank(rolling, start, ranked[:-1])
    second = _rank(rolling, start + (ranked[-1] - ranked[-2]), ranked[:-1])
    first *= np.uint64(0x9E3779B97F4A7C15)
    first += second
    return mix(first)


def _windows(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each anchor's windows: the anchor's index and the start."""
    n = hi - lo + 1
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which]


def outcome(data: np.ndarray, gone: np.ndarray, kept_bytes: bool) -> tuple:
    """A document's ``OUTCOME``, given which of its bytes go."""
    kept = data[~gone].tobytes()
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept if kept_bytes else None


def repeated_substrings(docs: DataFrame, length: int = 50, kept_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) after removing every byte under a ``length``-byte
    string that also starts in a document of smaller doc_id; ``kept`` holds the remaining bytes if ``kept_bytes``.

    A null text is empty. Null doc_ids count as smaller than all others and equal to each other; rows with one doc_id
    don't remove from each other and share a task, so no doc_id may be that of much of the corpus. The 2^40 least numbers
    are no doc_ids. Documents shorter than ``length`` stay whole. Other columns are ignored; an empty
    table gives no rows. ``length`` is over ``GRAM`` and at most ``LONGEST``.
    """
    if not GRAM < length <= LONGEST:
        raise ValueError(f"length must be over {GRAM} and at most {LONGEST}")
    spark = docs.sparkSession
    small_batches(spark)
    teams = parts_for(docs, most=TEAM)
    buckets = max(shuffle_count(spark), -(-teams // 4))
    rounds = [spans(length)[:n] for n in range(2, len(spans(length)) + 1)]

    def rank(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            found: list[list] = [[], [], []]
            for a, data, offsets in _portions(batch.column(1)):
                for _, piece, ends in _pieces(data, offsets, length):
                    rolling, doc, at, lo, hi = _anchors(piece, ends, length)
                    for have, x in zip(found, (ids[a + doc], *_ranks(rolling, at, lo, hi, length)), strict=True):
                        have.append(x)
            doc, gram, context = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in found)
            if len(doc):
                yield _dealt(((gram >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32), doc, [gram, context], _six)

    def settle(table: pa.Table) -> pa.Table:
        return _tables((_settled(*x) for x in _gathered(table, _from_six)), teams)

    def expand(ranked: list[int]):
        """Pack the ranks of the open windows, after the first round only of those that the round before found shared."""
        last = ranked[-1] == length

        def pack(key, left: pa.Table, right: pa.Table) -> pa.Table:
            ids, known, shared = left.column("id").to_numpy(), _known(right, "open"), _known(right, "shared")
            found: list[list] = [[], []]
            packed: list[pa.RecordBatch] = []

            def put() -> None:
                doc, ranks = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in found)
                bucket = (ranks if last else ranks >> np.uint64(32)) % np.uint64(buckets)
                packed.append(_dealt(bucket.astype(np.int32), doc.astype(np.int64), [ranks], lambda v: v.astype("<u8" if last else "<u4").tobytes()))
                for x in found:
                    x.clear()

            for column_ids, column in _chunks(left, ids):
                for a, data, offsets in _portions(column):
                    for _, piece, ends in _pieces(data, offsets, length):
                        rolling, doc, at, lo, hi = _anchors(piece, ends, length)
                        name = column_ids[a + doc]
                        gram, context = _ranks(rolling, at, lo, hi, length)
                        some = _among(_key(name, gram & _LOW48, context), known)
                        which, start = _windows(lo[some], hi[some])
                        if len(ranked) > 2:
                            before = _among(_keyed(_seed(name[some])[which], _rank(rolling, start, ranked[:-1]) & _LOW32), shared)
                            which, start = which[before], start[before]
                        found[0].append(name[some][which])
                        found[1].append(_rank(rolling, start, ranked))
                    if sum(map(len, found[0])) >= WINDOWS:
                        put()
            put()
            return pa.Table.from_batches(packed)

        return pack

    def match(last: bool):
        return lambda table: _matched(table, last, teams)

    def remove(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("id").to_numpy()
        settled, is_open, repeated = (_known(right, k) for k in ("settled", "open", "repeated"))
        out: list[list] = [[] for _ in range(5)]
        for column_ids, column in _chunks(left, ids):
            for first, data, offsets in _portions(column):
                cover = np.zeros(len(data) + 1, np.int32)
                for shift, piece, ends in _pieces(data, offsets, length):
                    rolling, doc, at, lo, hi = _anchors(piece, ends, length)
                    name = column_ids[first + doc]
                    gram, context = _ranks(rolling, at, lo, hi, length)
                    keys = _key(name, gram & _LOW48, context)
                    whole_run, some = _among(keys, settled), _among(keys, is_open)
                    np.add.at(cover, shift + lo[whole_run], 1)
                    np.add.at(cover, shift + hi[whole_run] + length, -1)
                    which, start = _windows(lo[some], hi[some])
                    hit = shift + start[_among(_keyed(_seed(name[some])[which], _rank(rolling, start, rounds[-1])), repeated)]
                    np.add.at(cover, hit, 1)
                    np.add.at(cover, hit + length, -1)
                gone = np.cumsum(cover[:-1], dtype=np.int32) > 0
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    for have, x in zip(out, outcome(data[a:b], gone[a:b], kept_bytes), strict=True):
                        have.append(x)
        return pa.table({"doc_id": left.column("doc_id"), "n_bytes": pa.array(out[0], pa.int64()), "n_removed": pa.array(out[1], pa.int64()), "n_spans": pa.array(out[2], pa.int64()), "kept_sha256": pa.array(out[3], pa.string()), "kept": pa.array(out[4], pa.binary())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    name = F.coalesce("doc_id", F.lit(LEAST) + F.pmod(F.xxhash64("text"), F.lit(UNNAMED)))
    named = rows.select(name.alias("id"), "text")
    ranked = named.mapInArrow(rank, "bucket int, docs binary, counts binary, r0 binary, r1 binary")
    info = ranked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(settle, _TEAM)

    def assign(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_team(batch.column(1).to_numpy(), teams)), *batch.columns], names=["team", "doc_id", "id", "text"])

    moved = rows.select("doc_id", name.alias("id"), "text").mapInArrow(assign, "team int, doc_id long, id long, text string").repartition(teams, "team")
    info = stash(info, "ranks")
    opened = known = info.withColumn("settled", F.lit(b""))
    for upto in rounds:
        windows = moved.groupBy("team").cogroup(known.groupBy("team")).applyInArrow(expand(upto), "bucket int, docs binary, counts binary, r0 binary")
        found = windows.groupBy("bucket").applyInArrow(match(upto is rounds[-1]), _TEAM)
        known = opened.unionByName(found)
    every = info.unionByName(found)
    return moved.groupBy("team").cogroup(every.groupBy("team")).applyInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _chunks(table: pa.Table, ids: np.ndarray):
    at = 0
    for chunk in table.column("text").chunks:
        yield ids[at : at + len(chunk)], chunk
        at += len(chunk)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), kept_bytes=False).drop("kept")
