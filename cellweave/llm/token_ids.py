"""Token-ID output: concatenated id arrays with Elias-Fano document boundaries, in binary files.

File format (all numbers little-endian)::

    4s  magic "EFI2"       u8  bytes per id (2 or 4)    u8 low bits of the ends    u8 low bits of the doc_ids    u8 0
    u32 shard              u32 block                    u64 documents m            u64 ids U
    u64 high-bit bytes of the ends    u64 high-bit bytes of the doc_ids    u64 null doc_ids (they come first)    i64 least doc_id
    ends: low part, high part in unary, u64[] select samples        doc_ids, less the least one: the same
    ids, concatenated

Both the documents' cumulative ends and their ascending doc_ids are Elias-Fano sequences: ``select(i)`` returns the i-th
value from a sample and a scan of a few bytes of the high part, in about 2 + log2(U/m) bits a document. There is no
64-bit table of either.
"""

from __future__ import annotations

import math
import os
import struct
import sys
import uuid
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import put_file, shared_dir, shuffle_count, slices, small_batches, stash, text_bytes, whole
from .words import slice_hashes

HEAD = struct.Struct("<4sBBBBIIQQQQQq")
STEP = 64
#: Sub-shards of the documents without a doc_id, and ranges of doc_id a shard is put together from.
NULLS, FINE = 16, 16


class EliasFano:
    """A non-decreasing sequence below or at ``universe`` in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        low_bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        parts = values[:, None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)
        low = np.packbits(parts.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::STEP].astype(np.uint64))

    def _low(self, i: int) -> int:
        a, b = i * self.low_bits, (i + 1) * self.low_bits
        part = int.from_bytes(self.low[a // 8 : (b + 7) // 8].tobytes(), "little")
        return part >> a % 8 & (1 << self.low_bits) - 1

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sample and the bytes after it."""
        at, left = int(self.samples[i // STEP]), i % STEP
        byte = at // 8
        word = int(self.high[byte]) & 0xFF << at % 8 & 0xFF
        while left >= (ones := word.bit_count()):
            left, byte = left - ones, byte + 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        return (byte * 8 + (word & -word).bit_length() - 1 - i << self.low_bits) | self._low(i)

    def range(self, a: int, b: int) -> np.ndarray:
        """The values a to b - 1: from the samples around them, only that part of the sequence is unpacked."""
        if a >= b:
            return np.zeros(0, np.uint64)
        first, after = a // STEP, -(-b // STEP)
        byte = int(self.samples[first]) // 8
        stop = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[byte:stop], bitorder="little")) + 8 * byte
        ones = ones[np.searchsorted(ones, int(self.samples[first])) :][a - first * STEP :][: b - a]
        high = (ones - np.arange(a, b)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high
        start = a * self.low_bits
        bits = np.unpackbits(self.low[start // 8 : (b * self.low_bits + 7) // 8], bitorder="little")[start % 8 :][: (b - a) * self.low_bits]
        return high | (bits.reshape(b - a, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)


def _parts(ef: EliasFano) -> list[bytes]:
    return [ef.low.tobytes(), ef.high.tobytes(), ef.samples.astype("<u8").tobytes()]


def pack_block(doc_ids: list, ids: list[bytes], width: int, shard: int = 0, block: int = 0) -> bytes:
    """The bytes of a file; null doc_ids must come first, the others ascend."""
    sizes = np.array([len(x) // width for x in ids], np.int64)
    ends = np.cumsum(sizes)
    ef = EliasFano.encode(ends, int(ends[-1]) if len(ends) else 0)
    known = [d for d in doc_ids if d is not None]
    least = known[0] if known else 0
    docs = EliasFano.encode(np.array([d - least for d in known], np.uint64), known[-1] - least if known else 0)
    head = HEAD.pack(b"EFI2", width, ef.low_bits, docs.low_bits, 0, shard, block, len(ids), int(sizes.sum()), len(ef.high), len(docs.high), len(ids) - len(known), least)
    return b"".join([head, *_parts(ef), *_parts(docs), *ids])


class Block:
    """A file opened: its ids and, through select, each document's doc_id and place among them."""

    def __init__(self, data: bytes):
        magic, width, low, doc_low, _, self.shard, self.block, self.m, total, high, doc_high, self.nulls, self.least = HEAD.unpack_from(data)
        if magic != b"EFI2":
            raise ValueError("not a file of token ids")
        at = HEAD.size

        def take(dtype, count):
            nonlocal at
            out = np.frombuffer(data, dtype, count, at)
            at += out.nbytes
            return out

        def sequence(n, low_bits, high_bytes):
            return EliasFano(n, low_bits, take("u1", (n * low_bits + 7) // 8), take("u1", high_bytes), take("<u8", (n + STEP - 1) // STEP))

        self.ends, self.docs = sequence(self.m, low, high), sequence(self.m - self.nulls, doc_low, doc_high)
        self.ids = take(f"<u{width}", total)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.least + self.docs.select(i - self.nulls)

    def doc_ids(self, a: int, b: int) -> pa.Array:
        known = self.docs.range(max(a - self.nulls, 0), max(b - self.nulls, 0)).astype(np.int64) + self.least
        return pa.concat_arrays([pa.nulls(b - a - len(known), pa.int64()), pa.array(known)])

    def span(self, i: int) -> tuple[int, int]:
        """Where the ids of document ``i`` start and end."""
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)


class _Pieces(dict):
    """Ids of text pieces that the pre-tokenizer never joins with their neighbours, as bytes, in two generations.

    When the young one is full it becomes the old one, so frequent pieces stay and memory is bounded.
    """

    FULL = 50_000

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        if len(self) >= self.FULL:
            self.old = dict(self)
            self.clear()
        found = self.old.get(key)
        self[key] = found = self.make(key) if found is None else found
        return found


class _Units:
    """An open-addressing table from 64-bit hashes of text units to their bytes and ids, in numpy arrays: some 60 bytes
    a unit. Emptied at ``MOST`` units or ``BYTES`` of text, so a worker's memory is bounded.
    """

    MOST, BYTES = 1_000_000, 24 << 20

    def __init__(self, dtype: str):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.n = self.used = 0
        self.keys, self.slots = np.zeros(1 << 18, np.uint64), np.zeros(1 << 18, np.int32)
        self.start, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 18, self.dtype)
        self.letters, self.text_start, self.text_size, self.text_used = np.zeros(1 << 18, np.uint8), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), 0

    def full(self) -> bool:
        return self.n > self.MOST or self.text_used > self.BYTES

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The unit of each hash, -1 where there is none; hashes are not 0."""
        mask = len(self.keys) - 1
        at, out, live = (hashes & np.uint64(mask)).astype(np.int64), np.full(len(hashes), -1, np.int32), np.arange(len(hashes))
        while len(live):
            held = self.keys[at[live]]
            hit = held == hashes[live]
            out[live[hit]] = self.slots[at[live[hit]]]
            live = live[~hit & (held != 0)]
            at[live] = at[live] + 1 & mask
        return out

    def _place(self, hashes: np.ndarray, units: np.ndarray) -> None:
        mask = len(self.keys) - 1
        at, live = (hashes & np.uint64(mask)).astype(np.int64), np.arange(len(hashes))
        while len(live):
            place = at[live]
            free = self.keys[place] == 0
            self.keys[place[free]] = hashes[live[free]]
            won = free & (self.keys[place] == hashes[live])
            self.slots[place[won]] = units[live[won]]
            live = live[~won]
            at[live] = at[live] + 1 & mask

    @staticmethod
    def _room(array: np.ndarray, n: int) -> np.ndarray:
        return array if n <= len(array) else np.concatenate([array, np.zeros(max(n, 2 * len(array)) - len(array), array.dtype)])

    def add(self, hashes: np.ndarray, texts: list[bytes], ids: list[list[int]]) -> None:
        """New units; hashes are distinct and none is held."""
        m, sizes = len(ids), np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), self.dtype, int(sizes.sum()))
        if 2 * (self.n + m) > len(self.keys):
            held = np.flatnonzero(self.keys)
            keys, units = self.keys[held], self.slots[held]
            size = 1 << (2 * (self.n + m)).bit_length()
            self.keys, self.slots = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._place(keys, units)
        self.start, self.size, self.pool = self._room(self.start, self.n + m), self._room(self.size, self.n + m), self._room(self.pool, self.used + len(flat))
        self.pool[self.used : self.used + len(flat)] = flat
        self.size[self.n : self.n + m] = sizes
        self.start[self.n : self.n + m] = self.used + np.cumsum(sizes) - sizes
        letters, lengths = np.frombuffer(b"".join(texts), np.uint8), np.array([len(x) for x in texts], np.int32)
        self.letters, self.text_start, self.text_size = self._room(self.letters, self.text_used + len(letters)), self._room(self.text_start, self.n + m), self._room(self.text_size, self.n + m)
        self.letters[self.text_used : self.text_used + len(letters)] = letters
        self.text_size[self.n : self.n + m] = lengths
        self.text_start[self.n : self.n + m] = self.text_used + np.cumsum(lengths) - lengths
        self._place(hashes, np.arange(self.n, self.n + m, dtype=np.int32))
        self.n, self.used, self.text_used = self.n + m, self.used + len(flat), self.text_used + len(letters)

    def others(self, units: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which slices of ``data`` are not, byte for byte, the text of their unit; the slices follow each other."""
        n = ends - starts
        wrong = self.text_size[units] != n
        at = np.flatnonzero(~wrong)
        if len(at):
            units, starts, n = units[at], starts[at], n[at]
            whole_run = len(at) == len(wrong)
            first = starts if whole_run else np.cumsum(n) - n
            place = np.repeat((self.text_start[units] - first).astype(np.int32), n)
            place += np.arange(first[0], first[0] + len(place), dtype=np.int32)
            here = data[starts[0] : starts[0] + len(place)] if whole_run else data[np.arange(len(place)) + np.repeat(starts - first, n)]
            differs = self.letters[place] != here
            if differs.any():
                wrong[at] = np.logical_or.reduceat(differs, first - first[0])
        return np.flatnonzero(wrong)

    def ids(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units in order, and how many each has."""
        sizes = self.size[units]
        place = np.repeat((self.start[units] - (np.cumsum(sizes) - sizes)).astype(np.int32), sizes)
        place += np.arange(len(place), dtype=np.int32)
        return self.pool[place], sizes


class WordwiseEncoder:
    """Ids of a byte-level BPE file of the tokenizers library, through caches of its pre-tokens.

    Byte-level BPE merges only inside a pre-token, and a pre-token never crosses a space that follows no white space. So
    texts are cut before such spaces into units, found by hash and compared byte by byte with the unit held; a new unit
    is encoded by the tokenizer. A text where white space stands before a space, or with a unit whose hash another unit
    has, is cut by the tokenizer's pattern and its pieces are encoded, one that holds an added token is encoded as a whole.
    """

    #: Fixed value: the pre-token pattern of this vocabulary.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    PORTION = 1 << 19

    def __init__(self, path: str, end_id: int = 0):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        self.code = "H" if self.width == 2 else "I"
        self.end = np.array([end_id], self.dtype).tobytes()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.find = regex.compile(self.PATTERN).findall
        self.pieces = _Pieces(self.direct)
        self.units = _Units(self.dtype)

    def direct(self, text: str) -> bytes:
        ids = array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids)
        if sys.byteorder != "little":
            ids.byteswap()
        return ids.tobytes()

    def by_pattern(self, text: str) -> bytes:
        """Ids of a text's pieces; a word, with signs after it or none, is cut without the pattern."""
        word = text.rstrip(".,;:!?#$%&*()-")
        if word[1:].isalpha() and word[0] == " ":
            return self.pieces[word] if len(word) == len(text) else self.pieces[word] + self.pieces[text[len(word) :]]
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    @staticmethod
    def _after_blank(data: np.ndarray, spaces: np.ndarray) -> np.ndarray:
        """Which spaces may follow white space, in any script; a few others count too."""
        p1, p2, p3 = (data[np.maximum(spaces - i, 0)] for i in (1, 2, 3))
        out = (p1 <= 32) & ((p1 >= 28) | (p1 >= 9) & (p1 <= 13))
        out |= (p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0))
        out |= (p3 == 0xE1) & (p2 == 0x9A) & (p1 == 0x80)
        out |= (p3 == 0xE2) & (p2 == 0x80) & ((p1 <= 0x8A) | (p1 == 0xA8) | (p1 == 0xA9) | (p1 == 0xAF))
        return out | (p3 == 0xE2) & (p2 == 0x81) & (p1 == 0x9F) | (p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x80)

    def _portion(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        n = len(offsets) - 1
        heads = offsets[:-1][np.diff(offsets) > 0]
        cut = data == 32
        cut[heads] = False
        inner = np.flatnonzero(cut)
        cut[heads] = True
        starts = np.flatnonzero(cut)
        ends = np.concatenate([starts[1:], [len(data)]]) if len(starts) else starts
        odd = [np.searchsorted(offsets, inner[self._after_blank(data, inner)], "right") - 1]
        raw = data.tobytes()
        text = lambda d: raw[offsets[d] : offsets[d + 1]].decode()
        whole_texts = {d for d in range(n) if any(t in text(d) for t in self.added)} if any(t.encode() in raw for t in self.added) else set()
        hashes = np.maximum(slice_hashes(data, starts, ends), np.uint64(1))
        if self.units.full():
            self.units.clear()
        units = self.units.find(hashes)
        missing = np.flatnonzero(units < 0)
        if len(missing):
            new, first = np.unique(hashes[missing], return_index=True)
            texts = [raw[a:b] for a, b in zip(starts[missing[first]].tolist(), ends[missing[first]].tolist(), strict=True)]
            encode = self.tokenizer.encode
            self.units.add(new, texts, [encode(x.decode(), add_special_tokens=False).ids for x in texts])
            units[missing] = self.units.find(hashes[missing])
        odd.append(np.searchsorted(offsets, starts[self.units.others(units, data, starts, ends)], "right") - 1)
        ids, sizes = self.units.ids(units)
        counts = np.bincount(np.searchsorted(offsets, starts, "right") - 1, sizes, n).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(counts)]).tolist()
        out = [ids[a:b].tobytes() + self.end for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for d in np.unique(np.concatenate(odd)).tolist():
            out[d] = self.by_pattern(text(d)) + self.end
        for d in whole_texts:
            out[d] = self.direct(text(d)) + self.end
        return out

    def encode_all(self, column: pa.Array) -> list[bytes]:
        """Ids of each text of a string array, with the end id, as bytes; null is empty."""
        data, offsets = text_bytes(column)
        out: list[bytes] = []
        for a, b in slices(offsets, self.PORTION):
            out += self._portion(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text]))[0]


_encoders: dict = {}


def _encoder(path: str, end_id: int) -> WordwiseEncoder:
    if (path, end_id) not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path, end_id] = WordwiseEncoder(path, end_id)
    return _encoders[path, end_id]


def encode(docs: DataFrame, tokenizer: str, end_id: int = 0, bounds: list | None = None) -> DataFrame:
    """(shard, doc_id, tie, ids) of every whole text, ``end_id`` appended.

    Documents without a doc_id are dealt to the first ``NULLS`` shards by ``tie``, a hash of the text, the others to those
    after by ``bounds`` of doc_id.
    """
    edges = np.array(bounds or [], np.int64)

    def run(batches):
        encoder = _encoder(tokenizer, end_id)
        for batch in batches:
            ids = pa.array(encoder.encode_all(batch.column(2)), pa.binary())
            known, tie = batch.column(0), batch.column(1)
            shard = NULLS + np.searchsorted(edges, known.fill_null(-(2**63)).to_numpy(zero_copy_only=False), "right")
            shard = np.where(known.is_null().to_numpy(zero_copy_only=False), tie.to_numpy() % NULLS, shard).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), known, tie, ids], names=["shard", "doc_id", "tie", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.pmod(F.xxhash64(whole()), F.lit(1 << 20)).alias("tie"), whole().alias("text"))
    return rows.mapInArrow(run, "shard int, doc_id long, tie long, ids binary")


def shard_bounds(docs: DataFrame, shards: int) -> list[int]:
    """doc_ids that cut the corpus into about ``shards`` ranges of equal bytes: finer ranges of equally many documents,
    whose bytes are summed over all rows, are put together. What reaches the driver is a row a fine range."""
    from pyspark.ml.feature import Bucketizer

    ids = docs.select(F.col("doc_id").cast("long").alias("d"), F.octet_length(whole()).cast("long").alias("b")).where("d is not null")
    fine = shards * FINE
    cuts = sorted({int(x) for x in ids.select("d").approxQuantile("d", [i / fine for i in range(1, fine)], 1 / (2 * fine))})
    if not cuts:
        return []

    split = Bucketizer(splits=[-math.inf, *map(float, cuts), math.inf], inputCol="x", outputCol="r").transform(ids.select(F.col("d").cast("double").alias("x"), "b"))
    sums = {int(r): b for r, b in split.groupBy("r").agg(F.sum("b").alias("b")).collect()}
    most, held, out = sum(sums.values()) / shards, 0, []
    for r, cut in enumerate(cuts):
        held += sums.get(r, 0)
        if held >= most:
            out.append(cut)
            held = 0
    return out


def write_files(docs: DataFrame, tokenizer: str, end_id: int = 0, block_ids: int = 1 << 22) -> tuple[str, DataFrame]:
    """The corpus in files of the format; their folder, and a table (shard, block, m, n_ids) of them.

    doc_id ranges of about equal bytes go to tasks; each sorts its documents, by spilling if need be, and streams out
    files of about ``block_ids`` ids, so memory is bounded by a file and the longest document (whose ids must fit a
    cell, 2 GB). A file appears under its name when it is complete, and a task that runs again writes the same file, so
    lost executors do no harm. Equal doc_ids follow each other, by a hash of the text, then shorter and byte-wise
    smaller id lists first.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = shuffle_count(spark)
    bounds = shard_bounds(docs, n)
    width = _encoder(tokenizer, end_id).width
    folder = f"{shared_dir(spark)}/cellweave/token-ids-{uuid.uuid4().hex}"

    def run(batches):
        held: list = []
        now, block, size = None, 0, 0

        def flush():
            nonlocal held, block, size
            put_file(f"{folder}/{now:06d}-{block:06d}.efid", pack_block([d for d, _ in held], [x for _, x in held], width, now, block))
            out = pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([block], pa.int32()), pa.array([len(held)], pa.int64()), pa.array([size // width], pa.int64())], names=["shard", "block", "m", "n_ids"])
            held, block, size = [], block + 1, 0
            return out

        for batch in batches:
            for shard, doc, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if held and (shard != now or size >= block_ids * width):
                    yield flush()
                if shard != now:
                    now, block = shard, 0
                held.append((doc, ids))
                size += len(ids)
        if held:
            yield flush()

    dealt = encode(docs, tokenizer, end_id, bounds).repartition(n + NULLS, "shard").sortWithinPartitions("shard", "doc_id", "tie", F.length("ids"), "ids")
    return folder, stash(dealt.mapInArrow(run, "shard int, block int, m long, n_ids long"), "token-files")


def read_files(folder: str, files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and the CRC-32 of its ids as 32-bit little-endian numbers."""
    spark = files.sparkSession
    schema = "shard int, block int, doc_id long, local long, n_tokens long, ids_crc32 long"

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                file = Block(content.as_buffer())
                for a in range(0, file.m, 8192):
                    b = min(a + 8192, file.m)
                    ends = file.ends.range(a, b).astype(np.int64)
                    starts = np.concatenate([[file.ends.select(a - 1) if a else 0], ends[:-1]])
                    wide = file.ids[starts[0] : ends[-1]].astype("<u4")
                    crc = [zlib.crc32(wide[x:y]) for x, y in zip((starts - starts[0]).tolist(), (ends - starts[0]).tolist(), strict=True)]
                    same = [pa.array(np.full(b - a, x, np.int32)) for x in (file.shard, file.block)]
                    yield pa.RecordBatch.from_arrays([*same, file.doc_ids(a, b), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())], names=["shard", "block", "doc_id", "local", "n_tokens", "ids_crc32"])

    if files.isEmpty():
        rows = spark.createDataFrame([], schema)
    else:
        rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.efid").load(folder).select("content").mapInArrow(run, schema)
    sizes = files.select("shard", "block", "n_ids")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n_ids")).select("shard", before(Window.orderBy("shard")).alias("base"))
    inside = sizes.select("shard", "block", before(Window.partitionBy("shard").orderBy("block")).alias("inside"))
    starts = inside.join(shards, "shard").select("shard", "block", (F.col("base") + F.col("inside")).alias("base"))
    return rows.join(starts, ["shard", "block"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Encode, write files, read them back: (doc_id, start, n_tokens, ids_crc32), one row per document.

    Null and empty texts are a lone ``end_id``. Null doc_ids come first; repeated doc_ids each keep a row. An empty
    table gives no rows. Columns other than doc_id and text are ignored.
    """
    return read_files(*write_files(docs, tokenizer, end_id))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
