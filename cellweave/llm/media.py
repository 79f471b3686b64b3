"""Media columns: Netpbm and BMP to numpy arrays, area resizing by integral images, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, whole


#: Digits of a header number at most, and samples of an image: a header can't ask for more memory than that.
DIGITS, SAMPLES = 10, 1 << 31


def _netpbm_fields(data: bytes, count: int) -> tuple[list[int], int]:
    """``count`` header numbers after the magic, comments skipped, and where they end."""
    out, at = [], 2
    while len(out) < count:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if not 0 < end - at <= DIGITS:
            raise ValueError("a number is missing or too long in the Netpbm header")
        out.append(int(data[at:end]))
        at = end
    return out, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (height, width) or (height, width, 3); 8- or 16-bit unsigned; bitmaps become 0 and 255, black 0."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    (width, height, *most), at = _netpbm_fields(data, 2 if kind in (b"P1", b"P4") else 3)
    shape = (height, width, 3) if kind in (b"P3", b"P6") else (height, width)
    n = math.prod(shape)
    if n > SAMPLES or not all(0 < m < 65536 for m in most):
        raise ValueError("the Netpbm header asks for too many samples or an impossible maximum")
    if kind == b"P1":
        bits = np.frombuffer(bytes(c for c in data[at:] if c in b"01"), np.uint8)[:n] - 48
        return np.where(bits.reshape(shape), 0, 255).astype(np.uint8)
    if kind in (b"P2", b"P3"):
        values = np.array([int(x) if len(x) <= DIGITS else -1 for x in data[at:].split()[:n]], np.int64)
        if len(values) and not 0 <= values.min() <= values.max() <= most[0]:
            raise ValueError("a Netpbm sample is above the maximum")
        return values.astype(np.uint16 if most[0] > 255 else np.uint8).reshape(shape)
    at += 1
    if kind == b"P4":
        rows = np.frombuffer(data, np.uint8, height * (-(-width // 8)), at).reshape(height, -1)
        return np.where(np.unpackbits(rows, axis=1)[:, :width], 0, 255).astype(np.uint8)
    if most[0] > 255:
        return np.frombuffer(data, ">u2", n, at).reshape(shape).astype(np.uint16)
    return np.frombuffer(data, np.uint8, n, at).reshape(shape)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits a pixel, bottom-up or top-down, as RGB (or grey when all greys)."""
    if data[:2] != b"BM":
        raise ValueError("not BMP")
    start, head, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError(f"BMP of {bits} bits, compression {packed}, is not supported")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    if width < 0 or rows * width * bits // 8 > SAMPLES:
        raise ValueError("the BMP header asks for too many samples")
    pixels = np.frombuffer(data, np.uint8, rows * stride, start).reshape(rows, stride)[:, : width * bits // 8]
    pixels = pixels[::-1] if height > 0 else pixels
    if bits != 8:
        return np.ascontiguousarray(pixels.reshape(rows, width, bits // 8)[:, :, 2::-1])
    used = struct.unpack_from("<I", data, 46)[0] or 256
    palette = np.frombuffer(data, np.uint8, used * 4, 14 + head).reshape(used, 4)[:, 2::-1]
    grey = np.all(palette == palette[:, :1])
    return palette[:, 0][pixels] if grey else palette[pixels]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def _corners(n: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """Where ``to`` equal parts of n begin and end: the whole position at or below, and the fraction above it."""
    edges = np.arange(to + 1) * n / to
    low = np.minimum(edges.astype(np.int64), n - 1)
    return low, edges - low


def _between(sums: np.ndarray, at: np.ndarray, low: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Prefix sums, held at the places ``at``, interpolated at low + part along the first axis."""
    first, second = sums[np.searchsorted(at, low)], sums[np.searchsorted(at, low + 1)]
    return first + (second - first) * part.reshape(-1, *[1] * (sums.ndim - 1))


#: Rows of an image that are summed at a time.
STRIP = 1 << 16


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means of the image over height x width equal areas, by one integral image interpolated at area corners.

    Of the integral image only the rows next to corners are held: rows are summed strip by strip, so memory is bounded
    by a strip and the result, however long the image is.
    """
    h, w = image.shape[:2]
    if not h or not w:
        return np.zeros((height, width, *image.shape[2:]))
    low, part = _corners(h, height)
    at = np.unique(np.concatenate([low, low + 1]))
    held, carry = np.zeros((len(at), *image.shape[1:])), np.zeros(image.shape[1:])
    strip = max(1, STRIP // max(1, w // 16))
    for a in range(0, h, strip):
        sums = np.cumsum(image[a : a + strip], axis=0, dtype=np.float64) + carry
        some = (at > a) & (at <= a + len(sums))
        held[some] = sums[at[some] - a - 1]
        carry = sums[-1]
    rows = _between(held, at, low, part)
    across = np.zeros((w + 1, height + 1, *image.shape[2:]))
    np.cumsum(np.moveaxis(rows, 1, 0), axis=0, out=across[1:])
    integral = _between(across, np.arange(w + 1), *_corners(w, width))
    return np.moveaxis(np.diff(np.diff(integral, axis=0), axis=1), 0, 1) * (height * width / (h * w))


def difference_hash(image: np.ndarray, side: int = 8) -> str:
    """Hex of side x side bits: is an area brighter than its right neighbour."""
    small = area_resize(image if image.ndim == 2 else image.mean(2), side, side + 1)
    return np.packbits(small[:, :-1] > small[:, 1:] + 1e-9).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def tile(image: np.ndarray, side: int) -> bytes:
    """A side x side NPY tile of rounded area means."""
    return npy(np.rint(area_resize(image, side, side)).astype(np.uint8 if image.dtype == np.uint8 else np.uint16))


def media_features(media: DataFrame, key: str = "media_id", column: str = "media", side: int = 16) -> DataFrame:
    """(key, height, width, channels, dhash, tile, error): decoded, resized and hashed.

    A null, empty, cut off or impossible medium has an error and no features, and stops no other. Null and repeated keys
    keep a row each, other columns are ignored, an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for data in batch.column(1).to_pylist():
                try:
                    image = decode(data or b"")
                    row = [*image.shape[:2], image.shape[2] if image.ndim == 3 else 1, difference_hash(image), tile(image, side), None]
                except (ValueError, IndexError, OverflowError, struct.error) as e:
                    row = [None, None, None, None, None, str(e) or "unreadable"]
                for have, x in zip(out, row, strict=True):
                    have.append(x)
            types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], names=[key, "height", "width", "channels", "dhash", "tile", "error"])

    kind = media.schema[key].dataType.simpleString()
    return media.select(key, column).mapInArrow(run, f"{key} {kind}, height int, width int, channels int, dhash string, tile binary, error string")


#: Bytes of a row of the greyscale image that carries a payload; 24 rows fill one unit of 576 bytes.
ROW, UNIT = 24, 576


def text_media(text: Column) -> tuple[Column, Column]:
    """A text's UTF-8 length and its P5 image: bytes 255 up to a positive multiple of 576, 24 samples a row."""
    data = F.encode(text, "UTF-8")
    n = F.octet_length(text).cast("long")
    padded = F.greatest(F.lit(1), F.ceil(n / UNIT)) * UNIT
    head = F.encode(F.concat(F.lit(f"P5\n{ROW} "), (padded / ROW).cast("long").cast("string"), F.lit("\n255\n")), "UTF-8")
    return n, F.concat(head, F.rpad(data, padded.cast("int"), F.lit(b"\xff")))


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) written to the shared folder and opened again."""
    n, media = text_media(F.col("_t"))
    return stash(docs.select("doc_id", whole().alias("_t")).select("doc_id", n.alias("n_bytes"), media.alias("media")), "media", "zstd")


def text_features(docs: DataFrame, side: int = 16) -> DataFrame:
    """Payloads of whole texts as stored media, read back and described; see ``op1_media``.

    A null or empty text is one unit of 255s. doc_ids, null or repeated, are passed through, one row a document; other
    columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for data in batch.column(2).to_pylist():
                image = decode(data)
                payload = image.tobytes()
                for have, x in zip(out, (len(payload), sha(payload), zlib.crc32(payload[-32:]), len(data), sha(data), difference_hash(image), tile(image, side)), strict=True):
                    have.append(x)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"])

    return store_texts(docs).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_features(spark.read.parquet(f"{sf_dir}/documents.parquet"))
