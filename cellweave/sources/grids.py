"""Gridded files: classic NetCDF decoded with numpy, sparse and dense fields as rows of cells."""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.grid import MAX_MM, NCOLS, NROWS

#: Numpy types of the classic format's codes, the native rows and columns kept, and the missing value.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
ROW0, COL0, MISSING = 500, 500, -99900.0
NATIVE_ROWS, NATIVE_COLS, BLOCK = 2600, 5900, 5


class _Header:
    """Walks a classic header; names and values are padded to four bytes."""

    def __init__(self, data: bytes):
        if data[:3] != b"CDF" or data[3:4] not in (b"\x01", b"\x02"):
            raise ValueError("not a classic NetCDF file")
        self.data, self.at, self.wide = data, 4, data[3] == 2

    def number(self, wide: bool = False) -> int:
        (out,) = struct.unpack_from(">q" if wide else ">i", self.data, self.at)
        self.at += 8 if wide else 4
        return out

    def name(self) -> str:
        n = self.number()
        out = self.data[self.at : self.at + n].decode()
        self.at += -(-n // 4) * 4
        return out

    def listed(self, read) -> list:
        self.number()
        return [read() for _ in range(self.number())]

    def attribute(self):
        name, kind, n = self.name(), self.number(), self.number()
        size = np.dtype(TYPES[kind]).itemsize * n
        raw = self.data[self.at : self.at + size]
        self.at += -(-size // 4) * 4
        return name, raw.decode("latin-1") if kind == 2 else np.frombuffer(raw, TYPES[kind], n)


def read_tags(data: bytes) -> dict[str, str]:
    """The global attributes of a classic NetCDF file as text."""
    head = _Header(data)
    head.number()
    head.listed(lambda: (head.name(), head.number()))
    return {name: v if isinstance(v, str) else ", ".join(map(str, v.tolist())) for name, v in head.listed(head.attribute)}


def write_netcdf(variables: dict[str, np.ndarray], tags: dict[str, str]) -> bytes:
    """A classic NetCDF file (version 2) of arrays, dimensions shared by those of equal length, with text attributes."""
    codes = {np.dtype(t): k for k, t in TYPES.items() if k != 2}
    number, name = struct.Struct(">i").pack, lambda x: number(len(x.encode())) + _padded(x.encode())
    lengths = sorted({n for v in variables.values() for n in v.shape})
    listed = lambda kind, items: number(kind if items else 0) + number(len(items)) + b"".join(items)
    # The format's marks of lists of dimensions, variables and attributes, and of text.
    dims = listed(10, [name(f"n{n}") + number(n) for n in lengths])
    attributes = listed(12, [name(k) + number(2) + number(len(v.encode("latin-1", "replace"))) + _padded(v.encode("latin-1", "replace")) for k, v in tags.items()])
    arrays = {k: np.ascontiguousarray(v, v.dtype.newbyteorder(">")) for k, v in variables.items()}

    def header(at: int) -> bytes:
        items = []
        for k, v in arrays.items():
            size = -(-v.nbytes // 4) * 4
            items.append(name(k) + number(v.ndim) + b"".join(number(lengths.index(n)) for n in v.shape) + number(0) + number(0) + number(codes[v.dtype]) + number(size) + struct.pack(">q", at))
            at += size
        return b"CDF\x02" + number(0) + dims + attributes + listed(11, items)

    return header(len(header(0))) + b"".join(_padded(v.tobytes()) for v in arrays.values())


def _padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 4)


def read_header(data: bytes) -> dict[str, tuple[str, list[int], int]]:
    """(numpy type, shape, first byte) of the variables of a classic NetCDF file (version 1 or 2, without record dimension), by
    name; the header's bytes are enough."""
    head = _Header(data)
    head.number()
    dims = head.listed(lambda: (head.name(), head.number()))
    head.listed(head.attribute)

    def variable():
        name, n = head.name(), head.number()
        shape = [dims[head.number()][1] for _ in range(n)]
        head.listed(head.attribute)
        kind, _, begin = head.number(), head.number(), head.number(head.wide)
        return name, (TYPES[kind], shape, begin)

    return dict(head.listed(variable))


def read_netcdf(data: bytes) -> dict[str, np.ndarray]:
    """Variables of a classic NetCDF file by name."""
    return {k: np.frombuffer(data, kind, math.prod(shape), begin).reshape(shape) for k, (kind, shape, begin) in read_header(data).items()}


def sparse_cells(content: bytes, value: str = "MESH") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of a sparse field (pixel_x, pixel_y, run length pixel_count), rebased to the kept window;
    values finite, over 0, at most the cap and not the missing one."""
    field = read_netcdf(content)
    v = field[value].astype(np.float64)
    row, col = field["pixel_x"].astype(np.int64), field["pixel_y"].astype(np.int64)
    if "pixel_count" in field:
        n = np.maximum(field["pixel_count"].astype(np.int64), 1)
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        v, row, col = np.repeat(v, n), np.repeat(row, n), np.repeat(col, n) + inside
    row, col = row - ROW0, col - COL0
    keep = np.isfinite(v) & (v > 0) & (v <= MAX_MM) & (v != MISSING) & (row >= 0) & (row < NATIVE_ROWS) & (col >= 0) & (col < NATIVE_COLS)
    return row[keep], col[keep], v[keep]


def dense_cells(field: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of a dense field whose first row is the southernmost: invalid values are 0, which cells without rows are."""
    v = np.where(np.isfinite(field) & (field > 0) & (field <= MAX_MM), field, 0.0)[::-1]
    row, col = np.nonzero(v)
    return row, col, v[row, col]


def block_maxima(row: np.ndarray, col: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest value of each block of 5 x 5 native cells that is on the grid."""
    key = row // BLOCK * NCOLS + col // BLOCK
    on = (row // BLOCK < NROWS) & (col // BLOCK < NCOLS)
    key, v = key[on], v[on]
    order = np.argsort(key, kind="stable")
    heads, first = np.unique(key[order], return_index=True)
    return heads // NCOLS, heads % NCOLS, np.maximum.reduceat(v[order], first) if len(heads) else v


def cells_of(content: bytes | None, value: str = "MESH") -> tuple[np.ndarray, np.ndarray, np.ndarray, str | None]:
    """Cells of a file's field, sparse where pixel_x is there, else dense, and what is wrong with it, if anything is."""
    try:
        field = read_netcdf(content or b"")
        cells = sparse_cells(content, value) if "pixel_x" in field else dense_cells(field[value].reshape(field[value].shape[-2:]))
        return *block_maxima(*cells), None
    except (ValueError, KeyError, IndexError, struct.error) as e:
        none = np.zeros(0)
        return none, none, none, str(e) or "unreadable"


def decode_grids(files: DataFrame, value: str = "MESH") -> DataFrame:
    """(path, cell_row, cell_col, mm, error) of decompressed files (path, content): sparse where pixel_x is there, else
    dense. A file that can't be read has one row with its error and no cell."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row, col, v, error = cells_of(content, value)
                n = max(len(row), error is not None)
                missing = [None] * n
                columns = [[path] * n, row.astype(np.int32) if len(row) else missing, col.astype(np.int32) if len(row) else missing, v if len(row) else missing, [error] * n]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string()), strict=True)], names=["path", "cell_row", "cell_col", "mm", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, cell_row int, cell_col int, mm double, error string")


def resample_elevation(points: DataFrame) -> DataFrame:
    """(cell, elevation_m): mean elevation of the points (lat, lon, elevation_m) in each cell; negative, missing and
    infinite ones are 0."""
    from cellweave.functions.grid import latlon_to_cell

    e = F.col("elevation_m")
    clean = F.when(e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")) | (e < 0), 0.0).otherwise(e)
    rows = points.select(latlon_to_cell(F.col("lat"), F.col("lon")).alias("c"), clean.alias("e")).where("c.cell_row >= 0")
    return rows.groupBy(F.col("c.cell_row").alias("cell_row"), F.col("c.cell_col").alias("cell_col")).agg(F.avg("e").alias("elevation_m"))
