"""Folders of gridded files as a Spark data source: ``spark.read.format("grid_files")`` and ``df.write.format("grid_files")``.

Files are classic NetCDF, plain or compressed, in folders by calendar day, named by their time. A read lists folders and opens
files in tasks, a group of files a partition. Filters on ``day`` are pushed down to the listing: folders of other days are not
listed where the filter names its days, and files whose names are of other days are never opened. Register the source with
``register``; pushing down needs the session setting in ``PUSHDOWN``.
"""

from __future__ import annotations

import datetime as dt
import gzip
import posixpath
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from cellweave.sources.grids import COL0, ROW0, cells_of, read_header, read_tags, write_netcdf

PUSHDOWN = {"spark.sql.python.filterPushdown.enabled": "true"}
CELLS = "path string, ts timestamp_ntz, day date, cell_row int, cell_col int, mm double, error string"
POINTS = "path string, lat double, lon double, value double"
TAGS = "path string, ts timestamp_ntz, day date, size long, tags map<string, string>, error string"
SUFFIXES = (".netcdf", ".netcdf.gz", ".nc", ".nc.gz")
#: What a partition reads, about, and how many days a filter may span for its folders to be listed one by one. A cell is 12
#: bytes in a file and 100 in a task that sums cells, so a task takes 70 MB.
GROUP_BYTES, SPAN = 8 << 20, 3700
_TIME = re.compile(r"(\d{8})[T-](\d{6})Z?")
_DAY = dt.timedelta(1)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GridFiles)


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, local or by its scheme, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if "://" in path else (fs.LocalFileSystem(), path)


def time_of(name: str) -> dt.datetime | None:
    """The time in a file's name; None where there is none or it is no time."""
    found = _TIME.search(posixpath.basename(name))
    try:
        return dt.datetime.strptime(found[1] + found[2], "%Y%m%d%H%M%S") if found else None
    except ValueError:
        return None


def convective(ts: dt.datetime | None) -> dt.date | None:
    return (ts - dt.timedelta(hours=12)).date() if ts else None


#: Names of the coordinates of a dense field, in any case.
LATS, LONS = ("lat", "latitude", "y"), ("lon", "longitude", "x")


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]


@dataclass
class Rows(InputPartition):
    """Some rows of a dense field: where it, its rows' and its columns' coordinates are in the file."""

    path: str
    field: tuple[str, list[int], int]
    lat: tuple[str, list[int], int]
    lon: tuple[str, list[int], int]
    first: int
    last: int


class GridFiles(DataSource):
    """Options: ``path``; ``value``, the field's name (MESH); ``content`` cells, tags for a row a file, or points for a row a number of
    a dense field with coordinates, such as an elevation model; ``layout`` of a day's folder."""

    @classmethod
    def name(cls) -> str:
        return "grid_files"

    def schema(self) -> str:
        return {"tags": TAGS, "points": POINTS}.get(self.options.get("content", "cells"), CELLS)

    def reader(self, schema) -> GridReader:
        return GridReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> GridWriter:
        if overwrite:
            raise ValueError("grid_files replaces files of the same time only: write in mode append")
        return GridWriter(dict(self.options))


class GridReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.value, self.layout = options["path"].rstrip("/"), options.get("value", "MESH"), options.get("layout", "%Y/%m/%d")
        self.tags, self.points = (options.get("content", "cells") == x for x in ("tags", "points"))
        self.group = int(options.get("groupbytes", GROUP_BYTES))
        self.first, self.last, self.days = dt.date.min, dt.date.max, None

    def pushFilters(self, filters):
        """Narrow the days; every filter is given back, so Spark still applies it to the rows."""
        for f in filters:
            if getattr(f, "attribute", None) == ("day",):
                if isinstance(f, (EqualTo, EqualNullSafe)) and f.value is not None:
                    self.first, self.last = max(self.first, f.value), min(self.last, f.value)
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, f.value)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.last = min(self.last, f.value)
                elif isinstance(f, In):
                    named = {v for v in f.value if v is not None}
                    self.days = named if self.days is None else self.days & named
            yield f

    def _wanted(self, path: str) -> bool:
        if (self.first, self.last, self.days) == (dt.date.min, dt.date.max, None):
            return True
        day = convective(time_of(path))
        return day is not None and self.first <= day <= self.last and (self.days is None or day in self.days)

    def listed(self) -> list[tuple[str, int]]:
        """(path, size) of the files that can hold rows of the days asked for."""
        where, root = store(self.root)
        if self.days is not None:
            calendar = {d + k * _DAY for d in self.days for k in (0, 1)}
        elif dt.date.min < self.first <= self.last < dt.date.max and (self.last - self.first).days <= SPAN:
            calendar = {self.first + k * _DAY for k in range((self.last - self.first).days + 2)}
        elif self.first > self.last:
            calendar = set()
        else:
            calendar = None
        folders = [root] if calendar is None else [f"{root}/{d.strftime(self.layout)}" for d in sorted(calendar)]
        found = {f.path: f.size for folder in folders for f in where.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=calendar is None)) if f.type == fs.FileType.File and f.path.lower().endswith(SUFFIXES)}
        return sorted((p, n) for p, n in found.items() if self._wanted(p))

    def _row_groups(self) -> list[InputPartition]:
        """Rows of the files' fields, about a group of bytes each; of a file only its header is read for it."""
        where, root = store(self.root)
        out: list[InputPartition] = []
        paths = [root] if where.get_file_info(root).type == fs.FileType.File else [p for p, _ in self.listed()]
        for path in paths:
            with where.open_input_file(path) as f:
                head, size = b"", 1 << 16
                while True:
                    f.seek(0)
                    head = f.read(size)
                    try:
                        held = read_header(head)
                        break
                    except (struct.error, UnicodeDecodeError, KeyError, IndexError):
                        if len(head) < size:
                            raise
                        size *= 4
            names = {k.lower(): k for k in held}
            lat, lon = (next((held[names[n]] for n in known if n in names), None) for known in (LATS, LONS))
            if self.value not in held or lat is None or lon is None or held[self.value][1] != [*lat[1], *lon[1]]:
                raise ValueError(f"{path} has no field {self.value} over latitudes and longitudes")
            kind, (n_rows, n_cols), _ = held[self.value]
            step = max(1, self.group // max(1, n_cols * np.dtype(kind).itemsize))
            out += [Rows(path, held[self.value], lat, lon, a, min(a + step, n_rows)) for a in range(0, n_rows, step)]
        return out

    def _point_rows(self, part: Rows) -> Iterator[pa.RecordBatch]:
        where, _ = store(self.root)
        with where.open_input_file(part.path) as f:

            def numbers(place: tuple[str, list[int], int], first: int, n: int) -> np.ndarray:
                kind = np.dtype(place[0])
                f.seek(place[2] + first * kind.itemsize)
                return np.frombuffer(f.read(n * kind.itemsize), kind).astype(float)

            width = part.field[1][1]
            lon = numbers(part.lon, 0, width)
            step = max(1, 65_536 // max(1, width))
            for a in range(part.first, part.last, step):
                n = min(step, part.last - a)
                lat, values = numbers(part.lat, a, n), numbers(part.field, a * width, n * width)
                yield _batch(([part.path] * (n * width), pa.string()), (np.repeat(lat, width), pa.float64()), (np.tile(lon, n), pa.float64()), (values, pa.float64()), names=["path", "lat", "lon", "value"])

    def partitions(self) -> list[InputPartition]:
        if self.points:
            return self._row_groups() or [Files([])]
        groups, size = [Files([])], 0
        for path, n in self.listed():
            if groups[-1].paths and size + n > self.group:
                groups.append(Files([]))
                size = 0
            groups[-1].paths.append((path, n))
            size += n
        return groups

    def read(self, partition: Files | Rows) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Rows):
            yield from self._point_rows(partition)
            return
        where, _ = store(self.root)
        for path, size in partition.paths:
            content, error = b"", None
            try:
                with where.open_input_stream(path, compression=None) as f:
                    content = f.read()
                if path.lower().endswith(".gz"):
                    content = gzip.decompress(content)
            except (OSError, EOFError) as e:
                error = f"unreadable: {e}"[:200]
            ts = time_of(path)
            yield self._file_row(path, ts, size, content, error) if self.tags else self._cell_rows(path, ts, content, error)

    def _file_row(self, path, ts, size, content, error) -> pa.RecordBatch:
        tags = None
        if error is None:
            try:
                tags = list(read_tags(content).items())
            except (ValueError, KeyError, IndexError) as e:
                error = str(e) or "unreadable"
        return _batch(([path], pa.string()), ([ts], pa.timestamp("us")), ([convective(ts)], pa.date32()), ([size], pa.int64()), ([tags], pa.map_(pa.string(), pa.string())), ([error], pa.string()), names=["path", "ts", "day", "size", "tags", "error"])

    def _cell_rows(self, path, ts, content, error) -> pa.RecordBatch:
        row = col = v = np.zeros(0)
        if error is None:
            row, col, v, error = cells_of(content, self.value)
        n = max(len(row), error is not None)
        cells = [x if len(row) else [None] * n for x in (row.astype(np.int32), col.astype(np.int32), v)]
        return _batch(([path] * n, pa.string()), ([ts] * n, pa.timestamp("us")), ([convective(ts)] * n, pa.date32()), (cells[0], pa.int32()), (cells[1], pa.int32()), (cells[2], pa.float64()), ([error] * n, pa.string()), names=["path", "ts", "day", "cell_row", "cell_col", "mm", "error"])


def _batch(*columns, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], names=names)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class GridWriter(DataSourceArrowWriter):
    """A file for each time of (ts, row, col, mm), native rows and columns; rows of a time must follow each other in one task.

    A file is written under a name of its own and renamed when complete, so readers see the old one or the new one.
    """

    def __init__(self, options: dict):
        self.root, self.value, self.layout, self.prefix = options["path"].rstrip("/"), options.get("value", "MESH"), options.get("layout", "%Y/%m/%d"), options.get("prefix", "mesh")
        self.tags = {k[4:]: v for k, v in options.items() if k.startswith("tag.")}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done, now, parts = [], None, []
        for batch in iterator:
            ts = batch.column("ts").cast(pa.timestamp("us")).to_numpy(zero_copy_only=False).astype("datetime64[s]")
            heads = np.flatnonzero(np.concatenate([[True], ts[1:] != ts[:-1]])).tolist() if len(ts) else []
            for a, b in zip(heads, [*heads[1:], len(ts)], strict=False):
                if ts[a] != now:
                    done += self._put(now, parts, done)
                    now, parts = ts[a], []
                parts.append(batch.slice(a, b - a))
        return Written(done + self._put(now, parts, done))

    def _put(self, ts, parts: list[pa.RecordBatch], done: list[str]) -> list[str]:
        if ts is None:
            return []
        at = ts.astype(dt.datetime)
        path = f"{self.root}/{at.strftime(self.layout)}/{self.prefix}_{at.strftime('%Y%m%d-%H%M%S')}.netcdf"
        if path in done:
            raise ValueError(f"rows of {at} don't follow each other")
        row, col, mm = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts]) for c in ("row", "col", "mm"))
        where, inner = store(path)
        where.create_dir(posixpath.dirname(inner), recursive=True)
        own = f"{inner}.{uuid.uuid4().hex}.part"
        with where.open_output_stream(own) as f:
            f.write(write_netcdf({self.value: mm.astype("f4"), "pixel_x": (row + ROW0).astype("i4"), "pixel_y": (col + COL0).astype("i4")}, self.tags))
        where.move(own, inner)
        return [path]

    def commit(self, messages: list[Written | None]) -> None:
        """Files are complete when they have their names."""

    def abort(self, messages: list[Written | None]) -> None:
        """A file that was renamed is whole, and running again replaces it."""


def write_grids(cells: DataFrame, path: str, tags: dict[str, str] | None = None, **options: str) -> None:
    """Files of (ts, row, col, mm) by time, with ``tags`` as their attributes; a time's rows meet in one task."""
    rows = cells.select("ts", "row", "col", "mm").repartition("ts").sortWithinPartitions("ts", "row", "col")
    named = {f"tag.{k}": v for k, v in (tags or {}).items()}
    rows.write.format("grid_files").mode("append").options(path=path, **options, **named).save()
