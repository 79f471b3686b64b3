"""Parquet footers as a Spark data source: ``spark.read.format("parquet_footers").load(path)``, a row a row group and column.

Tasks open the files and read their footers only, no data page, so counts, extremes and sizes of a table cost a few KB a file.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cellweave.sources.gridsource import store

SCHEMA = "path string, row_group int, n_rows long, column string, size long, n_nulls long, low string, high string, low_number double, high_number double"
_ARROW = pa.schema([("path", pa.string()), ("row_group", pa.int32()), ("n_rows", pa.int64()), ("column", pa.string()), ("size", pa.int64()), ("n_nulls", pa.int64()), ("low", pa.string()), ("high", pa.string()), ("low_number", pa.float64()), ("high_number", pa.float64())])
#: Files whose footers a task reads.
FILES = 64


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Footers)


@dataclass
class Part(InputPartition):
    paths: list[str]


class Footers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "parquet_footers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FooterReader:
        return FooterReader(self.options["path"])


def _text(v) -> str | None:
    """A statistic as text that sorts like the value, where it is a date, a time or a text."""
    if isinstance(v, dt.datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S.%f")
    return v.isoformat() if isinstance(v, (dt.date, dt.time)) else v if isinstance(v, str) else None


class FooterReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        where, inner = store(self.path)
        if where.get_file_info(inner).type == fs.FileType.File:
            return [Part([inner])]
        hidden = lambda p: any(x[:1] in "._" for x in p[len(inner) :].split("/") if x)
        found = sorted(f.path for f in where.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(".parquet") and not hidden(f.path))
        return [Part(found[a : a + FILES]) for a in range(0, len(found), FILES)] or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        where, _ = store(self.path)
        for path in partition.paths:
            with where.open_input_file(path) as f:
                footer = pq.read_metadata(f)
            rows = []
            for g in range(footer.num_row_groups):
                group = footer.row_group(g)
                for c in range(group.num_columns):
                    chunk = group.column(c)
                    known = chunk.statistics if chunk.is_stats_set else None
                    ends = (known.min, known.max) if known is not None and known.has_min_max else (None, None)
                    numbers = [float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None for v in ends]
                    nulls = known.null_count if known is not None and known.has_null_count else None
                    rows.append((path, g, group.num_rows, chunk.path_in_schema, chunk.total_compressed_size, nulls, *map(_text, ends), *numbers))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(_ARROW), _ARROW.types, strict=True)], schema=_ARROW)


def table_statistics(spark: SparkSession, path: str) -> DataFrame:
    """(column, n_rows, n_nulls, size, low, high, low_number, high_number) of a table from its footers alone; extremes, or nulls, are
    null where a row group with other rows than nulls has none."""
    rows = spark.read.format("parquet_footers").load(path)
    unknown = F.coalesce(F.max((F.coalesce(F.col("n_nulls"), F.lit(-1)) < F.col("n_rows")) & F.col("low").isNull() & F.col("low_number").isNull()), F.lit(False))
    ends = [F.when(~unknown, x).alias(n) for n, x in (("low", F.min("low")), ("high", F.max("high")), ("low_number", F.min("low_number")), ("high_number", F.max("high_number")))]
    nulls = F.when(F.count("n_nulls") == F.count(F.lit(1)), F.sum("n_nulls"))
    return rows.groupBy("column").agg(F.sum("n_rows").alias("n_rows"), nulls.alias("n_nulls"), F.sum("size").alias("size"), *ends)


def largest_year(spark: SparkSession, path: str, column: str) -> int | None:
    """The largest year of a column of years, dates or times from the footers; where they don't tell, from the column."""
    found = table_statistics(spark, path).where(F.col("column") == column).select("high", "high_number").first()
    if found is not None and found.high is not None:
        return int(found.high[:4])
    if found is not None and found.high_number is not None:
        return int(found.high_number)
    kind = dict(spark.read.parquet(path).dtypes)[column]
    value = F.col(column) if kind in ("int", "bigint", "smallint", "tinyint", "double", "float") else F.year(column)
    top = spark.read.parquet(path).agg(F.max(value)).first()[0]
    return None if top is None else int(top)
