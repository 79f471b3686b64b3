"""Shared plumbing of the corpus operators: the shared folder, Arrow text access, salted ranks."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a maximal run of anything but space, tab, newline, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``; a temporary one only where it is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="cellweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def put_file(path: str, data: bytes) -> None:
    """Write a file of the shared folder from a task: under a name of its own, renamed when it is complete."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    store, at = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if "://" in path else (fs.LocalFileSystem(), path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    own = f"{at}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(own) as out:
        out.write(data)
    store.move(own, at)


def stash(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, makes sizes exact for AQE."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cellweave/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstash(df: DataFrame) -> None:
    """Delete tables that ``stash`` wrote and ``df`` reads; only for ones that nothing to come depends on."""
    spark = df.sparkSession
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for folder in folders:
        if "/cellweave/" not in folder:
            raise ValueError(f"{folder} is no kept table")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parts_for(docs: DataFrame, column: str = "text", most: int = 64 << 20) -> int:
    """Partitions that hold ``most`` bytes of a column each, at least the session's shuffle partitions, so that tasks stay
    the same size as the input grows."""
    total = docs.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0
    return max(shuffle_count(docs.sparkSession), -(-total // most))


def shuffle_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Lower the session's Arrow batches to ``rows``, so that a Python worker holds a few MB of text at a time."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def row_hash(*columns: str) -> Column:
    """A hash of columns of any type, nested ones and maps too."""
    return F.xxhash64(F.to_json(F.struct(*columns))) if columns else F.lit(0).cast("long")


def whole(column: str = "text") -> Column:
    """The whole text, a null text read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary array and its n+1 offsets, without a copy; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(offsets: np.ndarray, most: int):
    """Index ranges of consecutive documents, each of at most ``most`` bytes or one document."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = b


def salted_rank(df: DataFrame, group: list[str], band: list[str], salt: Column, order: list[Column], rank: str = "rank", cells_only=None) -> DataFrame:
    """Add ``rank``: 0-based position within ``group``, ordered by ``band``, ``salt``, then ``order``.

    No task gets a whole group: rows are numbered inside (group, band, salt) cells, and only the cell counts, of which
    a group has at most bands times salts, are summed along the group. ``band`` columns must have few values.
    """
    cell = [*group, *band, "_salt"]
    rows = df.withColumn("_salt", salt)
    counts = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(*band, "_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*cell).orderBy(*order)
    numbered = rows.withColumn("_rn", F.row_number().over(inside) - 1)
    names = {c: f"_k_{c}" for c in cell}
    starts = starts.select(*(F.col(c).alias(n) for c, n in names.items()), "_start")
    on = None
    for c, n in names.items():
        same = F.col(c).eqNullSafe(F.col(n))
        on = same if on is None else on & same
    return numbered.join(starts, on, "left").withColumn(rank, F.col("_start") + F.col("_rn")).drop("_start", "_rn", "_salt", *names.values())
