"""Repeated-substring removal by distributed prefix doubling: a row per byte position, rank pairs sorted at growing offsets.

The rank of a position says where its first ``have`` bytes stand among all such strings. Round by round Spark sorts the
pairs (rank at i, rank at i + step) and numbers them, which ranks ``have + step`` bytes; the last step overlaps, so that
exactly ``length`` bytes are ranked. Positions whose string stands in one document only have no rank any more and don't
enter the next round. Strings are compared exactly, without hashes.

It moves every position several times, at some 40 bytes each, so it wants disk of many times the text; the registered
query thins positions first (``substrings``). README has the figures of both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, stash, text_bytes, unstash, whole
from .substrings import GRAM, LEAST, OUTCOME, PORTION, outcome

_SIGN = np.uint64(1 << 63)


def _eights(data: np.ndarray) -> np.ndarray:
    """Each position's eight bytes as a number, in the order of the bytes."""
    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8))
    return (windows.view(">u8").ravel().astype(np.uint64) ^ _SIGN).view(np.int64)


def positions(docs: DataFrame, length: int) -> DataFrame:
    """(key, id, at, a, b): the sixteen bytes from every position of the documents that hold ``length`` bytes."""

    def spread(batches):
        for batch in batches:
            key, name = (batch.column(i).to_numpy() for i in (0, 1))
            data, offsets = text_bytes(batch.column(2))
            for first, last in slices(offsets, PORTION):
                ends = offsets[first : last + 1] - offsets[first]
                part = data[offsets[first] : offsets[last]]
                for s in range(0, len(part) - GRAM + 1, PORTION):
                    eight = _eights(part[s : s + PORTION + GRAM - 1])
                    place = np.arange(s, s + len(eight) - 8)
                    doc = np.searchsorted(ends, place, "right") - 1
                    size = np.diff(ends)[doc]
                    at = place - ends[doc]
                    some = (at + GRAM <= size) & (size >= length)
                    doc = doc[some] + first
                    columns = key[doc], name[doc], at[some], eight[:-8][some], eight[8:][some]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "id", "at", "a", "b"])

    return docs.select("key", "id", "text").mapInArrow(spread, "key long, id long, at long, a long, b long")


def reranked(pairs: DataFrame) -> DataFrame:
    """(a, b, least, rank) of the pairs that stand in two documents, ranks in the order of the pairs; kept in a table, as
    the numbers must not change when a lost task is run again."""
    shared = pairs.groupBy("a", "b").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    ordered = shared.drop("most").repartitionByRange("a", "b").sortWithinPartitions("a", "b")
    return stash(ordered.withColumn("rank", F.monotonically_increasing_id()), "ranks")


def repeated_starts(docs: DataFrame, length: int) -> DataFrame:
    """(key, at): where a ``length``-byte string starts that also starts in a document of smaller id."""
    pairs, have, old = positions(docs, length), GRAM, []
    names = reranked(pairs)
    while have < length:
        step = min(have, length - have)
        ranked = stash(pairs.join(names, ["a", "b"]).select("key", "id", "at", F.col("rank").alias("a")), "ranked")
        for table in [*old, names]:
            unstash(table)
        later = ranked.select("key", (F.col("at") - step).alias("at"), F.col("a").alias("b"))
        pairs, have, old = ranked.join(later, ["key", "at"]), have + step, [ranked]
        names = reranked(pairs)
    return pairs.join(names, ["a", "b"]).where("id > least").select("key", "at")


def doubled_substrings(docs: DataFrame, length: int = 50, kept_bytes: bool = True) -> DataFrame:
    """The rows of ``substrings.repeated_substrings``, by prefix doubling over all positions.

    A null text is empty. Null doc_ids count as smaller than all others and equal to each other; rows with one doc_id
    don't remove from each other. Documents shorter than ``length`` stay whole. Other columns are ignored; an empty table
    gives no rows. A string that a large part of all documents holds is counted before it is moved; its positions are
    then split by Spark's handling of skewed joins.
    """
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} at least")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    rows = stash(rows.withColumn("key", F.monotonically_increasing_id()).withColumn("id", F.coalesce("doc_id", F.lit(LEAST))), "texts")
    starts = repeated_starts(rows, length).groupBy("key").agg(F.collect_list("at").alias("starts"))

    def remove(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            found: list[list] = [[] for _ in range(5)]
            for i, starts in enumerate(batch.column(2)):
                text = data[offsets[i] : offsets[i + 1]]
                cover = np.zeros(len(text) + 1, np.int32)
                if starts.is_valid:
                    at = starts.values.to_numpy()
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + length, -1)
                for have, x in zip(found, outcome(text, np.cumsum(cover[:-1], dtype=np.int32) > 0, kept_bytes), strict=True):
                    have.append(x)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(found, types, strict=True))], names=["doc_id", *OUTCOME])

    joined = rows.join(starts, "key", "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
