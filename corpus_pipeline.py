"""From raw documents to padded training batches: each stage keeps whole documents and hands on their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import stash
from cellweave.llm.mixing import mix, word_count
from cellweave.llm.near_dedup import dedup
from cellweave.llm.packing import pack
from cellweave.llm.quality import scored
from cellweave.llm.secrets import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.3 or more), with the labels of ``sf_dir``.

    A null or empty text is scored as an empty one; equal texts have equal scores, so ties and repeated rows stay or go
    together, a row each; null doc_ids are scored like others. An empty table stays empty; without labels all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored(docs, labels).where("predicted = 1").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least doc_id, of each group linked by a similarity of 0.8 on five-word shingles.

    A null, empty or blank text links with nothing and stays; null doc_ids all stay; repeated rows become one, and ties
    between texts of one doc_id go to the least hash. An empty table stays empty.
    """
    return dedup(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars, where that column is, is the masked text's length.

    A null or empty text is unchanged, its n_chars null or 0; null doc_ids and repeated rows keep a row each, and ties
    don't arise: every text is masked alone. An empty table stays empty.
    """
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source weights draw them.

    A null or empty text has size 0, null sources are one source; null doc_ids count as one id; repeated rows and ties
    are drawn one by one in a fixed order. An empty table stays empty.
    """
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their length bucket, batch and slot.

    A null or empty text has length 0; null doc_ids come first; repeated rows and ties get a slot each. An empty table
    stays empty. Added columns give way to those of ``docs``, see ``pack``.
    """
    return pack(docs.withColumn("n_tokens", word_count()))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: The classifier's scores can't be expressed in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name, "zstd")
    return docs
