"""Connected components by minimum labels with pointer jumping, all state in tables of the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, unstash


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(id, comp) for every end of ``edges`` (a, b): comp is the least id reachable.

    Each round takes the least label of a node's neighbours, then the label's own label, so paths halve. Partial
    minima are combined map-side; hubs are on the many side of plain joins, which AQE splits.
    """
    both = stash(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    now = stash(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "id"), "labels")
    while True:
        heard = both.join(now.withColumnRenamed("id", "a"), "a").groupBy("b").agg(F.min("comp").alias("m"))
        least = now.join(heard, now["id"] == heard["b"]).select("id", F.col("comp").alias("old"), F.least("comp", "m").alias("c"))
        jump = now.select(F.col("id").alias("c"), F.col("comp").alias("up"))
        new = stash(least.join(jump, "c", "left").select("id", "old", F.least("c", F.coalesce("up", "c")).alias("comp")), "labels")
        unstash(now)
        if new.where("old <> comp").isEmpty():
            unstash(both)
            return new.select("id", "comp")
        now = new.select("id", "comp")
