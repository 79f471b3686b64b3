"""Which polygons points lie in, by an index of tiles.

A tile that no edge of a polygon crosses is inside or outside as a whole, which the index knows; only points in tiles that an edge
crosses are tested against edges, and only against those that cross the tile's band of latitude. A point is inside where a
ray to the east crosses an odd number of the polygon's edges; an edge has its lower end and not its upper one, so points on
shared borders lie in one polygon. Rings of one polygon are its parts and holes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Degrees of a tile's side.
SIDE = 0.5


def ring_edges(vertices: DataFrame) -> DataFrame:
    """(polygon, lo, lo_lon, hi, hi_lon): edges from corners (polygon, ring, seq, lat, lon), each ring closed, lower end first.
    A ring that repeats its first corner at the end is the same ring."""
    ring = Window.partitionBy("polygon", "ring").orderBy("seq")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    later = [F.coalesce(F.lead(c).over(ring), F.first(c).over(whole)).alias(f"{c}2") for c in ("lat", "lon")]
    both = vertices.select("polygon", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), *later).where("lat1 <> lat2 or lon1 <> lon2")
    up = F.col("lat1") < F.col("lat2")
    pick = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    return both.select("polygon", pick("lat1", "lat2").alias("lo"), pick("lon1", "lon2").alias("lo_lon"), pick("lat2", "lat1").alias("hi"), pick("lon2", "lon1").alias("hi_lon"))


def crossing_lon(lat: Column, edge) -> Column:
    """Where an edge (a name -> column function) has a latitude."""
    return edge("lo_lon") + (lat - edge("lo")) * (edge("hi_lon") - edge("lo_lon")) / (edge("hi") - edge("lo"))


def tile_index(edges: DataFrame, side: float = SIDE) -> tuple[DataFrame, DataFrame]:
    """((polygon, band, column, crossed) of the tiles inside or crossed, (polygon, band, edges) of what crosses each band)."""
    low = F.floor(F.col("lo") / side)
    bands = edges.withColumn("band", F.explode(F.sequence(low, F.greatest(low, F.ceil(F.col("hi") / side) - 1))))
    level = F.col("lo") == F.col("hi")  # crosses no ray, but parts what is above it from what is below
    bottom = F.greatest(F.col("lo"), F.col("band") * side)
    top = F.least(F.col("hi"), (F.col("band") + 1) * side)
    ends = F.sort_array(F.array(F.when(level, F.col("lo_lon")).otherwise(crossing_lon(bottom, F.col)), F.when(level, F.col("hi_lon")).otherwise(crossing_lon(top, F.col))))
    columns = F.sequence(F.floor((ends[0] - 1e-9) / side), F.floor((ends[1] + 1e-9) / side))  # a rounding error may mark a tile more
    crossed = bands.select("polygon", "band", F.explode(columns).alias("column")).distinct()
    held = bands.where(~level).groupBy("polygon", "band").agg(F.collect_list(F.struct("lo", "lo_lon", "hi", "hi_lon")).alias("edges"))
    spans = crossed.groupBy("polygon", "band").agg(F.min("column").alias("a"), F.max("column").alias("b"))
    middle = (F.col("band") + 0.5) * side
    tiles = spans.join(held, ["polygon", "band"]).select("polygon", "band", "edges", F.explode(F.sequence("a", "b")).alias("column"))
    inside = tiles.where(odd_crossings(middle, (F.col("column") + 0.5) * side)).select("polygon", "band", "column")
    index = inside.join(crossed.withColumn("crossed", F.lit(True)), ["polygon", "band", "column"], "full")
    return index.withColumn("crossed", F.coalesce("crossed", F.lit(False))), held


def odd_crossings(lat: Column, lon: Column, edges: str = "edges") -> Column:
    """Whether a ray to the east crosses an odd number of an array of edges."""
    hit = lambda e: (e["lo"] <= lat) & (lat < e["hi"]) & (lon < crossing_lon(lat, lambda c: e[c]))
    return F.size(F.filter(edges, hit)) % 2 == 1


def polygons_of(points: DataFrame, vertices: DataFrame, side: float = SIDE) -> DataFrame:
    """``points`` (.., lat, lon) with ``polygon``, a row for each polygon of ``vertices`` (polygon, ring, seq, lat, lon) that a point lies in.

    Points without a place, or in no polygon, have none. Longitudes don't wrap. A ring of under three corners, or with a corner
    without a place, encloses nothing. The index is far smaller than the points; Spark broadcasts it below its own threshold
    and else joins by tile, splitting tiles with very many points.
    """
    ring = Window.partitionBy("polygon", "ring")
    bad = F.max(F.col("lat").isNull() | F.col("lon").isNull() | F.isnan("lat") | F.isnan("lon")).over(ring)
    index, held = tile_index(ring_edges(vertices.withColumn("_bad", bad).where(~F.col("_bad"))), side)
    place = lambda c: F.floor(F.col(c) / side)
    tiled = points.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)").withColumn("_band", place("lat")).withColumn("_column", place("lon"))
    names = [F.col("polygon"), F.col("band").alias("_band")]
    found = tiled.join(index.select(*names, F.col("column").alias("_column"), "crossed"), ["_band", "_column"])
    whole = found.where(~F.col("crossed"))
    split = found.where("crossed").join(held.select(*names, F.col("edges").alias("_edges")), ["polygon", "_band"]).where(odd_crossings(F.col("lat"), F.col("lon"), "_edges"))
    columns = [*points.columns, "polygon"]
    return whole.select(*columns).unionByName(split.select(*columns))


def mask_of(cells: DataFrame, vertices: DataFrame, side: float = SIDE) -> DataFrame:
    """``cells`` (.., lat, lon), distinct, with ``land``: whether their centre lies in any polygon."""
    inside = polygons_of(cells, vertices, side).drop("polygon").distinct().withColumn("_in", F.lit(True))
    return cells.join(inside, cells.columns, "left").withColumn("land", F.coalesce("_in", F.lit(False))).drop("_in")
