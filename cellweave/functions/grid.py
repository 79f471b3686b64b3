"""Grid geometry: a 0.05-degree grid, row 0 in the north, column 0 in the west."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the grid and of the thresholds.
DX = 0.05
NROWS, NCOLS = 520, 1180
LAT_MAX, LON_MIN = 50.005, -125.005
DAMAGE_MM, EVENT_MM, MAX_MM, MM_PER_INCH = 25.4, 29.0, 300.0, 25.4
EARTH_KM = 6371.0
THRESHOLDS_MM = tuple(round(t * MM_PER_INCH, 6) for t in (0.25, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 5.0))


def latlon_to_cell(lat: Column, lon: Column) -> Column:
    """struct(cell_row, cell_col); (-1, -1) outside. Truncation toward zero: up to a cell beyond the north and west
    edges is row or column 0."""
    row, col = ((F.lit(LAT_MAX) - lat) / DX).cast("int"), ((lon - F.lit(LON_MIN)) / DX).cast("int")
    inside = row.between(0, NROWS - 1) & col.between(0, NCOLS - 1)
    return F.struct(F.when(inside, row).otherwise(-1).alias("cell_row"), F.when(inside, col).otherwise(-1).alias("cell_col"))


def clamped_cell(lat: Column, lon: Column, rows: int, cols: int, dx: float, north: float, west: float) -> Column:
    """Like ``latlon_to_cell`` but the last edge belongs to the last cell."""
    row = F.least(((F.lit(north) - lat) / dx).cast("int"), F.lit(rows - 1))
    col = F.least(((lon - F.lit(west)) / dx).cast("int"), F.lit(cols - 1))
    return F.struct(row.alias("cell_row"), col.alias("cell_col"))


def cell_center(row: Column, col: Column) -> tuple[Column, Column]:
    return F.lit(LAT_MAX) - (row + 0.5) * DX, F.lit(LON_MIN) + (col + 0.5) * DX


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0)))) * (2 * EARTH_KM)


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"asin(sqrt(least(greatest({a}, 0e0), 1e0))) * {2 * EARTH_KM}e0"


def azimuth_deg(site_lat: Column, site_lon: Column, lat: Column, lon: Column) -> Column:
    """Planar azimuth from a site to a point, 0 to 360."""
    return F.pmod(F.degrees(F.atan2((lon - site_lon) * F.cos(F.radians(site_lat)), lat - site_lat)) + 360.0, F.lit(360.0))


def range_bin(km: Column, width: float = 10.0, bins: int = 40) -> Column:
    """Equal-width range bins, the last one open."""
    return F.least(F.greatest(F.floor(km / width), F.lit(0)), F.lit(bins - 1)).cast("int")


COARSE_EDGES = (0.0, 25.0, 50.0, 75.0, 100.0, 125.0, 150.0, 175.0, 200.0, 250.0, 300.0, 400.0)


def edge_bin(value: Column, edges: tuple[float, ...]) -> Column:
    """Index of the half-open interval between edges, clipped to the first and last."""
    found = sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0)) - 1
    return F.least(F.greatest(found, F.lit(0)), F.lit(len(edges) - 2)).cast("int")


def quarter_inch(size: Column) -> Column:
    return F.abs(size - F.bround(size * 4) / 4) < 0.02
