"""Scalar quality rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .grid import MAX_MM

# Coefficients of the size relation.
WITT_A, WITT_EXP, INCH_TO_CM = 15.096, 0.412, 2.54


# Latitude bands, and by month their heights in km of 0 and of -20 degrees.
BANDS = ((24, 32), (32, 38), (38, 44), (44, 51))
ISOTHERMS = {
    1: ((2.8, 5.5), (2.0, 4.8), (1.5, 4.2), (1.0, 3.8)),
    2: ((3.0, 5.6), (2.2, 5.0), (1.6, 4.3), (1.1, 3.9)),
    3: ((3.5, 6.0), (2.8, 5.5), (2.2, 4.8), (1.7, 4.3)),
    4: ((4.0, 6.5), (3.3, 6.0), (2.8, 5.5), (2.3, 4.8)),
    5: ((4.5, 7.0), (3.8, 6.5), (3.3, 6.0), (2.8, 5.5)),
    6: ((4.8, 7.3), (4.2, 7.0), (3.8, 6.5), (3.3, 6.0)),
    7: ((5.0, 7.5), (4.5, 7.2), (4.0, 6.8), (3.5, 6.3)),
    8: ((5.0, 7.5), (4.5, 7.2), (4.0, 6.8), (3.5, 6.3)),
    9: ((4.8, 7.3), (4.0, 6.8), (3.5, 6.3), (3.0, 5.8)),
    10: ((4.2, 6.8), (3.5, 6.2), (2.8, 5.5), (2.2, 5.0)),
    11: ((3.5, 6.2), (2.8, 5.5), (2.0, 4.8), (1.5, 4.2)),
    12: ((3.0, 5.7), (2.2, 5.0), (1.6, 4.3), (1.1, 3.9)),
}
SIZE_EXP = 0.206


def climate_isotherms(lat: Column, month: Column) -> tuple[Column, Column]:
    """Heights of 0 and -20 degrees by month and latitude band, 3.5 and 6 km outside the bands."""
    def pick(i, default):
        out = F.lit(default)
        for m, heights in ISOTHERMS.items():
            for (lo, hi), h in zip(BANDS, heights, strict=True):
                out = F.when((month == m) & (lat >= lo) & (lat < hi), h[i]).otherwise(out)
        return out

    return pick(0, 3.5), pick(1, 6.0)


def size_from_index(shi: Column) -> Column:
    """Size in mm from a column index; null for no index, or a size outside 5 to 300 mm."""
    mm = F.lit(WITT_A) * F.pow(shi, F.lit(SIZE_EXP))
    return F.when((shi > 0) & mm.between(5.0, MAX_MM), mm)


def is_bad(v: Column) -> Column:
    return v.isNull() | F.isnan(v) | (v < 0) | (v > MAX_MM)


def sanitize(v: Column) -> Column:
    """Null, NaN, infinite, negative or over the cap: 0."""
    return F.when(is_bad(v), 0.0).otherwise(v)


def recalibrate(v: Column) -> Column:
    return F.when(v > 0, F.lit(WITT_A) * F.pow(v / INCH_TO_CM, F.lit(WITT_EXP))).otherwise(0.0)


def environment_filter(v: Column, lat: Column, doy: Column) -> Column:
    """Under 5 mm is noise; south of 30 N in November to February, under 29 mm too."""
    winter = ((doy >= 305) | (doy <= 59)) & (lat < 30)
    return F.when((v < 5) | (winter & (v < 29)), 0.0).otherwise(v)


def probability_filter(v: Column, p: Column, lat: Column, doy: Column) -> Column:
    """Weighted by a model's probability; the closed-form filter where there is no score."""
    weighted = v * F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    return F.when(p.isNull(), environment_filter(v, lat, doy)).otherwise(sanitize(F.when(weighted < 5, 0.0).otherwise(weighted)))


def topo_factor(elevation_m: Column, freezing_km: Column | None = None) -> Column:
    """1.25 at most with a freezing level over 0.25 km, else 5 % a km up to 1.2."""
    km = F.least(F.greatest(elevation_m, F.lit(0.0)), F.lit(4000.0)) / 1000.0
    plain = F.lit(1.0) + km * 0.05
    if freezing_km is None:
        return F.least(F.greatest(plain, F.lit(1.0)), F.lit(1.2))
    level = F.when(~F.isnan(freezing_km) & (freezing_km > 0.25), freezing_km)
    return F.least(F.greatest(F.coalesce(F.lit(1.0) + km / level * 0.25, plain), F.lit(1.0)), F.lit(1.25))


def day_status(files: Column, active: Column, errors: Column) -> Column:
    return (
        F.when(files == 0, "missing_source")
        .when(errors >= files, "error")
        .when((errors > 0) & (active > 0), "ok_with_read_errors")
        .when(errors > 0, "no_hail_pixels_with_read_errors")
        .when(active == 0, "no_hail_pixels")
        .otherwise("ok")
    )


def keep_reflectivity(nobs: Column, necho: Column, weight: Column) -> Column:
    """False where echoes are rare among enough observations, or the weight is low."""
    rare = (nobs >= 3) & (necho / F.greatest(nobs, F.lit(1)) < 0.6)
    return ~(rare | (weight < 1.5))
