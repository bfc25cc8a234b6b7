"""Distances and space-filling-curve cells as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
#: Bits per axis of a cell code.
LEVEL = 20


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance in kilometres."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def wrap_lon(lon: Column) -> Column:
    """``lon`` counted on around the globe, in [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def _spread(x: Column) -> Column:
    """Bits of a 32-bit number moved to the even places."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def morton(lat: Column, lon: Column, level: int = LEVEL) -> Column:
    """Z-order code of a position; lon must lie in [-180, 180)."""
    n = 1 << level
    iy = F.least(F.floor((lat + 90.0) / 180.0 * n), F.lit(n - 1)).cast("long")
    ix = F.least(F.floor((lon + 180.0) / 360.0 * n), F.lit(n - 1)).cast("long")
    return F.shiftleft(_spread(iy), 1).bitwiseOR(_spread(ix))


def lon_delta(a: Column, b: Column) -> Column:
    """The shorter way round from longitude a to b, in [-180, 180)."""
    return F.pmod(b - a + 180.0, F.lit(360.0)) - 180.0


def equal_area_cell(lat: Column, lon: Column, rows: int = 12, columns: int = 24) -> Column:
    """Key of a cylindrical equal-area cell: bands of equal sine of latitude, longitude 180 counted as -180."""
    i = F.greatest(F.lit(0), F.least(F.lit(rows - 1), F.floor((F.sin(F.radians(lat)) + 1) / 2 * rows)))
    x = F.when(lon == 180, -180.0).otherwise(lon)
    j = F.greatest(F.lit(0), F.least(F.lit(columns - 1), F.floor((x + 180) / 360 * columns)))
    return F.concat(F.lit(f"ea{rows}x{columns}:"), i.cast("string"), F.lit(":"), j.cast("string"))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial great-circle bearing in degrees [0, 360); null for equal points."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y, x = F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.when(~((lat1 == lat2) & (lon1 == lon2)), F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)))


def sector(degrees: Column) -> Column:
    """One of eight half-open sectors around the compass, 0 for north."""
    return F.floor((degrees + 22.5) / 45) % 8


def mercator_pixel(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """(x, y) in Web Mercator pixels."""
    size = float(256 << zoom)
    phi = F.radians(F.greatest(F.lit(-85.05112878), F.least(F.lit(85.05112878), lat)))
    return (lon + 180) / 360 * size, (1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / F.lit(3.141592653589793)) / 2 * size


def distance_class(km: Column, uncertainty_km: Column, radius_km: float) -> Column:
    """near, far or ambiguous, as the uncertainty leaves open."""
    return F.when(km + uncertainty_km <= radius_km, "near").when(km - uncertainty_km > radius_km, "far").otherwise("ambiguous")


def solar_minutes(day: Column, lat: Column, lon: Column, offset_minutes: Column, rising: bool) -> Column:
    """Local minutes of sunrise or sunset by the equation of time; null where the sun stays up or down."""
    g = 2 * 3.141592653589793 / 365 * (F.dayofyear(day) - 1)
    # Coefficients of the fractional-year series for the equation of time and the declination.
    eqtime = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    decl = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    phi = F.radians(lat)
    cos_h = F.cos(F.radians(F.lit(90.833))) / (F.cos(phi) * F.cos(decl)) - F.tan(phi) * F.tan(decl)
    angle = F.degrees(F.acos(F.when(F.abs(cos_h) <= 1, cos_h)))
    return F.pmod(720 - 4 * (lon + (angle if rising else -angle)) - eqtime + offset_minutes, F.lit(1440.0))
