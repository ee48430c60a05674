"""Geometry on E7 coordinates, as column expressions. Integers are widened before they are subtracted."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres of a degree on the mean sphere, and its radius in two roundings.
M_PER_DEGREE = 111194.9
RADIUS, RADIUS_SHORT = 6371008.8, 6371000.0


def _deg(a: Column, b: Column) -> Column:
    return (b.cast("long") - a.cast("long")) / F.lit(1e7)


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on the equirectangular plane at the middle latitude."""
    middle = F.radians((lat1.cast("long") + lat2.cast("long")) / F.lit(2e7))
    dx, dy = _deg(lon1, lon2) * F.cos(middle), _deg(lat1, lat2)
    return F.sqrt(dx * dx + dy * dy) * F.lit(M_PER_DEGREE)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    s, t = F.sin(F.radians(_deg(lat1, lat2)) / 2), F.sin(F.radians(_deg(lon1, lon2)) / 2)
    a = s * s + F.cos(F.radians(lat1 / F.lit(1e7))) * F.cos(F.radians(lat2 / F.lit(1e7))) * t * t
    return 2 * F.lit(RADIUS) * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def haversine_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between points in degrees, in the two-argument arc tangent form."""
    s, t = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = s * s + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * t * t
    return 2 * F.lit(RADIUS_SHORT) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, 0 or more and below 360."""
    a, b, d = F.radians(lat1 / F.lit(1e7)), F.radians(lat2 / F.lit(1e7)), F.radians(_deg(lon1, lon2))
    y = F.sin(d) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def project(plat: Column, plon: Column, alat: Column, alon: Column, blat: Column, blon: Column) -> Column:
    """The point of segment a-b nearest to p: struct of t in 0..1 and its coordinates, on the plane at p's latitude."""
    k = F.cos(F.radians(plat / F.lit(1e7)))
    bx, by = (blon - alon) * k, (blat - alat).cast("double")
    px, py = (plon - alon) * k, (plat - alat).cast("double")
    length = bx * bx + by * by
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * bx + py * by) / length))).otherwise(F.lit(0.0))
    return F.struct(t.alias("t"), (alat + F.round(t * (blat - alat))).cast("long").alias("lat_e7"), (alon + F.round(t * (blon - alon))).cast("long").alias("lon_e7"))


def turn(before: Column, after: Column) -> Column:
    """Signed change of bearing, above -180 up to 180; negative to the left."""
    d = F.pmod(after - before, F.lit(360.0)) + 0.0  # never a negative zero
    return F.when(d > 180, d - 360).otherwise(d)


def modifier(angle: Column) -> Column:
    a = F.abs(angle)
    side = F.when(angle < 0, "left").otherwise("right")
    return (
        F.when(a < 25, F.lit("straight"))
        .when(a < 60, F.concat(F.lit("slight "), side))
        .when(a < 130, side)
        .when(a < 165, F.concat(F.lit("sharp "), side))
        .otherwise(F.lit("uturn"))
    )


def e7_to_e5(v: Column) -> Column:
    """Rounded to five decimals, halves away from zero."""
    size = F.abs(v.cast("long")) + 50
    return (F.sign(v) * (size - size % 100) / 100).cast("long")


def inside(lat: Column, lon: Column, min_lat: Column, min_lon: Column, max_lat: Column, max_lon: Column, margin_m: float) -> Column:
    """Inside a box widened by ``margin_m`` metres; a degree of longitude counts as 78 km."""
    dy, dx = int(margin_m / 111.195e-4), int(margin_m / 78e-4)
    return lat.between(min_lat - dy, max_lat + dy) & lon.between(min_lon - dx, max_lon + dx)


def _chunks(value: int) -> Iterator[str]:
    value = ~(value << 1) if value < 0 else value << 1
    while value >= 32:
        yield chr((32 | value & 31) + 63)
        value >>= 5
    yield chr(value + 63)


def encode_polyline(points: Iterable[tuple[int, int]]) -> str:
    """Points in 1e-5 degrees to text; a point equal to its predecessor is left out."""
    out, last = [], (0, 0)
    for i, p in enumerate(points):
        if i and p == last:
            continue
        out += [*_chunks(p[0] - last[0]), *_chunks(p[1] - last[1])]
        last = p
    return "".join(out)


def decode_polyline(text: str) -> list[tuple[int, int]]:
    numbers, value, shift = [], 0, 0
    for c in text:
        bits = ord(c) - 63
        value |= (bits & 31) << shift
        shift += 5
        if bits < 32:
            numbers.append(~(value >> 1) if value & 1 else value >> 1)
            value = shift = 0
    lat = lon = 0
    out = []
    for a, b in zip(numbers[::2], numbers[1::2]):
        lat, lon = lat + a, lon + b
        out.append((lat, lon))
    return out
