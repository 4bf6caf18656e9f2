"""Instants, coordinates and regions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
MILLIS_FROM = 10**12


def source_timestamp(x: Column) -> Column:
    """Seconds or (from 10^12) milliseconds since 1970, or an ISO string with a zone; null for all else and before 1970."""
    t = F.trim(x)
    number = F.when(t.rlike("^-?\\d+$"), t.try_cast("long"))
    iso = F.when(t.rlike("^\\d{4}-\\d{2}-\\d{2}T.*(Z|[+-]\\d{2}:\\d{2})$"), F.try_to_timestamp(t))
    return F.when(t.rlike("^-?\\d+$"), F.when(number >= MILLIS_FROM, F.timestamp_millis(number)).when(number >= 0, F.timestamp_seconds(number))).otherwise(iso)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def positions(coordinates: Column) -> Column:
    """All pairs of a coordinates text, however deep they lie; positions of three numbers are passed over."""
    pair = "\\[\\s*(-?[0-9.eE+-]+)\\s*,\\s*(-?[0-9.eE+-]+)\\s*\\]"
    xs, ys = (F.regexp_extract_all(coordinates, F.lit(pair), F.lit(g)) for g in (1, 2))
    return F.zip_with(xs, ys, lambda x, y: F.struct(x.try_cast("double").alias("lon"), y.try_cast("double").alias("lat")))


def middle(points: Column) -> Column:
    """The middle of the box around the points."""
    lon, lat = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    centre = lambda v: (F.array_min(v) + F.array_max(v)) / 2.0
    return F.when(F.size(points) > 0, F.struct(centre(lon).alias("lon"), centre(lat).alias("lat")))


def representative(kind: Column, coordinates: Column) -> Column:
    """``lon``, ``lat`` for a geometry: the point, a line's first point, the middle of a polygon's box."""
    number = "-?[0-9.]+(?:[eE][+-]?[0-9]+)?"
    first = lambda g: F.regexp_extract(coordinates, f"({number})\\s*,\\s*({number})", g).try_cast("double")
    point = F.when(first(1).isNotNull() & first(2).isNotNull(), F.struct(first(1).alias("lon"), first(2).alias("lat")))
    return F.when(kind.isin("Point", "LineString"), point).when(kind.isin("Polygon", "MultiPolygon"), middle(positions(coordinates)))


def around(lat: Column, lon: Column, degrees: float = 0.18) -> Column:
    """The box that stands for a place of which only the middle is known."""
    return F.struct((lat - degrees).alias("south"), (lon - degrees).alias("west"), (lat + degrees).alias("north"), (lon + degrees).alias("east"))


def quadrants(box: Column) -> Column:
    """The four quarters of a box, the nearest to its middle first, then from the south and the west."""
    lat, lon = (box["south"] + box["north"]) / 2, (box["west"] + box["east"]) / 2
    quarter = lambda s, w, n, e: F.struct(s.alias("south"), w.alias("west"), n.alias("north"), e.alias("east"))
    parts = F.array(quarter(box["south"], box["west"], lat, lon), quarter(box["south"], lon, lat, box["east"]), quarter(lat, box["west"], box["north"], lon), quarter(lat, lon, box["north"], box["east"]))
    far = F.transform(parts, lambda q: F.struct(haversine_km(lat, lon, (q["south"] + q["north"]) / 2, (q["west"] + q["east"]) / 2).alias("km"), q["south"].alias("south"), q["west"].alias("west"), q.alias("box")))
    return F.transform(F.array_sort(far), lambda x: x["box"])
