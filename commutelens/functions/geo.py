"""Great-circle distance and polygon centroid as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean earth radius in metres.
EARTH_RADIUS_M = 6371008.8


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points given in degrees."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(chord))


def ring_text(ring: Column) -> Column:
    """A closed ring of ``struct(lon, lat)`` as well-known text, to six decimals."""
    point = F.transform(ring, lambda p: F.format_string("%.6f %.6f", p["lon"], p["lat"]))
    return F.concat(F.lit("POLYGON(("), F.array_join(point, ","), F.lit("))"))


def ring_of(text: Column) -> Column:
    """The outer ring of a polygon in well-known text; NULL for a NULL text."""
    points = F.split(F.regexp_extract(text, r"\(\(\s*([^)]*)\)", 1), r"\s*,\s*")

    def part(p: Column, n: int) -> Column:
        return F.get(F.split(F.trim(p), r"\s+"), F.lit(n)).try_cast("double")

    ring = F.transform(points, lambda p: F.struct(part(p, 0).alias("lon"), part(p, 1).alias("lat")))
    return F.when(text.isNotNull(), ring)


def ring_centroid(ring: Column) -> Column:
    """Area centroid ``struct(lon, lat)`` of a closed ring of ``struct(lon, lat)``.

    Coordinates are taken relative to the first point, which keeps the shoelace
    products small and the result exact for cells a few hundred metres wide.
    """
    first = F.element_at(ring, 1)
    ends = F.slice(ring, F.lit(2), F.size(ring) - 1)
    starts = F.slice(ring, F.lit(1), F.size(ring) - 1)

    def term(a: Column, b: Column) -> Column:
        ax, ay = a["lon"] - first["lon"], a["lat"] - first["lat"]
        bx, by = b["lon"] - first["lon"], b["lat"] - first["lat"]
        cross = ax * by - bx * ay
        return F.struct(
            cross.alias("area2"), ((ax + bx) * cross).alias("mx"), ((ay + by) * cross).alias("my")
        )

    zero = F.struct(F.lit(0.0).alias("area2"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    return F.aggregate(
        F.zip_with(starts, ends, term),
        zero,
        lambda acc, t: F.struct(
            (acc["area2"] + t["area2"]).alias("area2"),
            (acc["mx"] + t["mx"]).alias("mx"),
            (acc["my"] + t["my"]).alias("my"),
        ),
        lambda acc: F.struct(
            (first["lon"] + acc["mx"] / (3 * acc["area2"])).alias("lon"),
            (first["lat"] + acc["my"] / (3 * acc["area2"])).alias("lat"),
        ),
    )
