"""Geometry as column expressions: no UDFs, so they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.config import EARTH_CIRCUMFERENCE_M, EARTH_RADIUS_M, FRONTAGE_M_PER_DEG_LAT, M_PER_DEG_LAT


def is_finite(x: Column) -> Column:
    """False for null, NaN and infinities (Spark holds NaN equal to NaN and above every number)."""
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    s = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(s)))


def offset_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> tuple[Column, Column]:
    """East and north metres of the second point from the first, flat about the first's latitude."""
    return (lon2 - lon1) * M_PER_DEG_LAT * F.cos(F.radians(lat1)), (lat2 - lat1) * M_PER_DEG_LAT


def local_metres(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """The frontage projection: another metres-per-degree of latitude than offset_m()."""
    return (lon - lon0) * M_PER_DEG_LAT * F.cos(F.radians(lat0)), (lat - lat0) * FRONTAGE_M_PER_DEG_LAT


def point_to_edge_m(lon: Column, lat: Column, alon: Column, alat: Column, blon: Column, blat: Column) -> Column:
    """Distance to the nearest point of the edge a-b."""
    ax, ay = offset_m(lon, lat, alon, alat)
    bx, by = offset_m(lon, lat, blon, blat)
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / square))).otherwise(0.0)
    return F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))


def bearing_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle bearing, -180 to 180."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))


def compass(x: Column) -> Column:
    return (x + 360) % 360


def destination(lon: Column, lat: Column, distance_m: Column, bearing: Column) -> tuple[Column, Column]:
    a, d, t = F.radians(lat), distance_m / EARTH_RADIUS_M, F.radians(bearing)
    b = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(t))
    return lon + F.degrees(F.atan2(F.sin(t) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(b))), F.degrees(b)


def bearing_delta(a: Column, b: Column) -> Column:
    """0 to 180."""
    d = F.abs(a - b) % 360
    return F.when(d > 180, 360 - d).otherwise(d)


def undirected_heading(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """0 to 180, of a line in local metres."""
    return F.pmod(F.degrees(F.atan2(by - ay, bx - ax)), F.lit(180.0))


def heading_delta(a: Column, b: Column) -> Column:
    """0 to 90, between undirected headings."""
    d = F.abs(a - b) % 180
    return F.when(d > 90, 180 - d).otherwise(d)


def turn_deg(out_of: Column, into: Column) -> Column:
    return F.abs((((into - out_of) % 360) + 540) % 360 - 180)


def direction_for_bearing(heading: Column, tangent: Column, most: float = 45.0) -> Column:
    """forward, backward or null."""
    return F.when(bearing_delta(heading, tangent) <= most, "forward").when(bearing_delta(heading, (tangent + 180) % 360) <= most, "backward")


def metres_per_point(zoom: Column, lat: Column) -> Column:
    return EARTH_CIRCUMFERENCE_M * F.cos(F.radians(lat)) / (512 * F.pow(F.lit(2.0), zoom))


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def boxes_overlap(minx: Column, miny: Column, maxx: Column, maxy: Column, box: tuple[float, float, float, float]) -> Column:
    """Bounding boxes that touch: (min lon, min lat, max lon, max lat)."""
    return (maxx >= box[0]) & (minx <= box[2]) & (maxy >= box[1]) & (miny <= box[3])


def padded_box(minx: Column, miny: Column, maxx: Column, maxy: Column, pad_m: float) -> tuple[Column, Column, Column, Column]:
    """The box with `pad_m` metres around it (taken away where negative)."""
    lat = pad_m / M_PER_DEG_LAT
    lon = pad_m / (M_PER_DEG_LAT * F.cos(F.radians((miny + maxy) / 2)))
    return minx - lon, miny - lat, maxx + lon, maxy + lat


def inside_box(lon: Column, lat: Column, minx: Column, miny: Column, maxx: Column, maxy: Column, margin_m: float) -> Column:
    """Whether a point lies `margin_m` or more inside the box; never in a box that is smaller than its margins."""
    west, south, east, north = padded_box(minx, miny, maxx, maxy, -margin_m)
    return lon.between(west, east) & lat.between(south, north)


def padded_view(west: Column, south: Column, east: Column, north: Column, share: float = 0.2) -> tuple[Column, Column, Column, Column]:
    """(min lon, min lat, max lon, max lat) of a viewport, its corners in either order, with a share of its size on every side."""
    lon, lat = F.abs(east - west) * share, F.abs(north - south) * share
    return F.least(east, west) - lon, F.least(north, south) - lat, F.greatest(east, west) + lon, F.greatest(north, south) + lat


def covers(outer: tuple[Column, Column, Column, Column], inner: tuple[Column, Column, Column, Column]) -> Column:
    """Whether the first box (as of padded_view()) holds the second, so that a fetched answer still serves."""
    return (outer[0] <= inner[0]) & (outer[1] <= inner[1]) & (outer[2] >= inner[2]) & (outer[3] >= inner[3])
