"""Geodesic and planar geometry as column expressions. Coordinates are degrees; planar points are x = longitude, y = latitude."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
EPSILON = 1e-10
#: Offset of a sidewalk from its street, in degrees.
SIDEWALK_OFFSET = 5.0e-5


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x)) if isinstance(x, int | float) else F.col(x)


def angular_distance(lat1, lng1, lat2, lng2) -> Column:
    """Great-circle angle in radians (haversine)."""
    lat1, lng1, lat2, lng2 = map(_c, (lat1, lng1, lat2, lng2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_km(lat1, lng1, lat2, lng2) -> Column:
    return angular_distance(lat1, lng1, lat2, lng2) * EARTH_KM


def angular_degrees(lat1, lng1, lat2, lng2) -> Column:
    return F.degrees(angular_distance(lat1, lng1, lat2, lng2))


def planar_radians(lat1, lng1, lat2, lng2) -> Column:
    """Euclidean distance of two points whose axes are radians of longitude and latitude."""
    lat1, lng1, lat2, lng2 = map(_c, (lat1, lng1, lat2, lng2))
    return F.sqrt(F.pow(F.radians(lng1) - F.radians(lng2), 2) + F.pow(F.radians(lat1) - F.radians(lat2), 2))


def bounding_box(lat, lng, km) -> Column:
    """struct<min_lat, min_lng, max_lat, max_lng, crosses> around a point, in degrees.

    A box over the antimeridian has min_lng > max_lng (crosses is true); one over a pole spans all longitudes. Negative km give null.
    """
    lat, lng, d = F.radians(_c(lat)), F.radians(_c(lng)), _c(km) / EARTH_KM
    low, high = lat - d, lat + d
    pole = (low <= -math.pi / 2) | (high >= math.pi / 2)
    delta = F.asin(F.sin(d) / F.cos(lat))
    west, east = lng - delta, lng + delta
    west = F.when(west < -math.pi, west + 2 * math.pi).otherwise(west)
    east = F.when(east > math.pi, east - 2 * math.pi).otherwise(east)
    min_lng, max_lng = F.when(pole, -math.pi).otherwise(west), F.when(pole, math.pi).otherwise(east)
    box = F.struct(
        F.degrees(F.greatest(low, F.lit(-math.pi / 2))).alias("min_lat"), F.degrees(min_lng).alias("min_lng"),
        F.degrees(F.least(high, F.lit(math.pi / 2))).alias("max_lat"), F.degrees(max_lng).alias("max_lng"), (min_lng > max_lng).alias("crosses"),
    )
    return F.when(_c(km) >= 0, box)


def box_of(lat: float, lng: float, km: float) -> tuple[float, float, float, float, bool]:
    """bounding_box() of a constant point, as numbers for pushed-down filters."""
    if km < 0:
        raise ValueError("a radius is never negative")
    y, x, d = math.radians(lat), math.radians(lng), km / EARTH_KM
    low, high = y - d, y + d
    if low <= -math.pi / 2 or high >= math.pi / 2:
        return math.degrees(max(low, -math.pi / 2)), -180.0, math.degrees(min(high, math.pi / 2)), 180.0, False
    delta = math.asin(math.sin(d) / math.cos(y))
    west, east = x - delta, x + delta
    west, east = west + 2 * math.pi * (west < -math.pi), east - 2 * math.pi * (east > math.pi)
    return math.degrees(low), math.degrees(west), math.degrees(high), math.degrees(east), west > east


def angle_to(lat1, lng1, lat2, lng2, exact: bool = True) -> Column:
    """Anticlockwise angle in radians from east; 0 for equal points.

    exact=False adds the acute angle to the start of the second and fourth quadrants instead of taking it from their end: right
    on the diagonals only, kept for results that must agree with earlier maps.
    """
    lat1, lng1, lat2, lng2 = map(_c, (lat1, lng1, lat2, lng2))
    dy, dx = lat2 - lat1, lng2 - lng1
    if exact:
        angle = F.atan2(dy, dx)
        return F.when((dx == 0) & (dy == 0), 0.0).when(angle < 0, angle + 2 * math.pi).otherwise(angle)
    acute = F.atan(F.abs(dy) / F.when(dx != 0, F.abs(dx)))
    axis = F.when((dx == 0) & (dy == 0), 0.0).when(dx == 0, F.when(dy > 0, math.pi / 2).otherwise(3 * math.pi / 2)).when(dy == 0, F.when(dx > 0, 0.0).otherwise(math.pi))
    turn = F.when((dy < 0) & (dx < 0), math.pi).when(dy < 0, 3 * math.pi / 2).when(dx < 0, math.pi / 2).otherwise(0.0)
    return F.coalesce(axis, acute + turn)


def destination(lat, lng, bearing, km) -> Column:
    """struct<lat, lng> in degrees, km away at a bearing clockwise from north."""
    y, x, t, d = F.radians(_c(lat)), F.radians(_c(lng)), F.radians(_c(bearing)), _c(km) / EARTH_KM
    y2 = F.asin(F.sin(y) * F.cos(d) + F.cos(y) * F.sin(d) * F.cos(t))
    x2 = x + F.atan2(F.sin(t) * F.sin(d) * F.cos(y), F.cos(d) - F.sin(y) * F.sin(y2))
    return F.struct(F.degrees(y2).alias("lat"), F.degrees(x2).alias("lng"))


def near(a, b) -> Column:
    return F.abs(_c(a) - _c(b)) < EPSILON


def at_least(a, b) -> Column:
    return (_c(a) > _c(b)) | near(a, b)


def at_most(a, b) -> Column:
    return (_c(a) < _c(b)) | near(a, b)


# Planar points, vectors and lines. A point is a pair of columns, a vector two points.


def distance(x1, y1, x2, y2) -> Column:
    return F.sqrt(F.pow(_c(x2) - _c(x1), 2) + F.pow(_c(y2) - _c(y1), 2))


def angle_at(x1, y1, x2, y2, x3, y3) -> Column:
    """The angle at the first point between the other two, by the law of cosines; null if it coincides with one."""
    a, b, c = distance(x1, y1, x2, y2), distance(x1, y1, x3, y3), distance(x2, y2, x3, y3)
    product = F.when((a > 0) & (b > 0), 2 * a * b)
    return F.when(product.isNotNull(), F.acos(F.greatest(F.least((a * a + b * b - c * c) / product, F.lit(1.0)), F.lit(-1.0))))


def vector_angle(x1, y1, x2, y2) -> Column:
    return F.atan2(_c(y2) - _c(y1), _c(x2) - _c(x1))


def positive_angle(x1, y1, x2, y2) -> Column:
    angle = vector_angle(x1, y1, x2, y2)
    return F.when(angle < 0, angle + 2 * math.pi).otherwise(angle)


def quadrant(angle) -> Column:
    angle = _c(angle)
    return F.when(angle > math.pi / 2, 2).when(angle >= 0, 1).when(angle < -math.pi / 2, 3).otherwise(4)


def anticlockwise_between(angle1, angle2) -> Column:
    """From the first direction to the second, 0 to 2 pi."""
    turn = _c(angle2) - _c(angle1)
    return F.when(turn < 0, turn + 2 * math.pi).otherwise(turn)


def parallel_vector(x1, y1, x2, y2, offset, anticlockwise: bool) -> Column:
    """struct<x1, y1, x2, y2> moved sideways by its unit normal; null for a vector without length."""
    x1, y1, x2, y2, d = map(_c, (x1, y1, x2, y2, offset))
    size = F.when(distance(x1, y1, x2, y2) > 0, distance(x1, y1, x2, y2))
    sign = 1 if anticlockwise else -1
    dx, dy = -(y2 - y1) / size * d * sign, (x2 - x1) / size * d * sign
    return F.struct((x1 + dx).alias("x1"), (y1 + dy).alias("y1"), (x2 + dx).alias("x2"), (y2 + dy).alias("y2"))


def point_along(x1, y1, x2, y2, d) -> Column:
    """struct<x, y> on the vector's line, d from its source; negative d lie behind it."""
    size = F.when(distance(x1, y1, x2, y2) > 0, distance(x1, y1, x2, y2))
    return F.struct((_c(x1) + (_c(x2) - _c(x1)) / size * _c(d)).alias("x"), (_c(y1) + (_c(y2) - _c(y1)) / size * _c(d)).alias("y"))


def line(x1, y1, x2, y2) -> Column:
    """struct<vertical, slope, intercept, x>: slope and intercept are null for a vertical line, x for others."""
    x1, y1, x2, y2 = map(_c, (x1, y1, x2, y2))
    upright = near(x1, x2)
    slope = (y1 - y2) / F.when(~upright, x1 - x2)
    return F.struct(upright.alias("vertical"), slope.alias("slope"), (y1 - slope * x1).alias("intercept"), F.when(upright, x1).alias("x"))


def line_at(l: Column, x) -> Column:
    return l["slope"] * _c(x) + l["intercept"]


def on_line(l: Column, x, y) -> Column:
    return F.when(l["vertical"], near(l["x"], x)).otherwise(line_at(l, x) == _c(y))


def parallel(l: Column, m: Column) -> Column:
    return F.when(l["vertical"] | m["vertical"], l["vertical"] & m["vertical"]).otherwise(near(l["slope"], m["slope"]))


def intersection(l: Column, m: Column) -> Column:
    """struct<x, y> where two lines meet, null for parallel ones; equal vertical lines meet at an infinite y."""

    def met(pair: Column) -> Column:
        l, m = pair["l"], pair["m"]
        both, slant = l["vertical"] & m["vertical"], ~l["vertical"] & ~m["vertical"]
        x = F.when(slant, (m["intercept"] - l["intercept"]) / F.when(~near(l["slope"], m["slope"]), l["slope"] - m["slope"])).when(l["vertical"], l["x"]).otherwise(m["x"])
        y = F.when(l["vertical"], line_at(m, x)).otherwise(line_at(l, x))
        out = F.struct(x.alias("x"), F.when(both, float("inf")).otherwise(y).alias("y"))
        return F.when(both, F.when(near(l["x"], m["x"]), out)).when(x.isNotNull(), out)

    # both lines are made once and named within the function: written out at each use they outgrow a compiled method
    return F.transform(F.array(F.struct(l.alias("l"), m.alias("m"))), met)[0]


def perpendicular(l: Column, x) -> Column:
    """The line at right angles through l's point at x; null for vertical lines, vertical for constant ones."""
    flat = near(l["slope"], 0)
    slope = -1 / F.when(~flat, l["slope"])
    return F.when(~l["vertical"], F.struct(flat.alias("vertical"), slope.alias("slope"), (line_at(l, x) - slope * _c(x)).alias("intercept"), F.when(flat, _c(x)).alias("x")))


def moved_line(l: Column, d, anticlockwise: bool) -> Column:
    sign = 1 if anticlockwise else -1
    return F.struct(l["vertical"].alias("vertical"), l["slope"].alias("slope"), (l["intercept"] + sign * _c(d)).alias("intercept"), (l["x"] - sign * _c(d)).alias("x"))


def compare_parallels(l: Column, m: Column) -> Column:
    """-1, 0 or 1 by altitude: x of vertical lines, intercept of others; null unless parallel."""
    return F.when(parallel(l, m), F.when(l["vertical"], F.signum(l["x"] - m["x"])).otherwise(F.signum(l["intercept"] - m["intercept"])).cast("int"))


def vector_holds(x1, y1, x2, y2, x, y) -> Column:
    between = lambda v, a, b: at_least(v, F.least(_c(a), _c(b))) & at_most(v, F.greatest(_c(a), _c(b)))
    return on_line(line(x1, y1, x2, y2), x, y) & between(x, x1, x2) & between(y, y1, y2)


def vectors_meet(v: list[Column], w: list[Column]) -> Column:
    """struct<x, y>: a shared endpoint first, else where the vectors' lines meet."""
    same = lambda i, j: near(v[i], w[j]) & near(v[i + 1], w[j + 1])
    point = lambda i: F.struct(_c(v[i]).alias("x"), _c(v[i + 1]).alias("y"))
    return F.when(same(0, 0) | same(0, 2), point(0)).when(same(2, 0) | same(2, 2), point(2)).otherwise(intersection(line(*v), line(*w)))


def in_polygon(lat, lng, ring: Column) -> Column:
    """Even-odd rule over ring, array<struct<lat, lng>>; the last vertex joins the first."""
    lat, lng = _c(lat), _c(lng)
    shifted = F.concat(F.slice(ring, F.size(ring), 1), F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        cut = (b["lng"] - a["lng"]) * (lat - a["lat"]) / F.when(b["lat"] != a["lat"], b["lat"] - a["lat"]) + a["lng"]
        return F.coalesce(((a["lat"] > lat) != (b["lat"] > lat)) & (lng < cut), F.lit(False))

    edges = F.zip_with(ring, shifted, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.size(F.filter(edges, crosses)) % 2 == 1


def polygon_in_polygon(inner: Column, outer: Column) -> Column:
    return F.forall(inner, lambda p: in_polygon(p["lat"], p["lng"], outer))


def readable(x) -> Column:
    return F.format_string("%1.2f", _c(x))


def cell_bounds(cell, columns: int, window: int) -> Column:
    """struct<top, left, bottom, right> of the cell with a number from 1, row by row; in closed form."""
    across = (columns - 1) // window
    at = _c(cell).cast("long") - 1
    row, column = F.floor(at / across), at % across
    return F.struct((row * window + 1).alias("top"), (column * window + 1).alias("left"), ((row + 1) * window + 1).alias("bottom"), ((column + 1) * window + 1).alias("right"))
