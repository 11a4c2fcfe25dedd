"""Plane geometry as Columns: everything stays in generated code. Coordinates are metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def square_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)


def cross(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Twice the signed area of a, b, c: above 0 if c lies to the left of a to b."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def point_segment_square(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Square distance of a point from a segment; a segment of no length is its point."""
    dx, dy = bx - ax, by - ay
    whole = dx * dx + dy * dy
    t = F.when(whole > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / whole))).otherwise(F.lit(0.0))
    return square_distance(px, py, ax + t * dx, ay + t * dy)


def segments_cross(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether two segments (x1, y1, x2, y2) cross properly, by the signs of four cross products."""
    s = lambda p, x, y: F.signum(cross(p[0], p[1], p[2], p[3], x, y))
    return (s(a, b[0], b[1]) * s(a, b[2], b[3]) < 0) & (s(b, a[0], a[1]) * s(b, a[2], a[3]) < 0)


def segment_segment_square(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Square distance of two segments: 0 if they cross, else the least of the four end distances."""
    ends = F.least(point_segment_square(a[0], a[1], *b), point_segment_square(a[2], a[3], *b), point_segment_square(b[0], b[1], *a), point_segment_square(b[2], b[3], *a))
    return F.when(segments_cross(a, b), F.lit(0.0)).otherwise(ends)


def span_square(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """length^2 of a segment to divide by: 1 for one of no length, whose products are 0 anyway. A join of segments takes it once a side."""
    whole = square_distance(x1, y1, x2, y2)
    return F.when(whole > 0, whole).otherwise(F.lit(1.0))


def point_reach_square(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column, whole: Column) -> Column:
    """point_segment_square() with the segment's span_square(). Of columns that can't be null it generates little code."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / whole))
    return square_distance(px, py, ax + t * (bx - ax), ay + t * (by - ay))


def segment_reach_square(a: tuple[Column, ...], b: tuple[Column, ...], whole_a: Column, whole_b: Column) -> Column:
    """segment_segment_square() with the segments' span_square()s."""
    ends = F.least(point_reach_square(a[0], a[1], *b, whole_b), point_reach_square(a[2], a[3], *b, whole_b), point_reach_square(b[0], b[1], *a, whole_a), point_reach_square(b[2], b[3], *a, whole_a))
    return F.when(segments_cross(a, b), F.lit(0.0)).otherwise(ends)


def foot_share(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column, whole: Column) -> Column:
    """Where on a segment (0 to 1) its point next to a point lies, with the segment's span_square()."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / whole))


def nearest_share(a: tuple[Column, ...], b: tuple[Column, ...], whole_a: Column, whole_b: Column, d2: Column) -> Column:
    """Where on segment b (0 to 1) its point next to segment a lies; d2: what segment_reach_square() gives."""
    turn = (a[2] - a[0]) * (b[3] - b[1]) - (a[3] - a[1]) * (b[2] - b[0])
    met = F.coalesce(F.try_divide((a[2] - a[0]) * (a[1] - b[1]) - (a[3] - a[1]) * (a[0] - b[0]), turn), F.lit(0.0))
    own = F.when(point_reach_square(a[0], a[1], *b, whole_b) <= d2, foot_share(a[0], a[1], *b, whole_b)).when(point_reach_square(a[2], a[3], *b, whole_b) <= d2, foot_share(a[2], a[3], *b, whole_b))
    own = own.when(point_reach_square(b[0], b[1], *a, whole_a) <= d2, F.lit(0.0)).otherwise(F.lit(1.0))
    return F.when(segments_cross(a, b), F.greatest(F.lit(0.0), F.least(F.lit(1.0), met))).otherwise(own)


def boxes_within(a: tuple[Column, ...], b: tuple[Column, ...], radius: float) -> Column:
    """Whether the boxes of two segments are at most radius apart on either axis: a cheap test before a distance."""
    axis = lambda i: (F.greatest(a[i], a[i + 2]) + radius >= F.least(b[i], b[i + 2])) & (F.greatest(b[i], b[i + 2]) + radius >= F.least(a[i], a[i + 2]))
    return axis(0) & axis(1)


def acute_angle(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    """The acute angle of two directions, in degrees."""
    return F.degrees(F.atan2(F.abs(ux * vy - uy * vx), F.abs(ux * vx + uy * vy)))


def deflection(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    """How far a path turns from direction u to v, in degrees from 0 to 180."""
    return F.degrees(F.atan2(F.abs(ux * vy - uy * vx), ux * vx + uy * vy))


def in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Whether a point lies inside a closed ring, an array of struct(x, y), by ray casting; on the boundary counts as inside."""
    n = F.size(ring)

    def step(odd: Column, i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, i + 1)
        above = (a["y"] > py) != (b["y"] > py)
        at = a["x"] + F.try_divide(py - a["y"], b["y"] - a["y"]) * (b["x"] - a["x"])
        return (odd + F.when(above & (px < at), 1).otherwise(0)) % 2

    inside = F.aggregate(F.sequence(F.lit(0), n - 2), F.lit(0), step) == 1
    edge = F.exists(F.sequence(F.lit(0), n - 2), lambda i: point_segment_square(px, py, F.get(ring, i)["x"], F.get(ring, i)["y"], F.get(ring, i + 1)["x"], F.get(ring, i + 1)["y"]) <= 1e-18)
    return F.when(n >= 4, inside | edge).otherwise(F.lit(False))


def in_rings(px: Column, py: Column, rings: Column) -> Column:
    """Whether a point lies inside an area of closed rings (shells and holes, by parity); on any boundary counts as inside."""

    def crossings(ring: Column) -> Column:
        def step(odd: Column, i: Column) -> Column:
            a, b = F.get(ring, i), F.get(ring, i + 1)
            at = a["x"] + F.try_divide(py - a["y"], b["y"] - a["y"]) * (b["x"] - a["x"])
            return odd + F.when(((a["y"] > py) != (b["y"] > py)) & (px < at), 1).otherwise(0)

        return F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(ring) - 2, F.lit(0))), F.lit(0), step)

    parity = F.aggregate(rings, F.lit(0), lambda n, ring: n + F.when(F.size(ring) >= 4, crossings(ring)).otherwise(0)) % 2 == 1
    return parity | (ring_distance_square(px, py, rings) <= 1e-18)


def in_corners(px: Column, py: Column, corners: list[tuple[Column, Column]], wholes: list[Column]) -> Column:
    """in_rings() for one closed ring whose corners, which may repeat, and span_square()s of edges are plain columns without nulls. It compiles where arrays are interpreted."""
    odd, edge = F.lit(0), []
    for (ax, ay), (bx, by), whole in zip(corners, corners[1:], wholes, strict=False):
        odd = odd + F.when(((ay > py) != (by > py)) & ((by > ay) == (cross(ax, ay, bx, by, px, py) > 0)), 1).otherwise(0)
        edge.append(point_reach_square(px, py, ax, ay, bx, by, whole))
    return (odd.bitwiseAND(F.lit(1)) == 1) | (F.least(*edge) <= 1e-18)


def ring_distance_square(px: Column, py: Column, rings: Column) -> Column:
    """Square distance of a point from the nearest edge of some rings, or lines."""
    edge = lambda r, i: point_segment_square(px, py, F.get(r, i)["x"], F.get(r, i)["y"], F.get(r, i + 1)["x"], F.get(r, i + 1)["y"])
    return F.array_min(F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) >= 2), lambda r: F.transform(F.sequence(F.lit(0), F.size(r) - 2), lambda i: edge(r, i)))))


def locate(points: Column, station: Column) -> Column:
    """The point of a polyline at a distance along it, as struct(x, y); beyond its ends, the ends."""
    start = F.struct(F.lit(0.0).alias("s"), F.get(points, F.lit(0))["x"].alias("x"), F.get(points, F.lit(0))["y"].alias("y"))

    def step(acc: Column, q: Column) -> Column:
        d = F.sqrt(square_distance(q["px"], q["py"], q["x"], q["y"]))
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(station - acc["s"], d), F.lit(0.0))))
        inside = station > acc["s"]
        return F.struct((acc["s"] + d).alias("s"), F.when(inside, q["px"] + t * (q["x"] - q["px"])).otherwise(acc["x"]).alias("x"), F.when(inside, q["py"] + t * (q["y"] - q["py"])).otherwise(acc["y"]).alias("y"))

    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(points) - 1, F.lit(1))), lambda i: F.struct(F.get(points, i - 1)["x"].alias("px"), F.get(points, i - 1)["y"].alias("py"), F.coalesce(F.get(points, i), F.get(points, i - 1))["x"].alias("x"), F.coalesce(F.get(points, i), F.get(points, i - 1))["y"].alias("y")))
    return F.aggregate(pairs, start, step, lambda a: F.struct(a["x"].alias("x"), a["y"].alias("y")))


def centroid(ring: Column) -> Column:
    """Centre of gravity of a closed ring as struct(x, y); of one without area, the mean of its points."""
    n = F.size(ring)
    p, q = lambda i: F.get(ring, i), lambda i: F.get(ring, i + 1)
    origin = F.get(ring, F.lit(0))
    part = lambda f: F.aggregate(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), F.lit(0.0), lambda a, i: a + F.coalesce(f(p(i)["x"] - origin["x"], p(i)["y"] - origin["y"], q(i)["x"] - origin["x"], q(i)["y"] - origin["y"]), F.lit(0.0)))
    area = part(lambda ax, ay, bx, by: ax * by - bx * ay)
    mean = lambda c: F.aggregate(ring, F.lit(0.0), lambda a, v: a + v[c]) / n
    axis = lambda c, f: F.when(F.abs(area) > 1e-12, origin[c] + part(f) / (3 * area)).otherwise(mean(c)).alias(c)
    return F.struct(axis("x", lambda ax, ay, bx, by: (ax + bx) * (ax * by - bx * ay)), axis("y", lambda ax, ay, bx, by: (ay + by) * (ax * by - bx * ay)))


def line_length(points: Column) -> Column:
    """Length of a polyline, an array of struct(x, y)."""
    return F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.size(points) - 2, F.lit(0))), F.lit(0.0),
        lambda total, i: total + F.coalesce(F.sqrt(square_distance(F.get(points, i)["x"], F.get(points, i)["y"], F.get(points, i + 1)["x"], F.get(points, i + 1)["y"])), F.lit(0.0)),
    )


# --- UTM, Krueger series to the fourth order; zone by central meridian (default 39 degrees: zone 37)

A, FLATTENING, SCALE, EAST = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
N = FLATTENING / (2 - FLATTENING)
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45, 7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45, 56 * N**3 / 15 - 136 * N**4 / 35, 4279 * N**4 / 630)


def to_utm(lon: Column, lat: Column, meridian: float = 39.0) -> tuple[Column, Column]:
    """East and north in metres of a WGS84 position, within a millimetre near the zone."""
    phi, lam = F.radians(lat), F.radians(lon - meridian)
    c = 2 * N**0.5 / (1 + N)
    atanh = lambda x: 0.5 * F.log((1 + x) / (1 - x))
    t = F.sinh(atanh(F.sin(phi)) - c * atanh(c * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EAST + SCALE * RADIUS * east, SCALE * RADIUS * north


def to_wgs84(x: Column, y: Column, meridian: float = 39.0) -> tuple[Column, Column]:
    """Longitude and latitude of a UTM position."""
    xi, eta = y / (SCALE * RADIUS), (x - EAST) / (SCALE * RADIUS)
    north, east = xi, eta
    for j, b in enumerate(BETA, 1):
        north = north - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(north) / F.cosh(east))
    phi = chi
    for j, d in enumerate(DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return meridian + F.degrees(F.atan2(F.sinh(east), F.cos(north))), F.degrees(phi)
