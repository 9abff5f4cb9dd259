"""Geometry as column expressions over GeoJSON rings (array<array<array<double>>>)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Projection and radius constants, one per operator that needs its own.
METRES_PER_DEGREE = 111_320.0
LON_SCALE = math.cos(math.radians(54.7)) * METRES_PER_DEGREE
EARTH_RADIUS_QUERY_M = 6_371_008.8
EARTH_RADIUS_ROUTE_M = 6_371_000.0
MAX_MERCATOR_LAT = 85.051128


def project_x(lon: Column) -> Column:
    return lon * F.lit(LON_SCALE)


def project_y(lat: Column) -> Column:
    return lat * F.lit(METRES_PER_DEGREE)


def hypot(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float) -> Column:
    s1 = F.sin(F.radians(lat2 - lat1) / 2)
    s2 = F.sin(F.radians(lon2 - lon1) / 2)
    a = s1 * s1 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s2 * s2
    return F.lit(2.0 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def valid_coords(lat: Column, lon: Column) -> Column:
    return F.coalesce(
        ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0),
        F.lit(False),
    )


def in_bbox(lat: Column, lon: Column, bbox) -> Column:
    """Inclusive rectangle test; bbox is (west, south, east, north)."""
    west, south, east, north = bbox
    return lat.between(F.lit(south), F.lit(north)) & lon.between(F.lit(west), F.lit(east))


# --- rings -----------------------------------------------------------------

def outer_ring(rings: Column) -> Column:
    return F.element_at(rings, 1)


def holes(rings: Column) -> Column:
    return F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))


def px(p: Column) -> Column:
    return p.getItem(0)


def py(p: Column) -> Column:
    return p.getItem(1)


def segments(ring: Column) -> Column:
    """Consecutive vertex pairs as structs a, b."""
    n = F.size(ring)
    return F.zip_with(
        F.slice(ring, 1, F.greatest(n - 1, F.lit(0))),
        F.slice(ring, 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )


def envelope(ring: Column) -> dict[str, Column]:
    xs, ys = F.transform(ring, px), F.transform(ring, py)
    return {
        "min_lon": F.array_min(xs),
        "min_lat": F.array_min(ys),
        "max_lon": F.array_max(xs),
        "max_lat": F.array_max(ys),
    }


def ring_sums(ring: Column) -> Column:
    """Twice the signed area and the two first moments, summed edge by edge."""
    zero = F.struct(F.lit(0.0).alias("area2"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"))

    def step(acc: Column, s: Column) -> Column:
        x0, y0, x1, y1 = px(s["a"]), py(s["a"]), px(s["b"]), py(s["b"])
        cross = x0 * y1 - x1 * y0
        return F.struct(
            (acc["area2"] + cross).alias("area2"),
            (acc["cx"] + (x0 + x1) * cross).alias("cx"),
            (acc["cy"] + (y0 + y1) * cross).alias("cy"),
        )

    return F.aggregate(segments(ring), zero, step)


def ring_centroid(ring: Column) -> Column:
    """Area-weighted centroid struct(lon, lat); vertex mean for a degenerate ring."""
    sums = ring_sums(ring)
    n = F.size(ring).cast("double")
    mean = lambda pick: F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + pick(p)) / n
    flat = F.abs(sums["area2"]) < 1e-18
    return F.struct(
        F.when(flat, mean(px)).otherwise(sums["cx"] / (3 * sums["area2"])).alias("lon"),
        F.when(flat, mean(py)).otherwise(sums["cy"] / (3 * sums["area2"])).alias("lat"),
    )


def _crossings(lon: Column, lat: Column, ring: Column) -> Column:
    def crosses(s: Column) -> Column:
        x0, y0, x1, y1 = px(s["a"]), py(s["a"]), px(s["b"]), py(s["b"])
        spans = (y0 > lat) != (y1 > lat)
        return spans & (lon < (x1 - x0) * (lat - y0) / F.nullif(y1 - y0, F.lit(0.0)) + x0)

    hit = lambda s: F.coalesce(crosses(s), F.lit(False)).cast("int")
    return F.aggregate(F.transform(segments(ring), hit), F.lit(0), lambda a, b: a + b)


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    return _crossings(lon, lat, ring) % 2 == 1


def in_polygon(lon: Column, lat: Column, rings: Column) -> Column:
    """Half-open ray cast on the outer ring, holes taken out."""
    return in_ring(lon, lat, outer_ring(rings)) & ~F.exists(holes(rings), lambda h: in_ring(lon, lat, h))


def on_ring(lon: Column, lat: Column, ring: Column) -> Column:
    def touches(s: Column) -> Column:
        x0, y0, x1, y1 = px(s["a"]), py(s["a"]), px(s["b"]), py(s["b"])
        cross = (x1 - x0) * (lat - y0) - (y1 - y0) * (lon - x0)
        return (
            (cross == 0.0)
            & lon.between(F.least(x0, x1), F.greatest(x0, x1))
            & lat.between(F.least(y0, y1), F.greatest(y0, y1))
        )

    return F.exists(segments(ring), touches)


def covers(lon: Column, lat: Column, rings: Column) -> Column:
    """Boundary-inclusive cover: inside the outer ring and not strictly inside a hole."""
    outer = outer_ring(rings)
    in_hole = F.exists(holes(rings), lambda h: in_ring(lon, lat, h) & ~on_ring(lon, lat, h))
    return (in_ring(lon, lat, outer) | on_ring(lon, lat, outer)) & ~in_hole


def _segment_hits_box(s: Column, bbox) -> Column:
    """Closed segment against closed rectangle: bounds overlap and corners not all on one side."""
    west, south, east, north = [F.lit(float(v)) for v in bbox]
    x0, y0, x1, y1 = px(s["a"]), py(s["a"]), px(s["b"]), py(s["b"])
    overlap = (
        (F.least(x0, x1) <= east)
        & (F.greatest(x0, x1) >= west)
        & (F.least(y0, y1) <= north)
        & (F.greatest(y0, y1) >= south)
    )
    side = lambda x, y: (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)
    corners = [side(west, south), side(west, north), side(east, south), side(east, north)]
    return overlap & (F.least(*corners) <= 0.0) & (F.greatest(*corners) >= 0.0)


def intersects_bbox(rings: Column, bbox) -> Column:
    """Exact polygon and rectangle intersection, boundaries included, holes respected."""
    west, south, _, _ = bbox
    edge = F.exists(rings, lambda r: F.exists(segments(r), lambda s: _segment_hits_box(s, bbox)))
    return edge | covers(F.lit(float(west)), F.lit(float(south)), rings)


def proper_cross(s: Column, t: Column) -> Column:
    """Two segments cross at a point inside both."""
    side = lambda p, q, r: (px(q) - px(p)) * (py(r) - py(p)) - (py(q) - py(p)) * (px(r) - px(p))
    a, b, c, d = s["a"], s["b"], t["a"], t["b"]
    return (side(a, b, c) * side(a, b, d) < 0.0) & (side(c, d, a) * side(c, d, b) < 0.0)


def self_crossing(ring: Column) -> Column:
    segs = segments(ring)
    return F.exists(segs, lambda s: F.exists(segs, lambda t: proper_cross(s, t)))


def _three_distinct(ring: Column) -> Column:
    """Whether three positions differ from each other, in one walk along the ring."""
    start = F.struct(F.element_at(ring, 1).alias("a"), F.lit(None).cast("array<double>").alias("b"), F.lit(False).alias("more"))
    new = lambda s, p: (p != s["a"]) & F.coalesce(p != s["b"], F.lit(True))
    step = lambda s, p: F.struct(s["a"].alias("a"), F.when(s["b"].isNull() & new(s, p), p).otherwise(s["b"]).alias("b"), (s["more"] | (s["b"].isNotNull() & new(s, p))).alias("more"))
    return F.aggregate(ring, start, step, lambda s: s["more"])


def ring_problem(ring: Column) -> Column:
    """First broken rule of a ring, or NULL."""
    first, last = F.element_at(ring, 1), F.element_at(ring, -1)
    bad_position = F.exists(
        ring,
        lambda p: (F.size(p) != 2) | ~valid_coords(py(p), px(p)),
    )
    x, y = px(first), py(first)
    area = F.aggregate(
        segments(ring),
        F.lit(0.0),
        lambda acc, s: acc
        + (px(s["a"]) - x) * (py(s["b"]) - y)
        - (px(s["b"]) - x) * (py(s["a"]) - y),
    )
    return (
        F.when(ring.isNull() | (F.size(ring) < 4), "too_few_positions")
        .when(bad_position, "invalid_position")
        .when(first != last, "unclosed")
        .when(~_three_distinct(ring), "too_few_distinct")
        .when(area == 0.0, "zero_area")
    )


def polygon_problem(rings: Column, most: int | None = None) -> Column:
    """First broken rule of a polygon, or NULL; rings of more than `most` positions are not asked for crossings of their edges."""
    asked = rings if most is None else F.filter(rings, lambda r: F.size(r) <= most)
    ring_problems = F.filter(F.transform(rings, ring_problem), lambda p: p.isNotNull())
    return (
        F.when(rings.isNull() | (F.size(rings) < 1), "missing_rings")
        .when(F.size(ring_problems) > 0, F.element_at(ring_problems, 1))
        .when(F.exists(asked, self_crossing), "self_crossing")
    )


# --- slippy tiles ------------------------------------------------------------

def mercator_x(lon: Column) -> Column:
    return (lon + 180.0) / 360.0


def mercator_y(lat: Column) -> Column:
    clamped = F.least(F.lit(MAX_MERCATOR_LAT), F.greatest(F.lit(-MAX_MERCATOR_LAT), lat))
    t = F.tan(F.radians(clamped))
    return (1.0 - F.ln(t + F.sqrt(t * t + 1.0)) / math.pi) / 2.0


def tile_x(lon: Column, zoom: int) -> Column:
    return F.least(F.lit(2**zoom - 1).cast("bigint"), F.floor(mercator_x(lon) * float(2**zoom)))


def tile_y(lat: Column, zoom: int) -> Column:
    return F.least(F.lit(2**zoom - 1).cast("bigint"), F.floor(mercator_y(lat) * float(2**zoom)))


def tile_lon(x: Column, local_x: Column, zoom: int, extent: float) -> Column:
    return (x + local_x / extent) / float(2**zoom) * 360.0 - 180.0


def tile_lat(y: Column, local_y: Column, zoom: int, extent: float) -> Column:
    """Latitude of a position inside a tile whose local y axis points up."""
    n = float(2**zoom)
    return F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * (y + (extent - local_y) / extent) / n))))
