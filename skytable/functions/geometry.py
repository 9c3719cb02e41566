"""Polygon functions as Column expressions.

A geometry is always array<array<array<struct<x,y>>>>: polygons, rings, points.
Rings are closed (the last point repeats the first).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from skytable.functions import projection

GEOMETRY = "array<array<array<struct<x:double,y:double>>>>"
SPHERE_RADIUS = 6371008.8
TILE_EPSILON = 1e-14
MERCATOR_LAT = 85.051129


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_ring(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """Closed ring of a box, counter-clockwise from the lower left corner."""
    return F.array(
        point(min_x, min_y), point(max_x, min_y), point(max_x, max_y), point(min_x, max_y), point(min_x, min_y)
    )


def box_geometry(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    return F.array(F.array(box_ring(min_x, min_y, max_x, max_y)))


def parse_wkt_polygon(text: Column) -> Column:
    """Geometry of a WKT POLYGON or MULTIPOLYGON; null for other text."""
    body = F.regexp_extract(text, r"(?is)^\s*(?:MULTI)?POLYGON\s*Z?\s*\((.*)\)\s*$", 1)
    is_multi = text.rlike(r"(?i)^\s*MULTIPOLYGON")
    polygons = F.when(is_multi, F.split(body, r"\)\s*\)\s*,\s*\(\s*\(")).otherwise(F.array(body))
    ring = lambda r: F.transform(
        F.split(F.trim(F.regexp_replace(r, r"[()]", "")), r"\s*,\s*"),
        lambda p: point(
            F.element_at(F.split(F.trim(p), r"\s+"), 1).try_cast("double"),
            F.try_element_at(F.split(F.trim(p), r"\s+"), F.lit(2)).try_cast("double"),
        ),
    )
    rings = lambda p: F.transform(F.split(p, r"\)\s*,\s*\("), ring)
    return F.when(F.length(body) > 0, F.transform(polygons, rings))


def map_points(geom: Column, fn: Callable[[Column], Column]) -> Column:
    """Apply a point function to every vertex."""
    return F.transform(geom, lambda poly: F.transform(poly, lambda ring: F.transform(ring, fn)))


def vertices(geom: Column) -> Column:
    """All vertices in one array."""
    return F.flatten(F.flatten(geom))


def vertex_count(geom: Column) -> Column:
    """Number of vertices over all rings."""
    return F.aggregate(
        F.flatten(geom), F.lit(0), lambda total, ring: total + F.size(ring)
    )


def bounds(geom: Column) -> Column:
    """Struct of min_x, min_y, max_x, max_y."""
    return let(
        vertices(geom),
        lambda points: F.struct(
            F.array_min(points["x"]).alias("min_x"), F.array_min(points["y"]).alias("min_y"),
            F.array_max(points["x"]).alias("max_x"), F.array_max(points["y"]).alias("max_y"),
        ),
    )


def edges(ring: Column) -> Column:
    """Consecutive point pairs of a closed ring as structs of p and q."""
    n = F.size(ring)
    return F.zip_with(
        F.slice(ring, 1, F.greatest(n - 1, F.lit(0))),
        F.slice(ring, 2, F.greatest(n - 1, F.lit(0))),
        lambda p, q: F.struct(p.alias("p"), q.alias("q")),
    )


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def signed_ring_area(ring: Column) -> Column:
    """Shoelace area of a closed ring, relative to its first point to keep precision."""
    first = F.element_at(ring, 1)
    return _total(
        F.transform(
            edges(ring),
            lambda e: (e["p"]["x"] - first["x"]) * (e["q"]["y"] - first["y"])
            - (e["q"]["x"] - first["x"]) * (e["p"]["y"] - first["y"]),
        )
    ) / 2


def planar_area(geom: Column) -> Column:
    """Area in the plane: outer rings minus holes, whatever their direction."""
    def polygon(poly):
        outer = F.abs(signed_ring_area(F.element_at(poly, 1)))
        holes = F.transform(
            F.slice(poly, 2, F.greatest(F.size(poly) - 1, F.lit(0))), lambda r: F.abs(signed_ring_area(r))
        )
        return outer - _total(holes)

    return _total(F.transform(geom, polygon))


def mercator_area_factor(lat: Column) -> Column:
    """How much Web Mercator overstates an area at a latitude."""
    return 1 / (F.cos(F.radians(lat)) * F.cos(F.radians(lat)))


def geodesic_area(geom: Column) -> Column:
    """Area on the ellipsoid: equal-area plane about the mean vertex, then shoelace.

    Ring directions count, as in a signed geodesic area whose absolute value is taken.
    """
    def center(points):
        n = F.size(points)
        return F.struct(
            (_total(points["x"]) / n).alias("lon"), projection.authalic(_total(points["y"]) / n).alias("beta")
        )

    def area(c):
        def flat(p):
            return let(
                projection.authalic(p["y"]),
                lambda beta: point(*projection.equal_area(p["x"], beta, c["lon"], c["beta"])),
            )

        plane = F.transform(F.flatten(geom), lambda ring: signed_ring_area_of(F.transform(ring, flat)))
        return F.abs(_total(plane))

    return let(let(vertices(geom), center), area)


def signed_ring_area_of(ring: Column) -> Column:
    """``signed_ring_area`` of a computed ring, computed once."""
    return let(ring, signed_ring_area)


def spherical_area(ring: Column) -> Column:
    """Area of a lon/lat ring on a sphere."""
    return F.abs(
        _total(
            F.transform(
                edges(ring),
                lambda e: F.radians(e["q"]["x"] - e["p"]["x"])
                * (2 + F.sin(F.radians(e["p"]["y"])) + F.sin(F.radians(e["q"]["y"]))),
            )
        )
        * SPHERE_RADIUS * SPHERE_RADIUS / 2
    )


def reproject(geom: Column, epsg: int, digits: int = 8) -> Column:
    """Lon/lat geometry in another system, coordinates rounded."""
    def rounded(x, y):
        return point(F.round(x, digits), F.round(y, digits))

    if epsg in (4326, 4258, 3857):
        return map_points(geom, lambda p: rounded(*projection.project(p["x"], p["y"], epsg)))
    zone, south, ellipsoid = projection.utm_parts(epsg)

    def move(p):
        angles = projection.utm_angles(p["x"], p["y"], F.lit(float(zone)), ellipsoid)
        return let(point(*angles), lambda a: rounded(*projection.utm_plane(a["x"], a["y"], F.lit(south), ellipsoid)))

    return map_points(geom, move)


def to_lonlat(geom: Column, epsg: int, digits: int = 7) -> Column:
    """Projected geometry back in lon/lat, coordinates rounded."""
    def rounded(x, y):
        return point(F.round(x, digits), F.round(y, digits))

    if epsg in (4326, 4258, 3857):
        return map_points(geom, lambda p: rounded(*projection.unproject(p["x"], p["y"], epsg)))
    zone, south, ellipsoid = projection.utm_parts(epsg)

    def on_sphere(s):
        lon = zone * 6.0 - 183.0 + F.degrees(F.atan2(F.sinh(s["y"]), F.cos(s["x"])))
        chi = F.asin(F.sin(s["x"]) / F.cosh(s["y"]))
        return let(chi, lambda c: rounded(lon, projection.geodetic_latitude(c, ellipsoid)))

    def move(p):
        start = point(*projection.utm_start(p["x"], p["y"], F.lit(south), ellipsoid))
        return let(let(start, lambda a: point(*projection.sphere_angles(a["x"], a["y"], ellipsoid))), on_sphere)

    return map_points(geom, move)


def _clip_half_plane(ring: Column, axis: str, limit: Column, keep_above: bool) -> Column:
    """Part of a closed ring on one side of an axis-parallel line, closed again."""
    def inside(p):
        return p[axis] >= limit if keep_above else p[axis] <= limit

    def crossing(p, q):
        t = (limit - p[axis]) / (q[axis] - p[axis])
        if axis == "x":
            return point(limit, p["y"] + t * (q["y"] - p["y"]))
        return point(p["x"] + t * (q["x"] - p["x"]), limit)

    def emit(e):
        p, q = e["p"], e["q"]
        return (
            F.when(inside(p) & inside(q), F.array(p))
            .when(inside(p), F.array(p, crossing(p, q)))
            .when(inside(q), F.array(crossing(p, q)))
            .otherwise(F.array().cast("array<struct<x:double,y:double>>"))
        )

    def close(kept):
        return F.when(F.size(kept) > 0, F.concat(kept, F.slice(kept, 1, 1))).otherwise(kept)

    return let(F.flatten(F.transform(edges(ring), emit)), close)


def clip_to_box(geom: Column, min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """Polygons cut by a box; rings without area and polygons without an outer ring are dropped."""
    sides = (("x", min_x, True), ("x", max_x, False), ("y", min_y, True), ("y", max_y, False))

    def ring(r, rest=sides):
        if not rest:
            return r
        return let(_clip_half_plane(r, *rest[0]), lambda part: ring(part, rest[1:]))

    def area(r):
        return F.when(F.size(r) > 3, F.abs(signed_ring_area(r))).otherwise(0.0)

    cut = F.transform(geom, lambda poly: F.filter(
        F.transform(poly, lambda r, i: let(ring(r), lambda k: F.struct(i.alias("i"), k.alias("ring"), area(k).alias("area")))),
        lambda r: r["area"] > 0,
    ))
    # The first ring must be left, and the holes must leave something of it.
    rest = lambda poly: _total(F.transform(poly, lambda r: F.when(r["i"] == 0, r["area"]).otherwise(-r["area"])))
    solid = F.filter(cut, lambda poly: F.exists(poly, lambda r: (r["i"] == 0) & (rest(poly) > 1e-12 * r["area"])))
    return F.transform(solid, lambda poly: F.transform(poly, lambda r: r["ring"]))


def is_rectangle(geom: Column) -> Column:
    """One ring of four sides along the axes, with area."""
    ring = F.flatten(F.flatten(geom))

    def sides(r, level, upright):
        p = [F.get(r, i) for i in range(5)]
        level_first = (p[0][level] == p[1][level]) & (p[2][level] == p[3][level]) & (p[1][upright] == p[2][upright]) & (p[3][upright] == p[0][upright])
        return level_first & (p[0]["x"] != p[2]["x"]) & (p[0]["y"] != p[2]["y"]) & (p[0] == p[4])

    single = (F.size(geom) == 1) & (F.size(F.element_at(geom, 1)) == 1) & (F.size(F.flatten(F.flatten(geom))) == 5)
    return F.when(single, let(ring, lambda r: sides(r, "y", "x") | sides(r, "x", "y"))).otherwise(F.lit(False))


def contains_point(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule for a closed ring."""
    crossings = F.aggregate(
        edges(ring),
        F.lit(0),
        lambda n, e: n
        + F.when(
            ((e["p"]["y"] > y) != (e["q"]["y"] > y))
            & (x < F.try_divide((e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]), e["q"]["y"] - e["p"]["y"]) + e["p"]["x"]),
            F.lit(1),
        ).otherwise(F.lit(0)),
    )
    return crossings % 2 == 1


def segment_meets_box(p: Column, q: Column, min_x, min_y, max_x, max_y) -> Column:
    """A segment and a box share a point (separating axes: x, y and the segment's normal)."""
    apart = (
        (F.greatest(p["x"], q["x"]) < min_x) | (F.least(p["x"], q["x"]) > max_x)
        | (F.greatest(p["y"], q["y"]) < min_y) | (F.least(p["y"], q["y"]) > max_y)
    )

    def side(x, y):
        return (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"])

    corners = [side(min_x, min_y), side(max_x, min_y), side(max_x, max_y), side(min_x, max_y)]
    one_side = (F.least(*corners) > 0) | (F.greatest(*corners) < 0)
    return ~apart & ~one_side


def polygon_meets_box(geom: Column, min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """A polygon and a box share a point: an edge meets the box, or the box lies inside."""
    rings = F.flatten(geom)
    edge_hit = F.exists(
        rings,
        lambda r: F.exists(edges(r), lambda e: segment_meets_box(e["p"], e["q"], min_x, min_y, max_x, max_y)),
    )
    inside = F.aggregate(
        rings, F.lit(0), lambda n, r: n + contains_point(r, min_x, min_y).cast("int")
    ) % 2 == 1
    return edge_hit | inside


def pixel_to_world(row: Column, col: Column, transform: Column) -> Column:
    """Upper-left corner of a pixel by a 6- or 9-value affine array (a b c d e f)."""
    t = [F.element_at(transform, i) for i in range(1, 7)]
    return point(t[0] * col + t[1] * row + t[2], t[3] * col + t[4] * row + t[5])


def transform_from_bounds(left: Column, bottom: Column, right: Column, top: Column, width: Column, height: Column) -> Column:
    """Affine array of a north-up raster."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(
        (right - left) / width, zero, left, zero, (bottom - top) / height, top, zero, zero, one
    )


def tile_x(lon: Column, zoom: int) -> Column:
    """Map-tile column of a longitude."""
    n = float(2**zoom)
    x = F.floor((lon / 360.0 + 0.5 + TILE_EPSILON) * n)
    return F.greatest(F.lit(0), F.least(F.lit(2**zoom - 1), x)).cast("bigint")


def tile_y(lat: Column, zoom: int) -> Column:
    """Map-tile row of a latitude, counted from the north."""
    n = float(2**zoom)
    sine = F.sin(F.radians(F.greatest(F.lit(-MERCATOR_LAT), F.least(F.lit(MERCATOR_LAT), lat))))
    y = F.floor((0.5 - 0.25 * F.log((1 + sine) / (1 - sine)) / math.pi + TILE_EPSILON) * n)
    return F.greatest(F.lit(0), F.least(F.lit(2**zoom - 1), y)).cast("bigint")


def quadkey(x: Column, y: Column, zoom: int) -> Column:
    """Quadkey text: per zoom level one digit of the x bit and twice the y bit."""
    digits = [
        (F.shiftright(x, bit).bitwiseAND(F.lit(1)) + 2 * F.shiftright(y, bit).bitwiseAND(F.lit(1))).cast("string")
        for bit in range(zoom - 1, -1, -1)
    ]
    return F.concat(*digits)


def geometry_json(geom: Column, geom_type: Column | None = None) -> Column:
    """GeoJSON geometry text; one polygon without a given type becomes Polygon."""
    rings = F.transform(
        geom, lambda poly: F.transform(poly, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    )
    kind = F.when(F.size(geom) == 1, F.lit("Polygon")).otherwise(F.lit("MultiPolygon"))
    if geom_type is not None:
        kind = F.coalesce(geom_type, kind)
    body = F.when(kind == "Polygon", F.to_json(F.element_at(rings, 1))).otherwise(F.to_json(rings))
    return F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), body, F.lit("}"))
