"""Valid-data footprints of scenes: decimate, label, polygons, simplify, repair, bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytable.functions import geometry as geo
from skytable.functions import planar
from skytable.functions import pixels as px
from skytable.functions import planar_batch
from skytable.operators import components as comp
from skytable.operators.skew import salted_join, spread
from skytable.session import materialize

PROBE_PX = 1024
MIN_BLOB_PX = 24
SIMPLIFY_PX = 1.5
MAX_VERTICES = 1500
DOUBLINGS = 6
PLAIN = "array<array<array<array<double>>>>"
_ARROW = pa.list_(pa.list_(pa.list_(pa.list_(pa.float64()))))


def _plain(geom: Column) -> Column:
    """Points as pairs, the form that goes to Python."""
    return F.transform(geom, lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.array(q["x"], q["y"]))))


def _points(geom: Column) -> Column:
    return F.transform(geom, lambda p: F.transform(p, lambda r: F.transform(r, lambda q: geo.point(q[0], q[1]))))


def _ring_area(ring: np.ndarray) -> float:
    x, y = (ring - ring[0]).T
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def simplify_polygons(polygons: list, tolerance: float, limit: int = MAX_VERTICES) -> list:
    """Simplify with a tolerance that doubles until the vertices fit, six times at most.

    All rings of all polygons are thinned together, so none crosses another one afterwards, and none is lost.
    """
    rings = [np.asarray([list(q) for q in r], float) for p in polygons for r in p]
    if not rings or any(len(r) < 4 for r in rings):
        return [[[list(q) for q in r] for r in p] for p in polygons]
    simple = planar.thinned(rings, tolerance)
    for _ in range(DOUBLINGS):
        if sum(map(len, simple)) <= limit:
            break
        tolerance *= 2
        simple = planar.thinned(rings, tolerance)
    parts = iter(simple)
    return [[next(parts).tolist() for _ in p] for p in polygons]


def simplify_bounded(geom: Column, tolerance: float = SIMPLIFY_PX, limit: int = MAX_VERTICES) -> Column:
    """Geometry with a bounded number of vertices; one geometry is one row of a probe of bounded size."""

    def run(values: pa.Array) -> pa.Array:
        return planar_batch.simplify(values, tolerance, limit, DOUBLINGS, lambda g: simplify_polygons(g, tolerance, limit))

    return F.arrow_udf(run, geo.GEOMETRY)(geom.cast(geo.GEOMETRY))


def _simple_rings(ring: list) -> list:
    """Rings without repeated points: spikes are cut, and a ring that touches itself is cut in parts."""
    parts, stack, seen = [], [], {}
    for point in [tuple(p) for p in ring]:
        if point in seen:
            start = seen[point]
            loop = stack[start:] + [point]
            if len(loop) >= 4 and _ring_area(np.asarray(loop)):
                parts.append([list(p) for p in loop])
            for dropped in stack[start + 1:]:
                del seen[dropped]
            del stack[start + 1:]
        else:
            seen[point] = len(stack)
            stack.append(point)
    return parts


def _crosses(ring: list) -> bool:
    """Two edges of a ring cross properly."""
    p = np.asarray(ring, float)
    a, b = p[:-1], p[1:]

    def side(o, d, q):
        return np.sign(d[0] * (q[:, 1] - o[1]) - d[1] * (q[:, 0] - o[0]))

    for i in range(len(a) - 2):
        c, d = a[i + 2:], b[i + 2:]
        one = side(a[i], b[i] - a[i], c) * side(a[i], b[i] - a[i], d) < 0
        if not one.any():
            continue
        u, v = c[one], d[one]
        w = v - u
        s0 = np.sign(w[:, 0] * (a[i][1] - u[:, 1]) - w[:, 1] * (a[i][0] - u[:, 0]))
        s1 = np.sign(w[:, 0] * (b[i][1] - u[:, 1]) - w[:, 1] * (b[i][0] - u[:, 0]))
        if (s0 * s1 < 0).any():
            return True
    return False


def repair_polygons(polygons: list) -> list | None:
    """Valid polygons, or None when nothing usable is left or edges cross."""
    out = []
    for polygon in polygons:
        outers = _simple_rings([list(q) for q in polygon[0]])
        holes = [part for hole in polygon[1:] for part in _simple_rings([list(q) for q in hole])]
        if any(_crosses(r) for r in outers + holes):
            return None
        # Loops cut off an outer ring against its direction are holes of it.
        main = max(outers, key=lambda r: abs(_ring_area(np.asarray(r))), default=None)
        if main is None:
            continue
        sign = np.sign(_ring_area(np.asarray(main)))
        holes += [r for r in outers if np.sign(_ring_area(np.asarray(r))) != sign]
        outers = [r for r in outers if np.sign(_ring_area(np.asarray(r))) == sign]
        placed = [[r] for r in outers]
        for hole in holes:
            home = next((p for p in placed if _inside(hole, p[0])), None)
            if home is not None:
                home.append(hole)
        out += placed
    return out or None


def _inside(hole: list, ring: list) -> bool:
    """A hole lies in a ring: the middle of one of its edges does, by the even-odd rule."""
    q, h = np.asarray(ring, float), np.asarray(hole, float)
    x, y = (h[0] + h[1]) / 2
    a, b = q[:-1], q[1:]
    cross = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return bool((cross & (x < at)).sum() % 2)


def repair(geom: Column) -> Column:
    """Repaired geometry, or null when it is unusable."""

    @F.pandas_udf(PLAIN)
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda g: None if g is None else repair_polygons(g))

    return _points(run(_plain(geom)))


VALID = f"struct<geom:{geo.GEOMETRY},reason:string>"


def _rings(polygons) -> list:
    return [[[tuple(q) for q in r] for r in p] for p in polygons]


def _valid(polygons) -> tuple[list | None, str | None]:
    given = _rings(polygons)
    if all(planar.is_simple(p) for p in given) and planar.holes_fit(given):
        return given, None
    fixed = planar.overlay([r for p in given for r in p])
    return (fixed, "repaired") if fixed else (None, "no area")


def make_valid(geom: Column) -> Column:
    """Struct of ``geom`` and ``reason``: valid polygons of what lies inside the rings by the even-odd rule.

    A valid geometry stays as it is and has no reason. Rings that cross are cut at the crossings (``repaired``): a bow tie gives two
    polygons, a spike goes, and parts that lie on one another twice are outside. ``no area`` leaves no geometry.
    """

    def run(values: pa.Array) -> pa.Array:
        return planar_batch.valid(values, _valid)

    return F.arrow_udf(run, VALID)(geom.cast(geo.GEOMETRY))


CUT = f"struct<geom:{PLAIN},area:double>"


def cut_to_box(df: DataFrame, name: str, geom: Column, *box: Column) -> DataFrame:
    """Add the struct ``name`` of ``geom``, the true parts of a polygon inside a box, and ``area``, that of the valid polygon before the cut.

    The geometry is null where nothing is left. A polygon that is valid and lies inside stays as it is.
    """

    def run(values: pa.Array, x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array) -> pa.Array:
        found = []
        for g, left, bottom, right, top in zip(*[v.to_pylist() for v in (values, x0, y0, x1, y1)]):
            whole = None if g is None else _valid(g)[0]
            if not whole:
                found.append({"geom": None, "area": None})
                continue
            size = sum(abs(_ring_area(np.asarray(r))) * (-1 if k else 1) for p in whole for k, r in enumerate(p))
            points = np.concatenate([np.asarray(r) for p in whole for r in p])
            inside = (points >= (left, bottom)).all() and (points <= (right, top)).all()
            part = whole if inside else planar.overlay([r for p in whole for r in p], (left, bottom, right, top))
            found.append({"geom": part or None, "area": size})
        return pa.array(found, pa.struct([("geom", _ARROW), ("area", pa.float64())]))

    # Marked so that later filters and projections do not run it again.
    cut = spread(df).withColumn(name, F.arrow_udf(run, CUT).asNondeterministic()(_plain(geom), *box))
    return cut.withColumn(name, F.struct(_points(F.col(name)["geom"]).alias("geom"), F.col(name)["area"].alias("area")))


def footprints(blocks: DataFrame, rasters: DataFrame, side: int, epsg: int, probe: int = PROBE_PX, min_blob: int = MIN_BLOB_PX) -> DataFrame:
    """Footprint of each raster from its validity mask: one row per row of ``rasters``.

    ``blocks`` hold ``mask`` per block; ``rasters`` hold width, height and the
    affine array ``transform``. Only every f-th pixel leaves its block, so that a
    raster becomes a probe of about probe x probe pixels; the later steps that hold
    one raster in a row are bounded by that. A raster without a footprint has a
    null geometry and tells why in ``reason``.
    """
    meta = rasters.withColumn("f", px.decimation(F.col("width"), F.col("height"), probe)).withColumn(
        "w", F.greatest(F.lit(1), F.floor(F.col("width") / F.col("f"))).cast("bigint")
    ).withColumn("h", F.greatest(F.lit(1), F.floor(F.col("height") / F.col("f"))).cast("bigint"))
    # One raster may hold most blocks: the join with its one row of numbers is salted.
    sized = salted_join(blocks.select("raster", "block_row", "block_col", "mask"), meta.select("raster", "f", "w", "h"), ["raster"], ["block_row", "block_col"])
    cell = lambda v, i: F.struct(
        (F.col("block_row") * side + F.floor(i / side)).cast("int").alias("r"), (F.col("block_col") * side + i % side).cast("int").alias("c"), v.alias("mask")
    )
    probed = F.filter(F.transform("mask", cell), lambda p: (p["r"] % F.col("f") == 0) & (p["c"] % F.col("f") == 0))
    sampled = sized.select("raster", "f", "w", "h", F.explode(probed).alias("p")).select(
        "raster", F.floor(F.col("p.r") / F.col("f")).cast("int").alias("r"), F.floor(F.col("p.c") / F.col("f")).cast("int").alias("c"), "p.mask", "w", "h"
    ).filter("r < h AND c < w")
    fraction = sampled.groupBy("raster", "w", "h").agg(F.count_if("mask").alias("_on")).select(
        "raster", (F.col("_on") / (F.col("w") * F.col("h"))).alias("valid_fraction")
    )
    probe_blocks = comp.pixels_to_blocks(sampled, "mask", side, F.col("w"))
    labelled = comp.connected_components(probe_blocks, side)
    solid = comp.drop_small(labelled, F.lit(min_blob))
    polygons = comp.polygonize(solid, side)
    merged = comp.dissolve(polygons.withColumn("name", F.lit("footprint")), ["raster"], "label", ["name"])
    # Each Python step is written once: one row per raster, and no later filter runs it again.
    shaped = materialize(merged.join(meta, "raster").withColumn("geom", simplify_bounded(F.col("geom"))))
    t = [F.element_at("transform", i) for i in range(1, 7)]
    kx, ky = F.col("width") / F.col("w"), F.col("height") / F.col("h")
    probe_tf = F.array(t[0] * kx, t[1] * ky, t[2], t[3] * kx, t[4] * ky, t[5])
    placed = shaped.withColumn("_t", probe_tf).withColumn(
        "geom", geo.map_points(F.col("geom"), lambda p: geo.pixel_to_world(p["y"], p["x"], F.col("_t")))
    )
    sound = materialize(placed.select("raster", make_valid(F.col("geom"))["geom"].alias("geom")))
    # Rounding can pull points together, so the geometry is repaired once more.
    lonlat = materialize(sound.filter("geom IS NOT NULL").withColumn("geom", geo.to_lonlat(F.col("geom"), epsg, 7)))
    rounded = materialize(lonlat.withColumn("geom", make_valid(F.col("geom"))["geom"]))
    usable = rounded.filter("geom IS NOT NULL").select("raster", "geom", geo.bounds(F.col("geom")).alias("bbox"))
    known = (
        rasters.select("raster").join(fraction, "raster", "left").join(shaped.select("raster", F.lit(True).alias("_shaped")), "raster", "left")
        .join(usable, "raster", "left").withColumn("valid_fraction", F.coalesce("valid_fraction", F.lit(0.0)))
    )
    reason = (
        F.when(F.col("geom").isNotNull(), F.lit(None).cast("string"))
        .when(F.col("valid_fraction") == 0, F.lit("no valid pixel"))
        .when(F.col("_shaped").isNull(), F.lit("no part is large enough"))
        .otherwise(F.lit("the geometry cannot be repaired"))
    )
    return known.select("raster", "geom", "bbox", F.round("valid_fraction", 5).alias("valid_fraction"), reason.alias("reason"))
