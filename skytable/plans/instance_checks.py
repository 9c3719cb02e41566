"""Queries: components, instances, polygons, footprints."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from skytable.functions import geometry as geo
from skytable.operators import components as comp
from skytable.operators import footprints as foot
from skytable.operators import splitting
from skytable.operators.skew import spread
from skytable.plans.registry import query
from skytable.session import materialize

SIDE, WIDE = 8, 25


def big_raster(q, raster=None):
    """All blocks laid out as one raster 25 blocks wide, or one raster per class."""
    k = F.col("block_id")
    return q.blocks.select(
        (F.lit(0) if raster is None else F.col(raster)).cast("bigint").alias("raster"),
        F.floor(k / WIDE).cast("int").alias("block_row"), (k % WIDE).cast("int").alias("block_col"),
        F.lit(WIDE * SIDE).cast("bigint").alias("width"), F.transform("x", lambda v: v > 0).alias("mask"),
    )


def labelled(q, raster=None):
    return comp.connected_components(big_raster(q, raster), SIDE)


@query("ras18_connected_components")
def ras18(q):
    return comp.block_pixels(labelled(q), "labels", SIDE).select("raster", "r", "c", F.col("labels").alias("label"))


@query("agg8_drop_small")
def agg8(q):
    kept = comp.drop_small(labelled(q), comp.min_pixels(F.lit(0.05)))
    return comp.label_sizes(kept).select("raster", "label", "n")


@query(
    "agg8_min_pixels",
    "SELECT c_custkey AS id, CAST(CASE WHEN c_custkey % 50 > 0 THEN floor(1 / (c_custkey % 50 * 0.01::DOUBLE)) ELSE 0 END AS BIGINT) AS n FROM customer",
)
def agg8_min(q):
    k = F.col("c_custkey")
    return q.table("customer").select(k.alias("id"), comp.min_pixels(k % 50 * 0.01).cast("bigint").alias("n"))


@query("win8_relabel")
def win8(q):
    ranked = comp.relabel(comp.drop_small(labelled(q), F.lit(4)))
    return comp.label_sizes(ranked).select("raster", "label", "n")


def value_labels(q):
    """Blocks labelled by value ranges, one raster per class: many parts share one label."""
    k = F.col("block_id")
    return q.blocks.select(
        F.col("cls").cast("bigint").alias("raster"), F.floor(k / WIDE).cast("int").alias("block_row"), (k % WIDE).cast("int").alias("block_col"),
        F.lit(WIDE * SIDE).cast("bigint").alias("width"),
        F.transform("dn", lambda v: F.when(v >= 1500, F.floor(v / 20)).otherwise(0).cast("bigint")).alias("labels"),
    )


VALUES_SQL = "SELECT cls::BIGINT AS raster, CAST(dn // 20 AS BIGINT) AS label, count(*) AS n FROM fx_pixels WHERE dn >= 1500 GROUP BY 1, 2"


@query("agg8_drop_small_labels", f"SELECT raster, label, n FROM ({VALUES_SQL}) v WHERE n >= 20")
def agg8_labels(q):
    return comp.label_sizes(comp.drop_small(value_labels(q), F.lit(20)))


@query("win8_relabel_labels", f"SELECT raster, dense_rank() OVER (PARTITION BY raster ORDER BY label) AS label, n FROM ({VALUES_SQL}) v WHERE n >= 20")
def win8_labels(q):
    return comp.label_sizes(comp.relabel(comp.drop_small(value_labels(q), F.lit(20))))


@query("geo13_polygonize")
def geo13(q):
    shapes = comp.polygonize(comp.drop_small(labelled(q), F.lit(4)), SIDE)
    return shapes.select("raster", "label", geo.vertex_count(F.col("geom")).alias("vertices"), geo.planar_area(F.col("geom")).alias("area"))


@query(
    "agg9_dissolve",
    """SELECT o_orderkey // 10 AS instance_id, min(o_orderkey) AS feature_id, count(*) AS parts FROM orders GROUP BY 1""",
)
def agg9(q):
    parts = q.features.withColumn("geom", geo.box_geometry(*[F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")]))
    keyed = parts.withColumn("instance_id", F.floor(F.col("feature_id") / 10))
    merged = comp.dissolve(keyed, ["instance_id"], "ord", ["feature_id"])
    return merged.select("instance_id", "feature_id", F.size("geom").cast("bigint").alias("parts"))


@query(
    "agg9_dissolve_rows",
    """SELECT query_id, min(feature_id) OVER (PARTITION BY query_id) AS feature_id, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS part, ord FROM fx_features""",
)
def agg9_rows(q):
    parts = q.features.withColumn("geom", geo.box_geometry(*[F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")]))
    rows = comp.dissolve_rows(parts.withColumn("first", F.col("feature_id")), ["query_id"], "ord", ["first"])
    origin = parts.select("query_id", "ord")
    return rows.join(comp.numbered(origin, ["query_id"], ["ord"], "part"), ["query_id", "part"]).select(
        "query_id", F.col("first").alias("feature_id"), "part", "ord"
    )


TRANSFORM = (0.5, 0.0, 400000.0, 0.0, -0.5, 5750000.0)


@query("ras20_instances_to_features")
def ras20(q):
    small = comp.drop_small(labelled(q, "cls"), comp.min_pixels(F.lit(0.25)))
    out = comp.instances_to_features(comp.relabel(small), SIDE, F.array(*[F.lit(v) for v in TRANSFORM]), 32632, "tree")
    return out.select("raster", "instance_id", "class", "area_m2", geo.geometry_json(F.col("geom")).alias("geometry"))


@query("ras19_split_touching")
def ras19(q):
    blocks = labelled(q)
    pixels = comp.block_pixels(blocks, "labels", SIDE).select(
        "raster", "r", "c", (F.col("r").cast("bigint") * WIDE * SIDE + F.col("c") + 1).alias("id"), (F.col("labels") > 0).alias("on"), F.col("labels").alias("label")
    )
    return splitting.split_touching(pixels)


@query("geo12_simplify_bounded")
def geo12(q):
    shapes = comp.polygonize(comp.drop_small(labelled(q), F.lit(24)), SIDE)
    thin = shapes.withColumn("thin", foot.simplify_bounded(F.col("geom"), 1.5, 60))
    return thin.select("raster", "label", geo.vertex_count(F.col("geom")).alias("before"), geo.vertex_count(F.col("thin")).alias("after"))


@query(
    "geo14_repair",
    """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 END AS polygons, CASE o_orderkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 WHEN 2 THEN 1.0 END::DOUBLE AS area FROM orders""",
)
def geo14(q):
    """Four kinds of rings: valid with a doubled point, touching itself, with a spike, crossing itself."""
    rings = {
        0: [(0, 0), (1, 0), (1, 0), (1, 1), (0, 1), (0, 0)],
        1: [(0, 0), (1, 0), (1, 1), (2, 1), (2, 2), (1, 2), (1, 1), (0, 1), (0, 0)],
        2: [(0, 0), (1, 0), (3, 0), (1, 0), (1, 1), (0, 1), (0, 0)],
        3: [(0, 0), (2, 2), (2, 0), (0, 1), (0, 0)],
    }
    k = F.col("o_orderkey")
    shift = (k % 1000).cast("double")
    geom = lambda i: F.array(F.array(F.array(*[geo.point(shift + float(x), F.lit(float(y))) for x, y in rings[i]])))
    df = spread(q.table("orders"), "o_orderkey").select(k.alias("id"), F.when(k % 4 == 0, geom(0)).when(k % 4 == 1, geom(1)).when(k % 4 == 2, geom(2)).otherwise(geom(3)).alias("g"))
    fixed = df.select("id", foot.repair(F.col("g")).alias("g"))
    return fixed.select("id", F.when(F.col("g").isNotNull(), F.size("g")).alias("polygons"), F.round(geo.planar_area(F.col("g")), 6).alias("area"))


@query("geo15_footprints")
def geo15(q):
    """Footprints of the class rasters; every second block of a class is valid throughout."""
    k = F.col("block_id")
    solid = F.transform("x", lambda v: (k % 2 == 0) | (v > 0))
    blocks = q.blocks.select(
        F.col("cls").cast("bigint").alias("raster"), F.floor(k / WIDE).cast("int").alias("block_row"), (k % WIDE).cast("int").alias("block_col"), solid.alias("mask")
    )
    rows = q.blocks.groupBy(F.col("cls").cast("bigint").alias("raster")).agg(((F.max(F.floor(k / WIDE)) + 1) * SIDE).alias("height"))
    rasters = rows.withColumn("width", F.lit(WIDE * SIDE).cast("bigint")).withColumn(
        "transform", F.array(*[F.lit(v) for v in (10.0, 0.0, 400000.0, 0.0, -10.0, 5750000.0)])
    )
    out = foot.footprints(blocks, rasters, SIDE, 32632, probe=100)
    return out.select("raster", "valid_fraction", F.size("geom").alias("polygons"), "bbox.min_x", "bbox.max_y", "reason")


QUAD = """SELECT o_orderkey AS id, o_orderkey % 2 AS bow, 1 + o_orderkey % 17 AS ax, 1 + o_custkey % 23 AS ay, -1 - o_custkey % 13 AS bx, 1 + o_orderkey % 19 AS b_y,
 -1 - o_orderkey % 29 AS cx, -1 - o_custkey % 11 AS cy, 1 + o_custkey % 31 AS dx, -1 - o_orderkey % 7 AS dy FROM orders"""


@query(
    "geo14_make_valid",
    f"""WITH p AS ({QUAD}),
s AS (SELECT *, (cx - ax) * (b_y - ay) - (cy - ay) * (bx - ax) AS sb, (cx - ax) * (dy - ay) - (cy - ay) * (dx - ax) AS sd,
 (dx - bx) * (ay - b_y) - (dy - b_y) * (ax - bx) AS sa, (dx - bx) * (cy - b_y) - (dy - b_y) * (cx - bx) AS sc FROM p),
x AS (SELECT *, bow = 1 AND sb * sd < 0 AND sa * sc < 0 AS crossing, sa::DOUBLE / (sa - sc) AS t FROM s),
y AS (SELECT *, ax + t * (cx - ax) AS mx, ay + t * (cy - ay) AS my FROM x)
SELECT id, CASE WHEN crossing THEN 2 ELSE 1 END AS polygons,
 round(CASE WHEN bow = 0 THEN abs(ax * b_y - bx * ay + bx * cy - cx * b_y + cx * dy - dx * cy + dx * ay - ax * dy) / 2.0
  WHEN crossing THEN (abs((cx - mx) * (b_y - my) - (cy - my) * (bx - mx)) + abs((ax - mx) * (dy - my) - (ay - my) * (dx - mx))) / 2.0
  ELSE abs(ax * cy - cx * ay + cx * b_y - bx * cy + bx * dy - dx * b_y + dx * ay - ax * dy) / 2.0 END, 7)::DOUBLE AS area FROM y""",
)
def geo14_valid(q):
    """Rings through one place of each quadrant: going round, or crossing over like a bow tie, which gives two polygons."""
    p = q.spark.sql(QUAD.replace("FROM orders", "FROM {orders}"), orders=spread(q.table("orders"), "o_orderkey"))
    a, b, c, d = [geo.point(F.col(x), F.col(y)) for x, y in (("ax", "ay"), ("bx", "b_y"), ("cx", "cy"), ("dx", "dy"))]
    ring = F.when(F.col("bow") == 0, F.array(a, b, c, d, a)).otherwise(F.array(a, c, b, d, a))
    fixed = p.select("id", foot.make_valid(F.array(F.array(ring)))["geom"].alias("g"))
    return fixed.select("id", F.size("g").alias("polygons"), F.round(geo.planar_area(F.col("g")), 7).alias("area"))


@query(
    "geo12_simplify_topology",
    """SELECT o_orderkey AS id, true AS valid, true AS fits, true AS near, 2 AS rings FROM orders""",
)
def geo12_topology(q):
    """Jagged rings with a jagged hole close to them: thinned, they cross nowhere, fit the bound and stay near the old ones."""
    k = F.col("o_orderkey")

    def ring(corners, reach, spread):
        def corner(i):
            angle, r = i * (2 * math.pi) / corners, reach + (k * (i + 3) * 7919 + F.col("o_custkey")) % spread / 4
            return geo.point(r * F.cos(angle), r * F.sin(angle))

        points = F.transform(F.sequence(F.lit(0), (corners - 1).cast("int")), lambda i: corner(i.cast("double")))
        return F.concat(points, F.slice(points, 1, 1))

    outer, hole = ring(20 + k % 30, F.lit(20.0), 11), ring(12 + k % 20, F.lit(12.0), 23)
    shapes = q.table("orders").repartition(64, "o_orderkey").select(k.alias("id"), F.array(F.array(outer, hole)).alias("geom"))
    thin = materialize(shapes.withColumn("thin", foot.simplify_bounded(F.col("geom"), 2.0, 50)))
    length = F.aggregate(F.flatten("geom"), F.lit(0.0), lambda n, r: n + F.aggregate(geo.edges(r), F.lit(0.0), lambda m, e: m + F.hypot(e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"])))
    # No given vertex is farther from the new ring than the tolerance, doubled twice at most here.
    near = F.abs(geo.planar_area(F.col("geom")) - geo.planar_area(F.col("thin"))) <= 2.0 * 4 * length
    checked = thin.select("id", foot.make_valid(F.col("thin"))["reason"].isNull().alias("valid"), (geo.vertex_count(F.col("thin")) <= 50).alias("fits"), near.alias("near"), F.size(F.flatten("thin")).alias("rings"))
    return checked
