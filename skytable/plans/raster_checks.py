"""Queries: pixels, blocks, tiles and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytable.functions import geometry as geo
from skytable.functions import pixels as px
from skytable.operators import burn
from skytable.operators import raster as ras
from skytable.plans.registry import query
from skytable.sources.files import blocks_to_pixels

SIDE = 8


def block_map(q, fn, source="dn"):
    """Apply a pixel function inside the blocks, then unfold to pixels: no shuffle."""
    blocks = q.blocks.select("block_id", F.transform(source, fn).alias("v"))
    return blocks_to_pixels(blocks, "v", SIDE, ["block_id"])


def pair_sql(a="x", b="x"):
    return f"SELECT p.block_id // 2 AS k, p.r, p.c, p.cls, p.{a} AS a, q.{b} AS b FROM fx_pixels p JOIN fx_pixels q ON q.block_id = p.block_id + 1 AND p.block_id % 2 = 0 AND p.r = q.r AND p.c = q.c"


def pairs(q, source):
    """Even blocks with the odd block after them, pixel by pixel: join on blocks, zip inside."""
    b = q.blocks.select("block_id", "cls", F.col(source).alias("v"), F.floor(F.col("block_id") / 2).alias("k"))
    even = b.filter("block_id % 2 = 0").select("k", "cls", F.col("v").alias("a"))
    odd = b.filter("block_id % 2 = 1").select("k", F.col("v").alias("b"))
    zipped = even.join(odd, "k").select("k", "cls", F.arrays_zip("a", "b").alias("v"))
    return blocks_to_pixels(zipped, "v", SIDE, ["k", "cls"]).select("k", "cls", "r", "c", "v.a", "v.b")


@query("src13_read_blocks", "SELECT block_id, r, c, dn AS v FROM fx_pixels")
def src13(q):
    return blocks_to_pixels(q.blocks, "dn", SIDE, ["block_id"])


@query("ras1_to_uint8", "SELECT block_id, r, c, dn >> 8 AS v FROM fx_pixels")
def ras1(q):
    return block_map(q, px.to_uint8)


@query("ras2_rescale", "SELECT block_id, r, c, CAST(floor(greatest(0, least(1, dn::DOUBLE / 3000)) * 255) AS INT) AS v FROM fx_pixels")
def ras2(q):
    return block_map(q, lambda v: px.rescale(v))


@query(
    "ras3_stretch_gamma",
    "SELECT block_id, r, c, CAST(floor(pow(least(1, (dn - 900)::DOUBLE / 1700), 0.75) * 255 + 0.5) AS INT) AS red, CAST(floor(pow(least(1, (dn - 900)::DOUBLE / 1300), 0.75) * 255 + 0.5) AS INT) AS green, CAST(floor(pow(least(1, (dn - 900)::DOUBLE / 900), 0.75) * 255 + 0.5) AS INT) AS blue FROM fx_pixels",
)
def ras3(q):
    bands = lambda v: F.struct(*[px.stretch_gamma(v - 900, limit).alias(n) for n, limit in zip(("red", "green", "blue"), px.GAMMA_LIMITS)])
    return block_map(q, bands).select("block_id", "r", "c", "v.red", "v.green", "v.blue")


@query(
    "ras4_ndvi_mask",
    f"SELECT k, r, c, round(CASE WHEN a + b > 0 THEN (b - a)::DOUBLE / (a + b) ELSE 0 END, 6) AS ndvi, CASE WHEN a + b > 0 THEN (b - a)::DOUBLE / (a + b) ELSE 0 END >= 0.2 AS on FROM ({pair_sql('dn', 'dn')}) t".replace(" AS on ", ' AS "on" '),
)
def ras4(q):
    p = pairs(q, "dn")
    return p.select("k", "r", "c", F.round(px.ndvi(F.col("a"), F.col("b")), 6).alias("ndvi"), px.ndvi_mask(F.col("a"), F.col("b")).alias("on"))


SIZES_SQL = "SELECT c_custkey AS raster, CAST(c_custkey % 37 * 90 + 1 AS INT) AS height, CAST(c_custkey % 23 * 150 + 1 AS INT) AS width FROM customer"


def sizes(q):
    k = F.col("c_custkey")
    return q.table("customer").select(
        k.alias("raster"), (k % 37 * 90 + 1).cast("int").alias("height"), (k % 23 * 150 + 1).cast("int").alias("width")
    )


@query(
    "ras5_tile_grid",
    f"SELECT raster, y, x, least(1024, height - y) AS tile_h, least(1024, width - x) AS tile_w FROM (SELECT *, unnest(generate_series(0, width - 1, 896))::INT AS x FROM (SELECT *, unnest(generate_series(0, height - 1, 896))::INT AS y FROM ({SIZES_SQL}) s) t) u",
)
def ras5(q):
    return ras.tile_grid(sizes(q), 1024, 128).select("raster", "y", "x", "tile_h", "tile_w")


@query(
    "ras6_tile_grid_flush",
    f"""WITH s AS ({SIZES_SQL}), o AS (SELECT raster, height, width, CASE WHEN height <= 1024 THEN [0] ELSE list_distinct(list_transform(generate_series(0, height - 1, 819), lambda p: least(p, height - 1024))) END AS ys,
 CASE WHEN width <= 1024 THEN [0] ELSE list_distinct(list_transform(generate_series(0, width - 1, 819), lambda p: least(p, width - 1024))) END AS xs FROM s)
SELECT raster, y, unnest(xs)::INT AS x FROM (SELECT raster, xs, unnest(ys)::INT AS y FROM o) t""",
)
def ras6(q):
    return ras.tile_grid(sizes(q), 1024, 205, flush=True).select("raster", "y", "x")


@query(
    "ras7_pad_reflect",
    "WITH i AS (SELECT unnest(generate_series(0, 11))::INT AS i), m AS (SELECT i, CASE WHEN i < 8 THEN i ELSE 14 - i END AS s FROM i) SELECT block_id AS raster, a.i AS r, b.i AS c, dn AS v FROM fx_pixels p JOIN m a ON p.r = a.s JOIN m b ON p.c = b.s",
)
def ras7(q):
    p = blocks_to_pixels(q.blocks, "dn", SIDE, ["block_id"]).withColumnRenamed("block_id", "raster")
    size = q.blocks.select(F.col("block_id").alias("raster"), F.lit(8).alias("height"), F.lit(8).alias("width"))
    return ras.pad_reflect(p, size, 6).select("raster", "r", "c", "v")


@query("ras8_nonblank", "SELECT block_id FROM fx_pixels GROUP BY block_id HAVING bool_or(dn > 2400)")
def ras8(q):
    cut = q.blocks.select("block_id", F.transform("dn", lambda v: F.when(v > 2400, v).otherwise(0)).alias("v"))
    return ras.nonblank(cut, "v").select("block_id")


@query(
    "ras9_select_bands",
    "SELECT block_id, c, b2 AS x1, b0 AS x2, b1 AS x3, b7 AS x4, b6 AS x5, b5 AS x6, b4 AS x7, b3 AS x8, b0 AS y1, b1 AS y2, b0 AS y3 FROM (SELECT block_id, c, max(CASE WHEN r = 0 THEN dn END) AS b0, max(CASE WHEN r = 1 THEN dn END) AS b1, max(CASE WHEN r = 2 THEN dn END) AS b2, max(CASE WHEN r = 3 THEN dn END) AS b3, max(CASE WHEN r = 4 THEN dn END) AS b4, max(CASE WHEN r = 5 THEN dn END) AS b5, max(CASE WHEN r = 6 THEN dn END) AS b6, max(CASE WHEN r = 7 THEN dn END) AS b7 FROM fx_pixels GROUP BY block_id, c) t",
)
def ras9(q):
    """Block rows taken as bands."""
    bands = q.blocks.select("block_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.get(F.col("dn"), r * 8 + c)))).alias("c", "bands"))
    picked = bands.select("block_id", "c", px.select_bands(F.col("bands"), [3, 1, 2, 8, 7, 6, 5, 4]).alias("x"), px.display_bands(F.slice("bands", 1, 2)).alias("y"))
    return picked.select("block_id", "c", *[F.col(n)[i].alias(f"{n}{i + 1}") for n, size in (("x", 8), ("y", 3)) for i in range(size)])


@query(
    "ras10_decimate",
    "SELECT block_id, r // 3 AS r, c // 3 AS c, dn AS v FROM fx_pixels WHERE r % 3 = 0 AND c % 3 = 0",
)
def ras10(q):
    return ras.decimate(blocks_to_pixels(q.blocks, "dn", SIDE, ["block_id"]), 3)


@query(
    "ras10_decimation_factor",
    f"SELECT raster, CAST(greatest(1, round_even(greatest(width, height)::DOUBLE / 1024, 0)) AS INT) AS factor FROM ({SIZES_SQL}) s",
)
def ras10_factor(q):
    return sizes(q).select("raster", px.decimation(F.col("width"), F.col("height")).alias("factor"))


@query("ras11_standardize", "SELECT block_id, r, c, round((dn / 10000.0::DOUBLE - 0.1412) / 0.0737, 6) AS v FROM fx_pixels")
def ras11(q):
    return block_map(q, lambda v: F.round(px.standardize(v, 0.1412, 0.0737), 6))


@query(
    "ras12_score_to_mask",
    "SELECT block_id, r, c, 1 / (1 + exp(-x * 8)) > 0.6 AS direct, floor(1 / (1 + exp(-x * 8)) * 255) / 255 > 0.6 AS quantized FROM fx_pixels",
)
def ras12(q):
    both = lambda v: F.struct(px.score_to_mask(v * 8, 0.6).alias("direct"), px.score_to_mask(v * 8, 0.6, True).alias("quantized"))
    return block_map(q, both, "x").select("block_id", "r", "c", "v.direct", "v.quantized")


@query(
    "ras12_argmax",
    "SELECT block_id, c, b1 > b0 AND b1 >= greatest(b2, b3, b4, b5, b6, b7) AS on FROM (SELECT block_id, c, max(CASE WHEN r = 0 THEN x END) AS b0, max(CASE WHEN r = 1 THEN x END) AS b1, max(CASE WHEN r = 2 THEN x END) AS b2, max(CASE WHEN r = 3 THEN x END) AS b3, max(CASE WHEN r = 4 THEN x END) AS b4, max(CASE WHEN r = 5 THEN x END) AS b5, max(CASE WHEN r = 6 THEN x END) AS b6, max(CASE WHEN r = 7 THEN x END) AS b7 FROM fx_pixels GROUP BY block_id, c) t".replace(" AS on ", ' AS "on" '),
)
def ras12_argmax(q):
    scores = q.blocks.select("block_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.array(*[F.get(F.col("x"), c + 8 * r) for r in range(8)]))).alias("c", "s"))
    return scores.select("block_id", "c", px.argmax_is(F.col("s"), 1).alias("on"))


@query(
    "ras13_blend",
    """WITH t AS (SELECT block_id, r, c, dn >> 4 AS v, CASE cls WHEN 1 THEN [0, 200, 100] WHEN 2 THEN [255, 140, 26] ELSE [255, 0, 0] END AS k FROM fx_pixels WHERE dn > 2000)
SELECT block_id, r, c, CAST(floor(least(255, v * 0.55 + k[1] * 0.45::DOUBLE)) AS INT) AS red, CAST(floor(least(255, v * 0.55 + k[2] * 0.45::DOUBLE)) AS INT) AS green, CAST(floor(least(255, v * 0.55 + k[3] * 0.45::DOUBLE)) AS INT) AS blue FROM t""".replace("0.55 ", "(1 - 0.45::DOUBLE) "),
)
def ras13(q):
    p = blocks_to_pixels(q.blocks, "dn", SIDE, ["block_id", "cls"]).filter("v > 2000")
    color = px.label_color(F.col("cls").cast("string"), {"1": "#00c864", "2": "#ff8c1a"})
    v = F.shiftright("v", 4)
    return p.select("block_id", "r", "c", *[px.blend(v, color, i, 0.45).alias(n) for i, n in enumerate(("red", "green", "blue"))])


@query(
    "ras14_resize_nearest",
    "WITH i AS (SELECT unnest(generate_series(0, 12))::INT AS i), m AS (SELECT i, floor((i + 0.5) * 8 / 13) AS s FROM i) SELECT block_id, a.i AS r, b.i AS c, dn AS v FROM fx_pixels p JOIN m a ON p.r = a.s JOIN m b ON p.c = b.s",
)
def ras14(q):
    p = blocks_to_pixels(q.blocks, "dn", SIDE, ["block_id"])
    return ras.resize_nearest(p, ["block_id"], (8, 8), (13, 13))


@query(
    "ras14_resize_bilinear",
    """WITH i AS (SELECT unnest(generate_series(0, 12))::INT AS i), w AS (SELECT i, greatest(0, (i + 0.5::DOUBLE) * 8 / 13 - 0.5) AS p0 FROM i),
m AS (SELECT i, CAST(floor(p0) AS INT) AS s, 1 - (p0 - floor(p0)) AS w FROM w UNION ALL SELECT i, least(CAST(floor(p0) AS INT) + 1, 7) AS s, p0 - floor(p0) AS w FROM w)
SELECT block_id, a.i AS r, b.i AS c, round(sum(x * a.w * b.w), 9) AS x FROM fx_pixels p JOIN m a ON p.r = a.s JOIN m b ON p.c = b.s GROUP BY block_id, a.i, b.i""",
)
def ras14_bilinear(q):
    p = blocks_to_pixels(q.blocks, "x", SIDE, ["block_id"]).withColumnRenamed("v", "x")
    return ras.resize_bilinear(p, ["block_id"], "x", (8, 8), (13, 13)).withColumn("x", F.round("x", 9))


@query(
    "ras15_target_size",
    f"SELECT raster, CAST(greatest(1, round_even(width * 0.6::DOUBLE / 5, 0)) AS INT) AS new_w, CAST(greatest(1, round_even(height * 0.6::DOUBLE / 5, 0)) AS INT) AS new_h FROM ({SIZES_SQL}) s",
)
def ras15(q):
    return sizes(q).select("raster", px.resized(F.col("width"), F.lit(0.6), 5.0).alias("new_w"), px.resized(F.col("height"), F.lit(0.6), 5.0).alias("new_h"))


PALETTE_SQL = "[" + ", ".join(f"'{c}'" for c in px.PALETTE) + "]"


@query("ras16_palette", f"SELECT c_custkey AS id, ({PALETTE_SQL})[c_custkey % 20 + 1] AS color FROM customer")
def ras16(q):
    return q.table("customer").select(F.col("c_custkey").alias("id"), px.palette(F.col("c_custkey")).alias("color"))


@query(
    "ras21_class_mask",
    "SELECT block_id, count(*) AS pixels, count(*) FILTER (WHERE dn % 2 = 1) AS water FROM fx_pixels WHERE r < 6 AND c < 7 GROUP BY block_id",
)
def ras21(q):
    p = blocks_to_pixels(q.blocks, "dn", SIDE, ["block_id"]).filter("r < 6 AND c < 7")
    return p.groupBy("block_id").agg(F.count(F.lit(1)).alias("pixels"), F.count_if(F.col("v") % 2 == 1).alias("water"))


@query(
    "ras22_valid_mask",
    "SELECT block_id, r // 4 AS r, c // 4 AS c, round(avg(CASE WHEN dn >= 1800 THEN dn END), 6) AS v FROM fx_pixels GROUP BY block_id, r // 4, c // 4",
)
def ras22(q):
    """Zero is no data and never enters an average."""
    zeroed = block_map(q, lambda v: px.valid(F.when(v >= 1800, v).otherwise(0)))
    return ras.downsample_avg(zeroed, ["block_id"], "v", 4).withColumn("v", F.round("v", 6))


@query(
    "joi10_mask_outside",
    """SELECT block_id, r, c, CASE WHEN c + 0.5 > 1.3 AND c + 0.5 < 6.2 AND r + 0.5 > 0.7 + block_id % 3 AND r + 0.5 < 7.1 THEN dn ELSE 0 END AS v FROM fx_pixels""",
)
def joi10(q):
    p = blocks_to_pixels(q.blocks, "dn", SIDE, ["block_id"]).select(
        F.col("block_id").alias("raster"), "r", "c", "v", (F.col("c") + 0.5).alias("x"), (F.col("r") + 0.5).alias("y")
    )
    low = F.lit(0.7) + F.col("block_id") % 3
    aoi = q.blocks.select(F.col("block_id").alias("raster"), geo.box_ring(F.lit(1.3), low, F.lit(6.2), F.lit(7.1)).alias("ring"))
    return ras.mask_outside(p, aoi, ["v"]).select(F.col("raster").alias("block_id"), "r", "c", "v")


@query(
    "joi14_gate_mask",
    f'SELECT k, r, c, a > 0 AND b > 0.05 AS "on" FROM ({pair_sql()}) t',
)
def joi14(q):
    p = blocks_to_pixels(q.blocks, "x", SIDE, ["block_id"])
    k = F.floor(F.col("block_id") / 2).alias("k")
    mask = p.filter("block_id % 2 = 0").select(k, "r", "c", (F.col("v") > 0).alias("on"))
    veg = p.filter("block_id % 2 = 1").select(k, "r", "c", (F.col("v") > 0.05).alias("on"))
    return ras.gate_mask(mask, veg, ["k", "r", "c"])


@query("agg10_merge_tile_masks", 'SELECT cls AS raster, r, c, max(x > 0.2) AS "on" FROM fx_pixels GROUP BY cls, r, c')
def agg10(q):
    p = blocks_to_pixels(q.blocks, "x", SIDE, ["cls"]).select(F.col("cls").alias("raster"), "r", "c", (F.col("v") > 0.2).alias("on"))
    return ras.merge_tile_masks(p)


@query("agg11_any_mask", 'SELECT cls AS raster, r, c, bool_or(x > 0.3) AS "on" FROM fx_pixels GROUP BY cls, r, c')
def agg11(q):
    p = blocks_to_pixels(q.blocks, "x", SIDE, ["cls"]).select(F.col("cls").alias("raster"), "r", "c", (F.col("v") > 0.3).alias("on"))
    return ras.any_mask(p)


@query("agg12_valid_fraction", "SELECT block_id, avg(CAST(dn > 1800 AS INT)) AS valid_fraction FROM fx_pixels GROUP BY block_id")
def agg12(q):
    p = block_map(q, lambda v: v > 1800).withColumnRenamed("v", "valid")
    return ras.valid_fraction(p, ["block_id"])


@query(
    "agg13_stretch",
    """WITH p AS (SELECT cls, quantile_cont(dn, 0.02) AS lo, quantile_cont(dn, 0.98) AS hi FROM fx_pixels GROUP BY cls)
SELECT block_id, r, c, CAST(floor(greatest(0, least(255, (dn - lo) / (hi - lo + 1e-8) * 255))) AS INT) AS stretched FROM fx_pixels JOIN p USING (cls)""",
)
def agg13(q):
    p = blocks_to_pixels(q.blocks, "dn", SIDE, ["block_id", "cls"])
    return ras.stretch_percentiles(p, ["cls"], "v").select("block_id", "r", "c", "stretched")


@query("agg17_coverage", "SELECT cls, count(*) FILTER (WHERE x > 0) AS pixels, round(avg(CAST(x > 0 AS INT)) * 100, 6) AS percent FROM fx_pixels GROUP BY cls")
def agg17(q):
    p = blocks_to_pixels(q.blocks, "x", SIDE, ["cls"]).withColumn("on", F.col("v") > 0)
    return ras.coverage(p, ["cls"]).withColumn("percent", F.round("percent", 6))


@query("agg18_downsample_avg", "SELECT block_id, r // 2 AS r, c // 2 AS c, avg(dn) AS v FROM fx_pixels GROUP BY block_id, r // 2, c // 2")
def agg18(q):
    return ras.downsample_avg(blocks_to_pixels(q.blocks, "dn", SIDE, ["block_id"]), ["block_id"], "v", 2)


@query(
    "agg18_resample_average",
    """WITH m AS (SELECT i, j, least((i + 1) * 3::DOUBLE / 8, j + 1) - greatest(i * 3::DOUBLE / 8, j) AS w FROM (SELECT unnest(generate_series(0, 7)) AS i), (SELECT unnest(generate_series(0, 2)) AS j))
SELECT block_id, a.j AS r, b.j AS c, round(sum(dn * a.w * b.w) / sum(a.w * b.w), 6) AS v FROM fx_pixels p JOIN m a ON p.r = a.i AND a.w > 0 JOIN m b ON p.c = b.i AND b.w > 0 GROUP BY block_id, a.j, b.j""",
)
def agg18_weighted(q):
    p = blocks_to_pixels(q.blocks, "dn", SIDE, ["block_id"])
    return ras.resample_average(p, ["block_id"], "v", (8, 8), (3, 3)).withColumn("v", F.round("v", 6))


@query(
    "agg18_scale",
    f"SELECT raster, round(CASE WHEN raster % 3 = 0 THEN 1 ELSE least(1, 0.01 * (raster % 60 + 1) / 0.3) END, 9) AS scale FROM ({SIZES_SQL}) s",
)
def agg18_scale(q):
    k = F.col("raster")
    scale = px.downsample_scale(0.01 * (k % 60 + 1), 0.3, k % 3 != 0)
    return sizes(q).select("raster", F.round(scale, 9).alias("scale"))


@query(
    "win2_mosaic_first",
    "SELECT r, c, dn, block_id AS scene FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY cls, block_id) AS rn FROM fx_pixels WHERE dn > 1800) t WHERE rn = 1",
)
def win2(q):
    p = blocks_to_pixels(q.blocks, "dn", SIDE, ["block_id", "cls"]).withColumn("valid", F.col("v") > 1800)
    best = ras.mosaic_first(p, [F.col("cls"), F.col("block_id")], ["r", "c"], ["v", "block_id"])
    return best.select("r", "c", F.col("v").alias("dn"), F.col("block_id").alias("scene"))


GRID = {"left": 7.6, "top": 52.01, "cell": 0.002, "height": 55, "width": 51}


@query(
    "joi11_rasterize",
    """WITH f AS (SELECT *, (max_lon - 7.6) / 0.002 AS c1, (min_lon - 7.6) / 0.002 AS c0, (52.01 - max_lat) / 0.002 AS r0, (52.01 - min_lat) / 0.002 AS r1 FROM fx_features WHERE geom_type <> 'LineString'),
x AS (SELECT query_id, ord, feature_id % 7 + 1 AS v, unnest(generate_series(CAST(floor(c0) AS INT), CAST(ceil(c1) AS INT) - 1)) AS c, CAST(floor(r0) AS INT) AS ra, CAST(ceil(r1) AS INT) - 1 AS rb FROM f),
y AS (SELECT query_id, ord, v, c, unnest(generate_series(ra, rb)) AS r FROM x), z AS (SELECT query_id, r, c, arg_max(v, ord) AS v FROM y GROUP BY query_id, r, c),
g AS (SELECT query_id, r, c FROM (SELECT DISTINCT query_id FROM f), (SELECT unnest(generate_series(0, 54)) AS r), (SELECT unnest(generate_series(0, 50)) AS c))
SELECT g.query_id, g.r::INT AS r, g.c::INT AS c, coalesce(z.v, 0) AS value FROM g LEFT JOIN z USING (query_id, r, c)""",
)
def joi11(q):
    f = q.features.filter("geom_type <> 'LineString'").select(
        "query_id", "ord", (F.col("feature_id") % 7 + 1).alias("value"),
        geo.box_geometry(*[F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")]).alias("geom"),
    )
    return ras.rasterize(f, GRID)


@query(
    "joi11_rasterize_blocks",
    """WITH s AS (SELECT query_id, ord, feature_id, min_lon, min_lat, max_lon, max_lat, CAST(0.002 AS DOUBLE) * (1 + query_id % 3) AS cell, CAST(50 // (1 + query_id % 3) + 1 AS INT) AS w, CAST(54 // (1 + query_id % 3) + 1 AS INT) AS h FROM fx_features WHERE geom_type <> 'LineString'),
f AS (SELECT *, (max_lon - 7.6) / cell AS c1, (min_lon - 7.6) / cell AS c0, (max_lat - 52.01) / -cell AS r0, (min_lat - 52.01) / -cell AS r1 FROM s),
x AS (SELECT query_id, ord, h, feature_id % 7 + 1 AS v, unnest(generate_series(CAST(floor(c0) AS INT), least(w, CAST(ceil(c1) AS INT)) - 1)) AS c, CAST(floor(r0) AS INT) AS ra, CAST(ceil(r1) AS INT) - 1 AS rb FROM f),
y AS (SELECT query_id, ord, v, c, unnest(generate_series(greatest(ra, 0), least(rb, h - 1))) AS r FROM x), z AS (SELECT query_id, r, c, arg_max(v, ord) AS v FROM y GROUP BY query_id, r, c),
d AS (SELECT DISTINCT query_id, w, h FROM s), e AS (SELECT query_id, w, unnest(range(0, h)) AS r FROM d), g AS (SELECT query_id, r, unnest(range(0, w)) AS c FROM e)
SELECT g.query_id, g.r::INT AS r, g.c::INT AS c, coalesce(z.v, 0) AS value FROM g LEFT JOIN z USING (query_id, r, c)""",
)
def joi11_blocks(q):
    """Features burned into blocks; every query has a grid of its own."""
    f = q.features.filter("geom_type <> 'LineString'").select(
        "query_id", "ord", (F.col("feature_id") % 7 + 1).alias("value"),
        geo.box_geometry(*[F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")]).alias("geom"),
    )
    step = 1 + F.col("query_id") % 3
    cell, zero = F.lit(0.002) * step, F.lit(0.0)
    grids = f.select("query_id").distinct().select(
        "query_id", F.lit(4326).alias("epsg"), F.array(cell, zero, F.lit(7.6), zero, -cell, F.lit(52.01)).alias("transform"),
        (F.floor(54 / step) + 1).cast("int").alias("height"), (F.floor(50 / step) + 1).cast("int").alias("width"),
    )
    return burn.block_cells(burn.rasterize_blocks(f, grids, 16), grids, 16)


@query(
    "ras21_class_mask_blocks",
    """WITH p AS (SELECT block_id // 4 AS raster, block_id % 4 // 2 * 8 + r AS r, block_id % 2 * 8 + c AS c, dn % 5 AS v FROM fx_pixels)
SELECT raster, count(*) AS pixels, count(*) FILTER (WHERE v = 1) AS "on", count(*) FILTER (WHERE v = 1)::DOUBLE / count(*) AS share FROM p WHERE r < 9 + raster % 8 AND c < 16 - raster % 7 GROUP BY raster""",
)
def ras21_blocks(q):
    """Cover of one class in rasters of four blocks, of which padding was added to the last rows and columns."""
    raster = F.floor(F.col("block_id") / 4)
    blocks = q.blocks.select(
        raster.alias("raster"), F.floor(F.col("block_id") % 4 / 2).alias("block_row"), (F.col("block_id") % 2).alias("block_col"),
        (9 + raster % 8).alias("height"), (16 - raster % 7).alias("width"), F.transform("dn", lambda v: v % 5).alias("classes"),
    )
    return ras.class_cover(ras.class_mask_blocks(blocks, F.col("classes"), 1, SIDE), ["raster"])
