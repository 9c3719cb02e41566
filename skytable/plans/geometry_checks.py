"""Queries: projections, areas, clipping and other geometry functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytable.functions import geometry as geo
from skytable.functions import projection as proj
from skytable.operators import estimates
from skytable.operators import features as feat
from skytable.operators.requests import split_valid
from skytable.plans.registry import query

BOX = ("min_lon", "min_lat", "max_lon", "max_lat")


def box_cols():
    return [F.col(c) for c in BOX]


# --- SQL texts for the checks; series constants are computed here from the ellipsoid.
_N = (1 / 298.257223563) / (2 - 1 / 298.257223563)
_E = 2 * _N**0.5 / (1 + _N)
_A = 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
          61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)


def utm_sql(lon: str, lat: str, zone: str) -> tuple[str, str]:
    """Northern UTM in DuckDB: texts of easting and northing."""
    t = f"sinh(atanh(sin(radians({lat}))) - {_E!r} * atanh({_E!r} * sin(radians({lat}))))"
    away = f"radians({lon} - ({zone} * 6.0::DOUBLE - 183.0::DOUBLE))"
    xi = f"atan2({t}, cos({away}))"
    eta = f"atanh(sin({away}) / sqrt(1 + {t} * {t}))"
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, start=1):
        east += f" + {a!r}::DOUBLE * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})"
        north += f" + {a!r}::DOUBLE * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})"
    return f"(500000.0::DOUBLE + {0.9996 * _A!r}::DOUBLE * ({east}))", f"({0.9996 * _A!r}::DOUBLE * ({north}))"


ZONE_SQL = "(floor((min_lon + 180) / 6) + 1)"


@query(
    "geo1_utm_epsg",
    f"SELECT query_id, CAST(CASE WHEN min_lat >= 0 THEN 32600 ELSE 32700 END + {ZONE_SQL} AS INT) AS epsg FROM (SELECT query_id, min_lon * 9 - 60 AS min_lon, min_lat - 52 AS min_lat FROM fx_requests) t",
)
def geo1(q):
    k = q.requests.select(
        "query_id", (F.col("min_lon") * 9 - 60).alias("min_lon"), (F.col("min_lat") - 52).alias("min_lat")
    )
    lon, lat = F.col("min_lon"), F.col("min_lat")
    return k.select("query_id", proj.utm_epsg(lon, lat, lon + 0.01, lat + 0.01).alias("epsg"))


_X, _Y = utm_sql("min_lon", "min_lat", ZONE_SQL)


@query(
    "geo2_to_utm",
    f"SELECT scene_id, round({_X}, 3) AS x, round({_Y}, 3) AS y, round(min_lon, 9) AS lon, round(min_lat, 9) AS lat FROM fx_scenes",
)
def geo2(q):
    """Forward to UTM and back to lon/lat."""
    zone, south = proj.utm_zone(F.col("min_lon")).cast("double"), F.lit(False)
    x, y = proj.to_utm(F.col("min_lon"), F.col("min_lat"), zone, south)
    df = q.scenes.select("scene_id", zone.alias("z"), x.alias("x"), y.alias("y"))
    lon, lat = proj.from_utm(F.col("x"), F.col("y"), F.col("z"), south)
    return df.select(
        "scene_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"),
        F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"),
    )


def _corners_sql():
    xs, ys = [], []
    for lon in ("min_lon", "max_lon"):
        for lat in ("min_lat", "max_lat"):
            x, y = utm_sql(lon, lat, ZONE_SQL)
            xs.append(x)
            ys.append(y)
    return f"greatest({', '.join(xs)}) - least({', '.join(xs)})", f"greatest({', '.join(ys)}) - least({', '.join(ys)})"


_W, _H = _corners_sql()
ESTIMATE_SQL = f"""SELECT query_id, source_type, w, h, CAST(greatest(1, ceil(w / res * 1.1::DOUBLE)) AS BIGINT) AS width_px, CAST(greatest(1, ceil(h / res * 1.1::DOUBLE)) AS BIGINT) AS height_px
FROM (SELECT query_id, source_type, CASE source_type WHEN 'ortho' THEN 0.1::DOUBLE WHEN 'satellite' THEN 3.0::DOUBLE ELSE 10.0::DOUBLE END AS res, {_W} AS w, {_H} AS h FROM fx_requests WHERE min_lat < max_lat AND min_lon < max_lon) t"""


def valid_requests(q):
    return split_valid(q.requests)[0]


@query(
    "geo3_estimate_raster",
    f"SELECT query_id, round(w, 3) AS width_m, round(h, 3) AS height_m, width_px, height_px, width_px * height_px AS total_px FROM ({ESTIMATE_SQL}) e",
)
def geo3(q):
    out = estimates.estimate_raster(estimates.attach_budget(valid_requests(q)))
    return out.select(
        "query_id", F.round("width_m", 3).alias("width_m"), F.round("height_m", 3).alias("height_m"),
        "width_px", "height_px", "total_px",
    )


@query(
    "geo4_check_budget",
    f"""WITH e AS ({ESTIMATE_SQL}), b AS (SELECT *, width_px * height_px AS total_px, CASE source_type WHEN 'ortho' THEN 210000000 ELSE 25000000 END AS cap, CASE source_type WHEN 'ortho' THEN 18000 ELSE 8000 END AS side FROM e)
SELECT query_id, round(total_px / 1000000, 2) AS megapixels, total_px <= cap AND width_px <= side AND height_px <= side AS allowed,
 CASE WHEN NOT (total_px <= cap AND width_px <= side AND height_px <= side) THEN concat(format('{{:,}}', width_px), ' × ', format('{{:,}}', height_px), ' pixels') END AS size_text FROM b""",
)
def geo4(q):
    out = estimates.estimate_requests(valid_requests(q))
    return out.select(
        "query_id", "megapixels", "allowed",
        F.nullif(F.regexp_extract("error", r"Estimated raster: (.*? pixels) ", 1), F.lit("")).alias("size_text"),
    )


_F = 1 / 298.257223563
_E2 = _F * (2 - _F)
_EC = _E2**0.5
_QP = (1 - _E2) * (1 / (1 - _E2) - __import__("math").log((1 - _EC) / (1 + _EC)) / (2 * _EC))
_RQ = 6378137.0 * (_QP / 2) ** 0.5


def _beta(lat):
    s = f"sin(radians({lat}))"
    return f"asin({1 - _E2!r}::DOUBLE * ({s} / (1 - {_E2!r}::DOUBLE * {s} * {s}) - ln((1 - {_EC!r}::DOUBLE * {s}) / (1 + {_EC!r}::DOUBLE * {s})) / {2 * _EC!r}::DOUBLE) / {_QP!r}::DOUBLE)"


def area_sql(source: str, key: str, box: tuple[str, str, str, str] = BOX) -> str:
    """Area of a box on the ellipsoid, as a cylindrical strip: exact for boxes along parallels."""
    a, b, c, d = box
    return f"SELECT {key}, {_RQ**2!r}::DOUBLE * radians({c} - {a}) * (sin({_beta(d)}) - sin({_beta(b)})) AS area FROM {source}"


@query(
    "geo5_geodesic_area",
    "SELECT feature_id, CAST(round(area, 1) AS DOUBLE) AS area FROM (" + area_sql("fx_features", "feature_id") + ") t",
)
def geo5(q):
    return q.features.select(
        "feature_id", F.round(geo.geodesic_area(geo.box_geometry(*box_cols())), 1).alias("area")
    )


@query(
    "geo6_spherical_area",
    "SELECT query_id, round(abs(radians(max_lon - min_lon) * (2 + sin(radians(min_lat)) + sin(radians(min_lat))) + radians(min_lon - max_lon) * (2 + sin(radians(max_lat)) + sin(radians(max_lat)))) * 6371008.8 * 6371008.8 / 2, 0) AS area FROM fx_requests",
)
def geo6(q):
    return q.requests.select("query_id", F.round(geo.spherical_area(geo.box_ring(*box_cols())), 0).alias("area"))


@query(
    "geo7_planar_area",
    "SELECT det_id, round((xmax - xmin) * (ymax - ymin), 6) AS area, round(1 / (cos(radians(score * 60)) * cos(radians(score * 60))), 6) AS mercator_factor FROM fx_boxes",
)
def geo7(q):
    box = geo.box_geometry(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    return q.boxes.select(
        "det_id", F.round(geo.planar_area(box), 6).alias("area"),
        F.round(geo.mercator_area_factor(F.col("score") * 60), 6).alias("mercator_factor"),
    )


_FX0, _FY0 = utm_sql("min_lon", "min_lat", "32")
_FX1, _FY1 = utm_sql("max_lon", "max_lat", "32")


@query(
    "geo8_reproject",
    f"""SELECT feature_id, round({_FX0}, 3) AS x0, round({_FY0}, 3) AS y0, round({_FX1}, 3) AS x1, round({_FY1}, 3) AS y1,
 round(6378137.0 * radians(min_lon), 3) AS mx, round(6378137.0 * ln(tan(pi() / 4 + radians(min_lat) / 2)), 3) AS my, round(min_lon, 7) AS lon FROM fx_features""",
)
def geo8(q):
    df = q.features.withColumn("geom", geo.box_geometry(*box_cols())).select(
        "feature_id",
        geo.reproject(F.col("geom"), 32632, 3).alias("u"),
        geo.reproject(F.col("geom"), 3857, 3).alias("m"),
        geo.to_lonlat(geo.reproject(F.col("geom"), 25832, 8), 25832, 7).alias("back"),
    )
    u = F.col("u")[0][0]
    return df.select(
        "feature_id", u[0]["x"].alias("x0"), u[0]["y"].alias("y0"), u[2]["x"].alias("x1"), u[2]["y"].alias("y1"),
        F.col("m")[0][0][0]["x"].alias("mx"), F.col("m")[0][0][0]["y"].alias("my"),
        F.col("back")[0][0][0]["x"].alias("lon"),
    )


@query(
    "geo8_crs_check",
    "SELECT o_orderkey AS id, CASE WHEN c IN (4326, 4258, 3857) OR (c BETWEEN 32601 AND 32660) OR (c BETWEEN 32701 AND 32760) OR (c BETWEEN 25828 AND 25838) THEN NULL ELSE concat('unsupported CRS EPSG:', c) END AS error FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 4326 WHEN 1 THEN 32590 + o_orderkey % 200 ELSE 25820 + o_orderkey % 30 END AS c FROM orders) t",
)
def geo8_crs(q):
    k = F.col("o_orderkey")
    code = F.when(k % 3 == 0, F.lit(4326)).when(k % 3 == 1, 32590 + k % 200).otherwise(25820 + k % 30)
    return q.table("orders").select(k.alias("id"), proj.crs_error(code).alias("error"))


CLIP = (7.62, 51.91, 7.6802, 51.9703)
CLIP_SQL = "greatest(min_lon, 7.62) AS a, greatest(min_lat, 51.91) AS b, least(max_lon, 7.6802) AS c, least(max_lat, 51.9703) AS d"


@query(
    "geo9_clip_features",
    f"""WITH k AS (SELECT *, {CLIP_SQL} FROM fx_features WHERE geom_type IN ('Polygon', 'MultiPolygon')),
s AS (SELECT *, (c - a) * (d - b) < (max_lon - min_lon) * (max_lat - min_lat) * (1 - 1e-9) AS shrunk FROM k WHERE a < c AND b < d),
g AS ({area_sql('s', '*', ('a', 'b', 'c', 'd'))})
SELECT feature_id, round(a, 9) AS min_x, round(b, 9) AS min_y, round(c, 9) AS max_x, round(d, 9) AS max_y,
 CASE WHEN p_area_m2 IS NULL THEN NULL WHEN shrunk THEN round(area, 1) ELSE round(p_area_m2, 1) END AS area_m2 FROM g""",
)
def geo9(q):
    df = q.features.filter(F.col("geom_type").isin("Polygon", "MultiPolygon")).withColumn(
        "geom", geo.box_geometry(*box_cols())
    ).withColumn("area_m2", F.col("p_area_m2"))
    out = feat.clip_features(df, *[F.lit(v) for v in CLIP], digits=1).withColumn("b", geo.bounds(F.col("geom")))
    return out.select(
        "feature_id",
        *[F.round(F.col("b")[c], 9).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")],
        F.round("area_m2", 1).alias("area_m2"),
    )


COMB_BOX = (160.25, 140.5, 755.75, 683.25)


@query(
    "geo9_clip_parts",
    f"""WITH f AS (SELECT o_orderkey AS feature_id, CAST(o_orderkey % 1000 AS DOUBLE) AS x, CAST(o_custkey % 1000 AS DOUBLE) AS y, 2 + o_orderkey % 4 AS teeth FROM orders),
b AS (SELECT *, greatest(0, least(x + 20 * teeth - 10, {COMB_BOX[2]}) - greatest(x, {COMB_BOX[0]})) * greatest(0, least(y + 10, {COMB_BOX[3]}) - greatest(y, {COMB_BOX[1]})) AS back FROM f),
t AS (SELECT feature_id, x, y, unnest(range(0, teeth)) AS k FROM f),
a AS (SELECT feature_id, greatest(0, least(x + 20 * k + 10, {COMB_BOX[2]}) - greatest(x + 20 * k, {COMB_BOX[0]})) * greatest(0, least(y + 40, {COMB_BOX[3]}) - greatest(y + 10, {COMB_BOX[1]})) AS tooth FROM t),
s AS (SELECT feature_id, sum(tooth) AS teeth, count(*) FILTER (tooth > 0) AS n FROM a GROUP BY feature_id)
SELECT feature_id, CASE WHEN back > 0 THEN 1 ELSE n END AS parts, round(back + s.teeth, 6)::DOUBLE AS area FROM b JOIN s USING (feature_id) WHERE back + s.teeth > 0""",
)
def geo9_parts(q):
    """Combs cut by a box: without their back, the teeth are polygons of their own."""
    k = F.col("o_orderkey")
    x, y, teeth = (k % 1000).cast("double"), (F.col("o_custkey") % 1000).cast("double"), (2 + k % 4).cast("int")
    # From the first tooth to the last: up its left side, across, and down to the back again.
    tooth = lambda i: F.array(*[geo.point(x + 20 * i + dx, y + dy) for dx, dy in ((0, 10), (0, 40), (10, 40), (10, 10))])
    top = F.flatten(F.transform(F.sequence(F.lit(0), teeth - 1), tooth))
    ring = F.concat(F.array(geo.point(x, y)), top, F.array(geo.point(x + 20 * teeth - 10, y), geo.point(x, y)))
    df = q.table("orders").select(k.alias("feature_id"), F.array(F.array(ring)).alias("geom"), F.lit(None).cast("double").alias("area_m2"))
    out = feat.clip_features(df, *[F.lit(v) for v in COMB_BOX])
    return out.select("feature_id", F.size("geom").cast("long").alias("parts"), F.round(geo.planar_area(F.col("geom")), 6).alias("area"))


@query(
    "geo10_bounds",
    "SELECT det_id, xmin AS min_x, ymin AS min_y, xmax AS max_x, ymax AS max_y FROM fx_boxes",
)
def geo10(q):
    ring = geo.box_geometry(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    return q.boxes.select("det_id", geo.bounds(ring).alias("b")).select("det_id", "b.*")


@query(
    "geo11_vertex_count",
    "SELECT det_id, CAST(5 * (1 + det_id % 3) AS INT) AS vertices FROM fx_boxes",
)
def geo11(q):
    ring = geo.box_ring(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    geom = F.transform(F.sequence(F.lit(0), F.col("det_id") % 3), lambda i: F.array(ring))
    return q.boxes.select("det_id", geo.vertex_count(geom).alias("vertices"))


@query(
    "geo16_pixel_to_world",
    """SELECT det_id, round(least(400000 + 0.3 * xmin, 400000 + 0.3 * xmax), 6) AS min_x, round(least(5750000 - 0.3 * ymin, 5750000 - 0.3 * ymax), 6) AS min_y,
 round(greatest(400000 + 0.3 * xmin, 400000 + 0.3 * xmax), 6) AS max_x, round(greatest(5750000 - 0.3 * ymin, 5750000 - 0.3 * ymax), 6) AS max_y FROM fx_boxes""",
)
def geo16(q):
    from skytable.operators import detections

    placed = detections.georeference(
        q.boxes,
        geo.transform_from_bounds(
            F.lit(400000.0), F.lit(5750000.0 - 0.3 * 2048), F.lit(400000.0 + 0.3 * 2048), F.lit(5750000.0), F.lit(2048), F.lit(2048)
        ),
    )
    return placed.select(
        "det_id", *[F.round(c, 6).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")]
    )


_TX = "CAST(floor((min_lon / 360 + 0.5 + 1e-14) * 4096) AS BIGINT)"
_TY = "CAST(floor((0.5 - 0.25 * ln((1 + sin(radians(min_lat))) / (1 - sin(radians(min_lat)))) / pi() + 1e-14) * 4096) AS BIGINT)"


@query(
    "geo17_web_mercator",
    f"""WITH t AS (SELECT scene_id, round(6378137.0 * radians(min_lon), 3) AS x, round(6378137.0 * ln(tan(pi() / 4 + radians(min_lat) / 2)), 3) AS y, {_TX} AS tx, {_TY} AS ty FROM fx_scenes)
SELECT *, array_to_string(list_transform(generate_series(11, 0, -1), lambda b: CAST(((tx >> b) & 1) + 2 * ((ty >> b) & 1) AS VARCHAR)), '') AS quadkey FROM t""",
)
def geo17(q):
    x, y = proj.to_mercator(F.col("min_lon"), F.col("min_lat"))
    df = q.scenes.select(
        "scene_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"),
        geo.tile_x(F.col("min_lon"), 12).alias("tx"), geo.tile_y(F.col("min_lat"), 12).alias("ty"),
    )
    return df.withColumn("quadkey", geo.quadkey(F.col("tx"), F.col("ty"), 12))


@query(
    "geo18_box_ring",
    "SELECT query_id, i, CASE WHEN i IN (0, 3, 4) THEN min_lon ELSE max_lon END AS x, CASE WHEN i IN (0, 1, 4) THEN min_lat ELSE max_lat END AS y FROM fx_requests, (SELECT unnest([0, 1, 2, 3, 4]) AS i) n",
)
def geo18(q):
    return q.requests.select("query_id", F.posexplode(geo.box_ring(*box_cols())).alias("i", "p")).select(
        "query_id", "i", "p.x", "p.y"
    )


@query(
    "geo19_proj_props",
    """SELECT scene_id, 4326 AS epsg, 100 AS height, 150 AS width, round((max_lon - min_lon) / 150, 9) AS a, round((min_lat - max_lat) / 100, 9) AS e, min_lon AS left_x, max_lat AS top_y FROM fx_scenes""",
)
def geo19(q):
    a, b, c, d = box_cols()
    df = q.scenes.select("scene_id", feat.proj_props(F.lit(4326), F.lit(100), F.lit(150), a, b, c, d).alias("p"))
    return df.select(
        "scene_id", "p.epsg", F.col("p.shape")[0].alias("height"), F.col("p.shape")[1].alias("width"),
        F.round(F.col("p.transform")[0], 9).alias("a"), F.round(F.col("p.transform")[4], 9).alias("e"),
        F.col("p.bbox")[0].alias("left_x"), F.col("p.bbox")[3].alias("top_y"),
    )
