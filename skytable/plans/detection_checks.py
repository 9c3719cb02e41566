"""Queries: detections, mosaic index, evaluation, lifecycle, streams, model hooks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from skytable.functions import geometry as geo
from skytable.operators import detections as det
from skytable.operators import evaluate as ev
from skytable.operators import lifecycle as life
from skytable.operators import mosaic
from skytable.operators import raster as ras
from skytable.operators import scoring
from skytable.operators.features import merge_keyword_runs
from skytable.plans.catalog_checks import described_scenes
from skytable.plans.raster_checks import pair_sql, pairs
from skytable.plans.registry import query
from skytable.plans.request_checks import NAME_SQL
from skytable.operators.catalog import build_items
from skytable.session import scratch
from skytable.sources import files
from skytable.streaming import items as item_stream
from skytable.streaming import lifecycle as state_stream

IOU_SQL = "(least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin))"
AREA_SQL = "({t}.xmax - {t}.xmin) * ({t}.ymax - {t}.ymin)"


@query(
    "joi12_box_iou_pairs",
    f"""WITH d AS (SELECT image_id, cls, xmin, ymin, xmax, ymax, min(det_id) AS id, count(*) AS n FROM fx_boxes GROUP BY ALL),
p AS (SELECT a.image_id, a.cls, a.id AS id_a, b.id AS id_b, a.n AS n_a, b.n AS n_b, {IOU_SQL} AS i, {AREA_SQL.format(t='a')} + {AREA_SQL.format(t='b')} AS s
 FROM d a JOIN d b ON a.image_id = b.image_id AND a.cls = b.cls AND a.id < b.id AND a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax)
SELECT image_id, cls, id_a, id_b, n_a, n_b, round(i / (s - i), 6) AS iou FROM p WHERE i / (s - i) > 0.5
UNION ALL SELECT image_id, cls, id, id, n, n, 1.0 FROM d WHERE n > 1""",
)
def joi12(q):
    return det.box_iou_pairs(q.boxes).withColumn("iou", F.round("iou", 6))


@query("win6_nms")
def win6(q):
    return det.nms(q.boxes).select("det_id", "image_id", "cls", "score")


@query(
    "win9_dedupe_geometry",
    "SELECT det_id, image_id, score FROM (SELECT *, row_number() OVER (PARTITION BY image_id, xmin, ymin, xmax, ymax ORDER BY score DESC, det_id) AS rn FROM fx_boxes) t WHERE rn = 1",
)
def win9(q):
    return det.dedupe_geometry(q.boxes).select("det_id", "image_id", "score")


@query(
    "ras17_shift_boxes",
    "SELECT det_id, xmin + 819 * (det_id % 4) AS xmin, ymin + 819 * (det_id % 3) AS ymin, xmax + 819 * (det_id % 4) AS xmax, ymax + 819 * (det_id % 3) AS ymax FROM fx_boxes WHERE score >= 0.15",
)
def ras17(q):
    placed = q.boxes.withColumn("tile_x", 819 * (F.col("det_id") % 4)).withColumn("tile_y", 819 * (F.col("det_id") % 3))
    return det.shift_boxes(placed, 0.15).select("det_id", *det.BOX)


_SIN = "sin(radians({}))"
_ROW = "CAST(floor((0.5 - 0.25 * ln((1 + sin(radians({0}))) / (1 - sin(radians({0})))) / pi() + 1e-14) * 512) AS BIGINT)"
COVER_SQL = f"""WITH t AS (SELECT scene_id, CAST(floor((min_lon / 360 + 0.5 + 1e-14) * 512) AS BIGINT) AS x0, CAST(floor(((max_lon - 1e-9 - 1e-11) / 360 + 0.5 + 1e-14) * 512) AS BIGINT) AS x1,
 {_ROW.format('(max_lat - 1e-9)')} AS y0, {_ROW.format('(min_lat + 1e-11)')} AS y1 FROM fx_scenes),
u AS (SELECT scene_id, y0, y1, unnest(generate_series(x0, x1)) AS tx FROM t), v AS (SELECT scene_id, tx, unnest(generate_series(y0, y1)) AS ty FROM u)
SELECT scene_id, array_to_string(list_transform(generate_series(8, 0, -1), lambda b: CAST(((tx >> b) & 1) + 2 * ((ty >> b) & 1) AS VARCHAR)), '') AS quadkey FROM v"""


def mosaic_files(q):
    return q.scenes.select(F.concat(F.lit("f"), "scene_id").alias("path"), F.col("scene_id").alias("pref"), "min_lon", "min_lat", "max_lon", "max_lat")


@query("joi13_cover_tiles", COVER_SQL)
def joi13(q):
    return mosaic.cover_tiles(mosaic_files(q), 9).select(F.col("pref").alias("scene_id"), "quadkey")


@query(
    "win3_quadkey_assets",
    f"SELECT quadkey, row_number() OVER (PARTITION BY quadkey ORDER BY scene_id) AS place, concat('f', scene_id) AS path FROM ({COVER_SQL}) c",
)
def win3(q):
    return mosaic.quadkey_assets(mosaic.cover_tiles(mosaic_files(q), 9))


@query(
    "agg16_mosaic_header",
    "SELECT min(min_lon) AS west, min(min_lat) AS south, max(max_lon) AS east, max(max_lat) AS north, 8 AS minzoom, least(22, max(CAST(round(log2(156543.0339280410 / (0.1 + scene_id % 50))) AS INT))) AS maxzoom, round((min(min_lon) + max(max_lon)) / 2, 6) AS center_lon FROM fx_scenes",
)
def agg16(q):
    files_ = mosaic_files(q).withColumn("res_m", 0.1 + F.col("pref") % 50)
    return mosaic.mosaic_header(files_).withColumn("center_lon", F.round("center_lon", 6)).drop("center_lat")


METRIC_SQL = f"""SELECT cls, count(*) FILTER (WHERE a > 0 AND b > 0)::DOUBLE AS tp, count(*) FILTER (WHERE a <= 0 AND b > 0)::DOUBLE AS fp, count(*) FILTER (WHERE a > 0 AND b <= 0)::DOUBLE AS fn FROM ({pair_sql()}) t GROUP BY cls"""


def judged(q):
    return pairs(q, "x").select("cls", (F.col("a") > 0).alias("truth"), (F.col("b") > 0).alias("pred"))


@query(
    "agg14_seg_metrics",
    f"SELECT cls, round((tp + 1e-6) / (tp + fp + fn + 1e-6), 9) AS iou, round((2 * tp + 1e-6) / (2 * tp + fp + fn + 1e-6), 9) AS dice FROM ({METRIC_SQL}) m",
)
def agg14(q):
    return ev.seg_metrics(judged(q), ["cls"]).withColumn("iou", F.round("iou", 9)).withColumn("dice", F.round("dice", 9))


@query(
    "agg14_epoch_means",
    f"SELECT cls % 2 AS epoch, round(avg((tp + 1e-6) / (tp + fp + fn + 1e-6)), 9) AS iou, round(avg((2 * tp + 1e-6) / (2 * tp + fp + fn + 1e-6)), 9) AS dice FROM ({METRIC_SQL}) m GROUP BY cls % 2",
)
def agg14_epochs(q):
    means = ev.epoch_means(ev.seg_metrics(judged(q), ["cls"]).withColumn("epoch", F.col("cls") % 2))
    return means.withColumn("iou", F.round("iou", 9)).withColumn("dice", F.round("dice", 9))


@query("agg21_tversky", f"SELECT cls, round(tp / (tp + 0.3::DOUBLE * fp + 0.7::DOUBLE * fn), 9) AS score FROM ({METRIC_SQL}) m")
def agg21(q):
    return ev.tversky(judged(q), ["cls"]).withColumn("score", F.round("score", 9))


@query(
    "agg15_best_so_far",
    "SELECT event_id, user_id, value FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) t WHERE value > greatest(coalesce(m, 0), 0)",
)
def agg15(q):
    e = q.table("events").select("event_id", "user_id", "value")
    return ev.best_so_far(e, ["user_id"], ["event_id"], "value")


LIF_TEXT = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def _state_sql():
    return f"""SELECT query_id, arg_max(status, (ts, event_id)) AS status, arg_max(progress, (ts, event_id)) AS progress, {LIF_TEXT.format("min(ts) FILTER (WHERE status <> 'queued')")} AS started_at,
 {LIF_TEXT.format("max(ts) FILTER (WHERE status IN ('completed', 'failed', 'cancelled'))")} AS completed_at, {LIF_TEXT.format('max(ts)')} AS updated_at FROM fx_transitions WHERE progress BETWEEN 0 AND 100 GROUP BY query_id"""


def _state_text(states):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return states.select("query_id", "status", "progress", text("started_at"), text("completed_at"), text("updated_at"))


@query("lif1_apply_transition", _state_sql())
def lif1(q):
    return _state_text(life.apply_transitions(q.transitions))


@query("lif1_rejected", "SELECT event_id, progress FROM fx_transitions WHERE progress < 0 OR progress > 100")
def lif1_rejected(q):
    return life.split_transitions(q.transitions)[1].select("event_id", "progress")


@query(
    "lif2_stage_progress",
    """SELECT event_id, coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY query_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS stage_progress
FROM (SELECT *, CASE status WHEN 'queued' THEN 0 WHEN 'preparing' THEN 10 WHEN 'inferencing' THEN 45 WHEN 'completed' THEN 100 END AS p FROM fx_transitions) t""",
)
def lif2(q):
    return life.stage_progress(q.transitions).select("event_id", "stage_progress")


@query("lif4_stream_lifecycle", _state_sql())
def lif4(q):
    """The event table as a stream source; the stream's result equals the batch result."""
    schema = q.table("events").schema
    raw = q.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(q.sf_dir)
    status = (
        F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "signup", "preparing")
        .when(F.col("event_type") == "click", "inferencing").when(F.col("event_type") == "purchase", "completed").otherwise("failed")
    )
    events = raw.select("event_id", F.col("user_id").alias("query_id"), "ts", status.alias("status"), F.floor("value").cast("int").alias("progress"))
    out = scratch(q.spark, "states")
    state_stream.run_states(events, out, scratch(q.spark, "states-checkpoint"))
    return _state_text(state_stream.latest_states(q.spark, out))


@query(
    "lif5_stream_items",
    f"SELECT name AS id, concat('scenes-', year(sensed)) AS collection, scene_id % 3 = 0 AS again FROM (SELECT *, {NAME_SQL} AS name FROM fx_scenes) t WHERE scene_id % 13 <> 0",
)
def lif5(q):
    """Items loaded as a stream in two arrivals; the second replaces part of the first."""
    source, out, mark = scratch(q.spark, "arrivals"), scratch(q.spark, "catalogue"), scratch(q.spark, "catalogue-checkpoint")
    built = build_items(described_scenes(q)).withColumn("properties", F.from_json("properties", "map<string,string>"))
    files.write_items(built, source)
    item_stream.run_items(q.spark, source, out, mark)
    again = built.filter(F.col("properties")["sat:absolute_orbit"].cast("bigint") % 3 == 0).withColumn("properties", F.map_concat("properties", F.create_map(F.lit("again"), F.lit("1"))))
    again.write.mode("append").json(source)
    item_stream.run_items(q.spark, source, out, mark)
    current = item_stream.current_items(q.spark, out)
    return current.select("id", "collection", F.col("properties")["again"].isNotNull().alias("again"))


def tiles(q):
    """Each block as one tile of its class raster."""
    return q.blocks.select(
        F.col("cls").cast("bigint").alias("raster"), (F.floor(F.col("block_id") / 25) * 8).cast("int").alias("y"), (F.col("block_id") % 25 * 8).cast("int").alias("x"),
        F.lit(8).alias("tile_h"), F.lit(8).alias("tile_w"),
        F.when(F.col("block_id") % 7 == 0, F.transform("dn", lambda v: F.lit(0))).otherwise(F.col("dn")).alias("values"), "block_id",
    )


def threshold_model(patches):
    """Stand-in model: bright pixels; fails on a batch that holds a very dark tile."""
    if any(p.min() < 1300 for p in patches):
        raise RuntimeError("dark tile")
    return [p > 2000 for p in patches]


@query(
    "udf1_score_tiles",
    """WITH b AS (SELECT block_id, cls, block_id % 7 = 0 AS blank, min(dn) < 1300 AS bad FROM fx_pixels GROUP BY ALL)
SELECT p.cls AS raster, (p.block_id // 25 * 8 + p.r)::INT AS r, (p.block_id % 25 * 8 + p.c)::INT AS c, p.dn > 2000 AS "on" FROM fx_pixels p JOIN b USING (block_id) WHERE NOT blank AND NOT bad""".replace(
        "b AS (SELECT block_id, cls, block_id % 7 = 0 AS blank, min(dn) < 1300 AS bad FROM fx_pixels GROUP BY ALL)",
        "b AS (SELECT block_id, block_id % 7 = 0 AS blank, min(dn) < 1300 AS bad FROM fx_pixels GROUP BY block_id)",
    ),
)
def udf1(q):
    return scoring.tile_pixels(scoring.score_tiles(tiles(q), threshold_model, batch=4)).withColumn("raster", F.col("raster").cast("int"))


@query(
    "agg19_tile_report",
    """WITH b AS (SELECT block_id, cls, block_id % 7 = 0 AS blank, min(dn) < 1300 AS bad FROM fx_pixels GROUP BY block_id, cls)
SELECT cls::BIGINT AS raster, count(*) AS tiles, count(*) FILTER (WHERE NOT blank AND NOT bad) AS done, count(*) FILTER (WHERE blank) AS empty, count(*) FILTER (WHERE NOT blank AND bad) AS failed FROM b GROUP BY cls""",
)
def agg19(q):
    return scoring.tile_report(scoring.score_tiles(tiles(q), threshold_model, batch=4))


@query(
    "udf2_score_keywords",
    """WITH k AS (SELECT * FROM (VALUES (0, 'tree', 4), (1, 'road', 4)) t(o, keyword, n)) SELECT p.cls::BIGINT AS query_id, k.keyword, count(*) FILTER (WHERE p.dn > 1900 + 100 * k.o) AS pixels FROM fx_pixels p, k WHERE p.block_id % 7 <> 0 GROUP BY p.cls, k.keyword""",
)
def udf2(q):
    asked = q.blocks.select(F.col("cls").cast("bigint").alias("raster")).distinct().withColumn("query_id", F.col("raster")).withColumn("keywords", F.array(F.lit("tree"), F.lit("road")))
    model = lambda patches, keyword: [p > (1900 if keyword == "tree" else 2000) for p in patches]
    scored = scoring.score_keywords(tiles(q), asked, model, batch=4).withColumn("cls", F.lit(None).cast("string"))
    merged = merge_keyword_runs(scored.withColumn("run_keyword", F.col("keyword")))
    on = F.coalesce(F.size(F.filter("mask", lambda v: v)), F.lit(0))
    return merged.groupBy("query_id", "keyword").agg(F.sum(on).cast("bigint").alias("pixels"))


def peak_model(tile):
    """Stand-in box model: a box about the brightest pixel."""
    r, c = np.unravel_index(int(np.argmax(tile)), tile.shape)
    return [(c - 2, r - 2, c + 3, r + 3, (tile[r, c] % 997) / 997, "spot"), (c - 2, r - 1, c + 3, r + 4, 0.05, "spot")]


@query("udf3_detect")
def udf3(q):
    """Model boxes to georeferenced, suppressed detections with areas."""
    found = scoring.detect(tiles(q), peak_model).withColumn("image_id", F.col("raster")).withColumn(
        "det_id", F.col("raster") * 1_000_000_000 + F.col("tile_y").cast("bigint") * 100_000 + F.col("tile_x") * 10 + F.col("n")
    )
    kept = det.nms(det.shift_boxes(found, 0.1), 0.5)
    transform = F.array(*[F.lit(v) for v in (0.3, 0.0, 400000.0, 0.0, -0.3, 5750000.0)])
    placed = det.georeference(kept, transform)
    ring = geo.box_geometry(*[F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")])
    return placed.select("det_id", "image_id", "score", "min_x", "max_y", F.round(geo.planar_area(ring), 6).alias("area_m2"))


@query(
    "lif1_messages",
    """WITH g AS (SELECT *, 'Prediction ' || status AS status_message, CASE WHEN status = 'failed' THEN 'prediction_failed' END AS error_code, CASE WHEN status = 'failed' THEN 'event ' || event_id END AS error_message
  FROM fx_transitions WHERE progress BETWEEN 0 AND 100 AND status IN ('queued', 'preparing', 'inferencing', 'postprocessing', 'completed', 'failed', 'cancelled')),
l AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT query_id, status, progress, status_message, error_code, error_message FROM l""",
)
def lif1_messages(q):
    """Message, error code and error text of the last event of each request."""
    failed = F.col("status") == "failed"
    events = q.transitions.withColumns({
        "status_message": F.concat(F.lit("Prediction "), F.col("status")),
        "error_code": F.when(failed, F.lit("prediction_failed")),
        "error_message": F.when(failed, F.concat(F.lit("event "), F.col("event_id").cast("string"))),
    })
    return life.apply_transitions(events).select("query_id", "status", "progress", "status_message", "error_code", "error_message")
