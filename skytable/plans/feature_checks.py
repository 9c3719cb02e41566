"""Queries: features, exports, query log and lifecycle rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytable.functions import geometry as geo
from skytable.functions.text import non_blank
from skytable.operators import exports as ex
from skytable.operators import features as feat
from skytable.operators.skew import numbered
from skytable.plans.geometry_checks import area_sql
from skytable.plans.registry import query
from skytable.session import scratch
from skytable.sources import files

BOX = ("min_lon", "min_lat", "max_lon", "max_lat")


def features(q):
    """Fixture features with a property map and a geometry."""
    props = F.map_filter(
        F.create_map(
            F.lit("class"), F.col("p_class"), F.lit("label"), F.col("p_label"), F.lit("score"), F.col("p_score_pct"),
            F.lit("confidence"), F.when(F.col("feature_id") % 5 == 0, (F.col("feature_id") % 100 / 100).cast("string")),
            F.lit("area_m2"), F.col("p_area_m2").cast("string"),
        ),
        lambda _, v: v.isNotNull(),
    )
    return q.features.withColumn("props", props).withColumn("geom", geo.box_geometry(*[F.col(c) for c in BOX]))


LABEL_SQL = "coalesce(nullif(trim(p_class), ''), nullif(trim(p_label), ''), 'annotation')"


@query("fil8_feature_label", f"SELECT feature_id, {LABEL_SQL} AS label FROM fx_features")
def fil8(q):
    return features(q).select("feature_id", feat.feature_label(F.col("props")).alias("label"))


@query(
    "fil9_feature_confidence",
    "SELECT feature_id, CASE WHEN feature_id % 5 = 0 THEN (feature_id % 100)::DOUBLE / 100 END AS confidence, coalesce(CASE WHEN feature_id % 5 = 0 THEN (feature_id % 100)::DOUBLE / 100 END, CAST(p_score_pct AS DOUBLE)) AS any_score FROM fx_features",
)
def fil9(q):
    p = F.col("props")
    return features(q).select(
        "feature_id", feat.feature_confidence(p).alias("confidence"), feat.feature_confidence(p, fallback=True).alias("any_score")
    )


@query(
    "fil10_feature_area",
    "SELECT feature_id, round(CASE WHEN p_area_m2 >= 0 THEN p_area_m2 ELSE area END, 1) AS area FROM (" + area_sql("fx_features", "*") + ") t",
)
def fil10(q):
    return features(q).select("feature_id", F.round(feat.feature_area(F.col("props"), F.col("geom")), 1).alias("area"))


@query(
    "fil7_filter_features",
    f"""SELECT feature_id FROM ({area_sql("fx_features", "*")}) t WHERE geom_type = 'Polygon' AND lower({LABEL_SQL}) IN ('1-urgent', '5-low', 'annotation', 'f')
 AND feature_id % 5 = 0 AND (feature_id % 100)::DOUBLE / 100 >= 0.3 AND coalesce(p_area_m2, area) BETWEEN 300 AND 2000""",
)
def fil7(q):
    return feat.filter_features(
        features(q), ["Polygon"], ["1-Urgent", "5-low", "ANNOTATION", "F"], 0.3, 300.0, 2000.0
    ).select("feature_id")


@query(
    "fil11_json_safe",
    """SELECT event_id, replace(props, ' ', '') AS nested, concat('[1,', user_id, ']') AS list, event_type AS type, CAST(value AS DOUBLE) AS value FROM events""",
)
def fil11(q):
    """Event documents as property maps: scalars stay, nested values become JSON text."""
    doc = F.concat(F.lit('{"nested":'), "props", F.lit(',"list":[1,'), "user_id", F.lit('],"type":"'), "event_type", F.lit('","value":'), "value", F.lit("}"))
    parsed = F.from_json(doc, "map<string,variant>")
    safe = q.table("events").select("event_id", feat.json_safe(parsed).alias("p"))
    return safe.select("event_id", *[F.col("p")[k].alias(k) for k in ("nested", "list", "type")], F.col("p")["value"].cast("double").alias("value"))


@query(
    "agg5_class_registry",
    f"""WITH c AS (SELECT query_id, nullif(trim(p_class), '') AS cls, min(ord) AS f FROM fx_features WHERE trim(p_class) <> '' GROUP BY 1, 2),
x AS (SELECT query_id, cls, row_number() OVER (PARTITION BY query_id ORDER BY f, cls) AS n FROM c WHERE cls NOT IN ('3-MEDIUM', '1-URGENT'))
SELECT query_id, cls, CASE cls WHEN '3-MEDIUM' THEN 0 ELSE 1 END AS color_index, false AS is_extra FROM c WHERE cls IN ('3-MEDIUM', '1-URGENT') UNION ALL SELECT query_id, cls, CAST(1 + n AS INT), true FROM x""",
)
def agg5(q):
    named = q.features.withColumn("cls", feat.class_name(non_blank(F.col("p_class")), F.lit(None).cast("string")))
    return feat.class_registry(named, ["3-MEDIUM", "1-URGENT"]).select("query_id", "cls", "color_index", "is_extra")


def labelled(q):
    return features(q).withColumn("label", feat.feature_label(F.col("props")))


@query(
    "agg6_label_values",
    f"""SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY f) AS value, 'uint8' AS dtype FROM (SELECT query_id, {LABEL_SQL} AS label, min(ord) AS f FROM fx_features GROUP BY 1, 2) t""",
)
def agg6(q):
    return feat.label_values(labelled(q)).select("query_id", "label", "value", "dtype")


@query(
    "agg7_export_counts",
    "SELECT query_id, count(*) AS source_feature_count, count(*) FILTER (WHERE geom_type <> 'LineString') AS exported_feature_count FROM fx_features GROUP BY query_id",
)
def agg7(q):
    return feat.export_counts(q.features, F.col("geom_type") != "LineString")


@query(
    "set1_merge_keyword_runs",
    """SELECT feature_id, coalesce(nullif(trim(p_class), ''), k) AS cls, k AS keyword FROM (SELECT *, CASE WHEN feature_id % 2 = 0 THEN 'roof' ELSE 'car' END AS k FROM fx_features) t""",
)
def set1(q):
    runs = q.features.withColumn("cls", non_blank(F.col("p_class")))
    roof = runs.filter("feature_id % 2 = 0").withColumn("run_keyword", F.lit("roof"))
    car = runs.filter("feature_id % 2 = 1").withColumn("run_keyword", F.lit("car"))
    return feat.merge_keyword_runs(roof.unionByName(car)).select("feature_id", "cls", "keyword")


@query(
    "set1_keyword_summary",
    "SELECT query_id, count(*) AS feature_count, concat('Found ', count(*), ' polygons/clusters for roof, car') AS summary FROM fx_features GROUP BY query_id",
)
def set1_summary(q):
    keywords = q.features.select("query_id").distinct().withColumn("keywords", F.array(F.lit("roof"), F.lit("car")))
    return feat.keyword_summary(q.features, keywords).select("query_id", "feature_count", "summary")


@query(
    "set2_concat_tiles",
    "SELECT CASE WHEN det_id % 3 = 0 THEN 'a' ELSE 'b' END AS tile, count(*) AS boxes, round(sum(score), 6) AS score FROM fx_boxes GROUP BY 1",
)
def set2(q):
    from skytable.operators.detections import concat_tiles

    tiles = [q.boxes.filter("det_id % 3 = 0").withColumn("tile", F.lit("a")), q.boxes.filter("det_id % 3 <> 0").withColumn("tile", F.lit("b"))]
    return concat_tiles(tiles).groupBy("tile").agg(F.count(F.lit(1)).alias("boxes"), F.round(F.sum("score"), 6).alias("score"))


def documents_of(q):
    f = features(q).select(
        "query_id", "ord", geo.geometry_json(F.col("geom"), F.when(F.col("geom_type") == "LineString", F.lit("Polygon")).otherwise(F.col("geom_type"))).alias("geometry"),
        F.to_json(F.map_concat("props", F.create_map(F.lit("ord"), F.col("ord").cast("string")))).alias("properties"),
    )
    path = scratch(q.spark, "documents")
    files.write_feature_collections(f, path)
    return path


@query("src3_read_features", "SELECT query_id % 100 AS query_id, count(*) AS features, count(*) FILTER (WHERE trim(p_class) = '') AS blank FROM fx_features GROUP BY 1")
def src3(q):
    """Whole documents of 5,000 features of a query at most, one array element per feature."""
    f = features(q).withColumn("props", F.map_concat("props", F.create_map(F.lit("qid"), F.col("query_id").cast("string"))))
    path = scratch(q.spark, "collections")
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type")).alias("geometry"), F.col("props").alias("properties"))
    # Rows come to the lists in order, so no list is sorted by a function of two elements.
    keys = ["query_id", "part"]
    placed = numbered(f.select("query_id", "ord", "props"), ["query_id"], ["ord"], "place")
    sorted_ = placed.withColumn("part", F.floor((F.col("place") - 1) / 5000)).repartition(*keys).sortWithinPartitions(*keys, "ord")
    per = sorted_.groupBy(*keys).agg(F.collect_list(feature).alias("features"))
    per.select(F.lit("FeatureCollection").alias("type"), "features").write.option("maxRecordsPerFile", 1).json(path)
    return files.read_features(q.spark, path).groupBy(
        F.col("props")["qid"].cast("bigint").alias("query_id")
    ).agg(F.count(F.lit(1)).alias("features"), F.count_if(non_blank(F.col("props")["class"]).isNull()).alias("blank"))


@query(
    "src6_write_feature_collections",
    "SELECT query_id, ord, coalesce(nullif(trim(p_class), ''), '-') AS cls, CASE geom_type WHEN 'MultiPolygon' THEN 'MultiPolygon' ELSE 'Polygon' END AS geom_type, round(min_lon, 9) AS x FROM fx_features",
)
def src6(q):
    """Documents written in order and read back line by line."""
    back = files.read_feature_lines(q.spark, documents_of(q))
    geom = files.parse_coordinates(F.col("coordinates"), F.col("geom_type"))
    return back.select(
        F.col("query_id").cast("bigint").alias("query_id"), F.col("props")["ord"].cast("bigint").alias("ord"),
        F.coalesce(non_blank(F.col("props")["class"]), F.lit("-")).alias("cls"), "geom_type", F.round(geom[0][0][0]["x"], 9).alias("x"),
    )


# --- the query log: one row per order
LOG_SQL = """SELECT o_orderkey AS query_id, CASE o_orderkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'inferencing' ELSE 'completed' END AS status, o_orderdate + to_seconds(o_orderkey % 86400) AS created_at,
 CASE o_orderkey % 3 WHEN 0 THEN 'path' WHEN 1 THEN 'embedded' END AS kind, o_orderkey % 100 AS feature_count, o_orderkey, o_custkey FROM orders"""


def query_log(q):
    k = F.col("o_orderkey")
    status = F.when(k % 5 == 0, F.lit("failed")).when(k % 5 == 1, F.lit("inferencing")).otherwise(F.lit("completed"))
    result = F.to_json(
        F.struct(
            F.when(k % 3 == 0, F.concat(F.lit("queries/"), k, F.lit("/result.geojson"))).alias("result_path"),
            F.when(k % 3 == 1, F.struct(F.lit("FeatureCollection").alias("type"))).alias("geojson"),
            F.lit("zero_shot_detection").alias("prediction_type"),
            F.when(k % 2 == 0, F.lit("lang-sam-sam2.1_hiera_tiny")).otherwise(F.lit("yolo26")).alias("model_name"),
            (k % 100).alias("feature_count"),
            F.concat(F.lit("Found "), k % 100, F.lit(" roof polygons/clusters")).alias("summary"),
            F.when(k % 4 == 0, F.array(F.lit("roof"), F.lit("car"))).alias("keywords"),
        )
    )
    n = lambda t: F.lit(None).cast(t)
    created = (F.col("o_orderdate") + F.make_dt_interval(secs=(k % 86400).cast("decimal(18,6)"))).cast("timestamp_ntz")
    return q.table("orders").select(
        k.alias("query_id"), *[F.lit(v).alias(c) for v, c in ((51.95, "min_lat"), (51.96, "max_lat"), (7.61, "min_lon"), (7.62, "max_lon"))],
        status.alias("status"), n("string").alias("request_payload"), (k % 100).cast("int").alias("progress_percent"),
        F.lit("old").alias("status_message"), n("string").alias("error_code"), n("string").alias("error_message"),
        *[n("timestamp_ntz").alias(c) for c in ("started_at", "completed_at", "updated_at")], n("string").alias("image_url"),
        n("int").alias("image_width"), n("int").alias("image_height"), result.alias("prediction_result"), created.alias("created_at"),
    )


@query("src7_read_query_log", f"SELECT status, count(*) AS n, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS latest FROM ({LOG_SQL}) l WHERE status IN ('completed', 'failed') GROUP BY status")
def src7(q):
    path = scratch(q.spark, "query-log")
    ex.write_query_log(query_log(q), path)
    log = ex.read_query_log(q.spark, path).filter(F.col("status").isin("completed", "failed"))
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.max("created_at"), "yyyy-MM-dd HH:mm:ss").alias("latest"))


@query(
    "src8_resolve_result_source",
    f"""SELECT query_id, kind, CASE WHEN kind = 'path' THEN concat('queries/', query_id, '/result.geojson') END AS path, CASE WHEN kind = 'embedded' THEN '{{"type":"FeatureCollection"}}' END AS geojson FROM ({LOG_SQL}) l WHERE status = 'completed'""",
)
def src8(q):
    return ex.result_source(query_log(q))


def manifests(q):
    k = F.col("o_orderkey")
    artifact = lambda name, path: F.struct(F.lit(name).alias("name"), F.lit(path).alias("path"), F.lit("x/y").alias("media_type"))
    vector = artifact("geojson", "annotations.geojson")
    return q.table("orders").select(
        F.concat(F.lit("e"), k).alias("export_id"), (F.col("o_custkey")).cast("string").alias("query_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"), (k % 50).alias("source_feature_count"),
        F.lit("EPSG:4326").alias("output_crs"),
        F.when(k % 2 == 0, F.array(vector, artifact("zip", "export_bundle.zip"))).otherwise(F.array(vector)).alias("artifacts"),
    )


@query(
    "src10_manifests",
    "SELECT concat('e', o_orderkey) AS export_id, CAST(o_custkey AS VARCHAR) AS query_id, strftime(o_orderdate, '%Y-%m-%d') AS created_at, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS n_artifacts FROM orders",
)
def src10(q):
    """Manifests written and listed; broken documents among them are skipped."""
    path = scratch(q.spark, "manifests")
    files.write_manifests(manifests(q), path)
    q.table("nation").select(F.lit('{"export_id": "broken').alias("value")).write.mode("append").text(path)
    return ex.list_exports(files.read_manifests(q.spark, path)).select("export_id", "query_id", "created_at", F.size("artifacts").alias("n_artifacts"))


@query(
    "win4_list_exports",
    "SELECT concat('e', o_orderkey) AS export_id, strftime(o_orderdate, '%Y-%m-%d') AS created_at FROM orders WHERE o_custkey = 7",
)
def win4(q):
    return ex.list_exports(manifests(q), "7").select("export_id", "created_at")


@query(
    "joi9_lookup_artifact",
    "SELECT concat('e', o_orderkey) AS export_id, 'zip' AS name, 'export_bundle.zip' AS path FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0",
)
def joi9(q):
    asked = q.table("orders").filter("o_orderkey % 3 <> 0").select(F.concat(F.lit("e"), "o_orderkey").alias("export_id"), F.lit("zip").alias("name"))
    return ex.lookup_artifact(manifests(q), asked).select("export_id", "name", "path")


@query(
    "joi9_latest_artifact",
    """SELECT query_id, export_id, 'export_bundle.zip' AS path FROM (SELECT CAST(o_custkey AS VARCHAR) AS query_id, o_orderkey, concat('e', o_orderkey) AS export_id, row_number() OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, concat('e', o_orderkey) DESC) AS rn FROM orders) t WHERE rn = 1 AND o_orderkey % 2 = 0""",
)
def joi9_latest(q):
    return ex.latest_artifact(manifests(q), "zip").select("query_id", "export_id", "path")


@query(
    "joi8_join_exports",
    f"""SELECT r.l_id AS export_request, CASE WHEN l.status IS NULL OR l.status <> 'completed' THEN 'Completed prediction not found' WHEN l.kind IS NULL THEN 'Prediction GeoJSON file not found' ELSE 'ok' END AS outcome
FROM (SELECT event_id AS l_id, event_id * 3 AS query_id FROM events) r LEFT JOIN ({LOG_SQL}) l USING (query_id)""",
)
def joi8(q):
    asked = q.table("events").select(F.col("event_id").alias("export_request"), (F.col("event_id") * 3).alias("query_id"))
    return ex.join_exports(asked, query_log(q)).select("export_request", "outcome")


@query(
    "win1_history",
    f"""SELECT query_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created, CASE WHEN query_id % 2 = 0 THEN 'sam2.1_hiera_tiny' END AS model_variant, concat('Found ', feature_count, ' roof polygons/clusters') AS summary FROM ({LOG_SQL}) l WHERE status = 'completed' ORDER BY created_at DESC, query_id LIMIT 10""",
)
def win1(q):
    return ex.history(query_log(q)).select("query_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"), "model_variant", "summary")


@query(
    "fil28_history_items",
    f"""SELECT query_id, CASE WHEN query_id % 4 = 0 THEN 'roof|car' ELSE '' END AS keywords, feature_count, CASE WHEN query_id % 2 = 0 THEN 'lang-sam-sam2.1_hiera_tiny' ELSE 'yolo26' END AS model_name FROM ({LOG_SQL}) l""",
)
def fil28(q):
    return ex.history_items(query_log(q)).select("query_id", F.array_join("keywords", "|").alias("keywords"), "feature_count", "model_name")


@query(
    "fil27_result_metadata",
    """SELECT query_id, CASE WHEN model_type = 'zeroshot' AND query_id % 3 = 2 THEN concat('Found ', query_id % 50, ' polygons/clusters for tree, roof') WHEN model_type = 'zeroshot' THEN concat('Found ', query_id % 50, ' tree polygons/clusters')
 WHEN model_type = 'yolo' THEN concat('Found ', query_id % 50, ' objects') WHEN model_type = 'water_prithvi' THEN concat('Found ', query_id % 50, ' water polygons') ELSE concat('Found ', query_id % 50, ' tree polygons/clusters') END AS summary,
 CASE WHEN model_type = 'zeroshot' THEN 'sam2.1_hiera_large' END AS variant, query_id % 50 AS n FROM fx_requests""",
)
def fil27(q):
    from skytable.operators.requests import model_attributes

    k = F.col("query_id")
    words = F.when(F.col("model_type") != "zeroshot", F.array().cast("array<string>")).when(k % 3 == 2, F.array(F.lit("tree"), F.lit("roof"))).otherwise(F.array(F.lit("tree")))
    df = model_attributes(q.requests).withColumn("keywords", words).withColumn("feature_count", k % 50).withColumn(
        "result_path", F.lit("p")
    ).withColumn("model_variant", F.lit("sam2.1_hiera_large"))
    out = ex.result_metadata(df)
    return out.select("query_id", "summary", F.get_json_object("prediction_result", "$.model_variant").alias("variant"), F.get_json_object("prediction_result", "$.feature_count").cast("bigint").alias("n"))


@query(
    "fil19_plan_deletes",
    f"""SELECT r.query_id, CASE WHEN l.status IS NULL THEN 'not_found' WHEN l.status IN ('completed', 'failed') THEN 'delete' ELSE 'conflict' END AS decision FROM (SELECT DISTINCT event_id * 3 AS query_id FROM events) r LEFT JOIN ({LOG_SQL}) l USING (query_id)""",
)
def fil19(q):
    ids = q.table("events").select((F.col("event_id") * 3).alias("query_id"))
    return ex.plan_deletes(query_log(q), ids).select("query_id", "decision")


@query(
    "fil19_apply_deletes",
    f"SELECT query_id, status FROM ({LOG_SQL}) l WHERE NOT (status IN ('completed', 'failed') AND query_id IN (SELECT event_id * 3 FROM events))",
)
def fil19_apply(q):
    ids = q.table("events").select((F.col("event_id") * 3).alias("query_id"))
    log = query_log(q)
    return ex.apply_deletes(log, ex.plan_deletes(log, ids)).select("query_id", "status")


@query(
    "lif3_backfill",
    f"SELECT query_id, CASE WHEN status = 'completed' THEN 100 ELSE CAST(query_id % 100 AS INT) END AS progress_percent, CASE WHEN status = 'completed' THEN 'Historical completed prediction' ELSE 'old' END AS status_message FROM ({LOG_SQL}) l",
)
def lif3(q):
    return ex.backfill(query_log(q)).select("query_id", "progress_percent", "status_message")
