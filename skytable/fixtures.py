"""Geospatial views over the driver's tables: the inputs of the registered queries.

The texts are Spark SQL. ``duck`` gives the same text for DuckDB; only the pixel
view needs a text of its own there.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_scenes": """SELECT o_orderkey AS scene_id,
  concat('T', CAST(31 + o_custkey % 3 AS STRING), 'U', substr('ABCDEFGH', CAST(1 + o_custkey % 8 AS INT), 1), substr('KLMNPQRS', CAST(1 + (o_custkey DIV 8) % 8 AS INT), 1)) AS tile,
  o_orderdate AS sensed,
  CAST(CAST(floor(o_totalprice) AS BIGINT) % 10000 AS DOUBLE) / 100 AS cloud,
  CASE WHEN o_orderkey % 11 = 0 THEN CAST(NULL AS STRING) WHEN o_orderkey % 2 = 0 THEN 'S2A_MSIL2A' ELSE 'S2B_MSIL2A' END AS title,
  5 + CAST((o_orderkey * 7) % 1100 AS DOUBLE) / 100 AS min_lon,
  46.5 + CAST((o_orderkey * 13) % 900 AS DOUBLE) / 100 AS min_lat,
  5 + CAST((o_orderkey * 7) % 1100 AS DOUBLE) / 100 + 1.5 AS max_lon,
  46.5 + CAST((o_orderkey * 13) % 900 AS DOUBLE) / 100 + 1.0 AS max_lat,
  CAST(20 + o_orderkey % 80 AS DOUBLE) / 100 AS valid_fraction
FROM orders""",
    "fx_links": """SELECT l_orderkey AS link_seq,
  concat('T', CAST(31 + l_orderkey % 1500 % 3 AS STRING), 'U', substr('ABCDEFGH', CAST(1 + l_partkey % 8 AS INT), 1), substr('KLMNPQRS', CAST(1 + (l_partkey DIV 8) % 8 AS INT), 1)) AS tile_id,
  l_shipdate AS start_date, l_discount AS cloud_fraction, CASE WHEN l_returnflag = 'R' THEN ' Downloaded ' ELSE 'failed' END AS status,
  l_linenumber AS tie1, l_partkey AS tie2, l_suppkey AS tie3
FROM lineitem""",
    "fx_boxes": """SELECT det_id * 1000 + rn AS det_id, image_id, cls, score, xmin, ymin, xmin + w AS xmax, ymin + h AS ymax FROM (
  SELECT l_orderkey * 8 + l_linenumber AS det_id, l_orderkey % 50 AS image_id, l_returnflag AS cls,
    CAST((l_partkey * 31 + l_suppkey * 7 + l_orderkey) % 9973 AS DOUBLE) / 9973 AS score,
    CAST((l_partkey * 37) % 2048 AS DOUBLE) AS xmin, CAST((l_suppkey * 53 + l_partkey * 11) % 2048 AS DOUBLE) AS ymin,
    16 + l_quantity AS w, 16 + l_quantity * 2 AS h,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_tax, l_quantity, l_returnflag) AS rn
  FROM lineitem) t""",
    "fx_requests": """SELECT c_custkey AS query_id, CASE c_nationkey % 3 WHEN 0 THEN 'ortho' WHEN 1 THEN 'satellite' ELSE 'sentinel' END AS source_type,
  CASE c_custkey % 5 WHEN 0 THEN 'tree' WHEN 1 THEN 'zeroshot' WHEN 2 THEN 'tree_satlas' WHEN 3 THEN 'water_prithvi' ELSE 'yolo' END AS model_type,
  6 + CAST(c_custkey % 600 AS DOUBLE) / 100 AS min_lon, 47 + CAST(c_custkey % 800 AS DOUBLE) / 100 AS min_lat,
  6 + CAST(c_custkey % 600 AS DOUBLE) / 100 + CAST(c_custkey % 97 - 3 AS DOUBLE) / 1000 AS max_lon,
  47 + CAST(c_custkey % 800 AS DOUBLE) / 100 + CAST(c_custkey % 89 - 3 AS DOUBLE) / 1000 AS max_lat
FROM customer""",
    "fx_transitions": """SELECT event_id, user_id AS query_id, ts,
  CASE event_type WHEN 'view' THEN 'queued' WHEN 'signup' THEN 'preparing' WHEN 'click' THEN 'inferencing' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status,
  CAST(floor(value) AS INT) AS progress FROM events""",
    "fx_features": """SELECT o_orderkey AS feature_id, o_custkey % 100 AS query_id, o_orderkey AS ord,
  CASE o_orderstatus WHEN 'F' THEN 'Polygon' WHEN 'O' THEN 'MultiPolygon' ELSE 'LineString' END AS geom_type,
  CASE WHEN o_orderkey % 7 = 0 THEN '  ' ELSE o_orderpriority END AS p_class,
  CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 2 = 0 THEN o_orderstatus ELSE CAST(NULL AS STRING) END AS p_label,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 101 AS STRING) ELSE CAST(NULL AS STRING) END AS p_score_pct,
  CASE WHEN o_orderkey % 4 = 0 THEN CAST(NULL AS DOUBLE) ELSE o_totalprice / 100 END AS p_area_m2,
  7.6 + CAST(o_orderkey % 1000 AS DOUBLE) / 10000 AS min_lon, 51.9 + CAST(o_custkey % 1000 AS DOUBLE) / 10000 AS min_lat,
  7.6 + CAST(o_orderkey % 1000 AS DOUBLE) / 10000 + 0.0003 AS max_lon, 51.9 + CAST(o_custkey % 1000 AS DOUBLE) / 10000 + 0.0002 AS max_lat
FROM orders""",
    "fx_pixels": """SELECT vec_id AS block_id, label AS cls, pos DIV 8 AS r, pos % 8 AS c, CAST(v AS DOUBLE) AS x, CAST(floor((CAST(v AS DOUBLE) + 1) * 2000) AS INT) AS dn FROM (SELECT vec_id, label, posexplode(embedding) AS (pos, v) FROM embeddings) t""",
    "fx_blocks": """SELECT vec_id AS block_id, label AS cls, transform(embedding, v -> CAST(v AS DOUBLE)) AS x, transform(embedding, v -> CAST(floor((CAST(v AS DOUBLE) + 1) * 2000) AS INT)) AS dn FROM embeddings""",
}

DUCK_PIXELS = """SELECT vec_id AS block_id, label AS cls, (pos - 1) // 8 AS r, (pos - 1) % 8 AS c, CAST(v AS DOUBLE) AS x, CAST(floor((CAST(v AS DOUBLE) + 1) * 2000) AS INT) AS dn FROM (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) t"""

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture view as a DataFrame, without leaving a temporary view behind."""
    text = VIEWS[name]
    source = re.search(r"FROM (\w+)\)? ?t?$", text).group(1)
    return spark.sql(re.sub(rf"FROM {source}\b", "FROM {source}", text), source=table(spark, sf_dir, source))


def duck(name: str) -> str:
    """The DuckDB text of a view."""
    if name == "fx_pixels":
        return DUCK_PIXELS
    return VIEWS[name].replace("STRING", "VARCHAR").replace(" DIV ", " // ")


def with_views(sql: str) -> str:
    """Put the fixture views that a query names in front of it as common tables."""
    used = [name for name in VIEWS if name != "fx_blocks" and re.search(rf"\b{name}\b", sql)]
    if not used:
        return sql
    heads = ", ".join(f"{name} AS ({duck(name)})" for name in used)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {heads}, {body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {heads}, {body[4:]}"
    return f"WITH {heads} {body}"
