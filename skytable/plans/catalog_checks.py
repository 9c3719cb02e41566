"""Queries: scans and sinks of the catalogue, metadata joins, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytable.functions import geometry as geo
from skytable.functions import rules
from skytable.functions.text import number, strip
from skytable.operators import catalog as cat
from skytable.operators.skew import first_by, numbered
from skytable.plans.registry import query
from skytable.plans.request_checks import NAME_SQL, scene_names
from skytable.session import scratch
from skytable.sources import files


def links_text(q):
    """Links with the text columns of the links file."""
    links = q.links
    day = F.date_format("start_date", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lon, lat = F.col("tie2") % 40 * 0.5, 40 + F.col("tie3") % 20
    corner = lambda dx, dy: F.concat((lon + dx).cast("string"), F.lit(" "), (lat + dy).cast("string"))
    ring = F.concat_ws(", ", corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))
    return links.select(
        F.col("tile_id").alias("tileId"), day.alias("startDate"), "status",
        F.when(F.col("link_seq") % 17 == 0, F.lit(" n/a")).otherwise(F.col("cloud_fraction").cast("string")).alias("cloudCover"),
        F.lit("99.5").alias("area_covered"), F.lit("").alias("black_area"),
        F.when(F.col("link_seq") % 3 == 0, F.lit(" 05.10 ")).otherwise(F.lit(" ")).alias("processingBaseline"),
        F.concat(F.lit("S2A_"), "link_seq").alias("title"),
        F.concat(F.lit("POLYGON (("), ring, F.lit("))")).alias("polygon"),
    )


@query(
    "src1_scan_files",
    """SELECT tile, CAST(sum(length(concat('{"scene_id":', scene_id, ',"cloud":', cloud, '}')) + 1) AS BIGINT) AS size FROM fx_scenes GROUP BY tile""",
)
def src1(q):
    """Inventory of the scene files written per tile folder."""
    path = scratch(q.spark, "inventory")
    q.scenes.select("tile", F.to_json(F.struct("scene_id", "cloud")).alias("value")).repartition("tile").write.partitionBy(
        "tile"
    ).text(path)
    return files.scan_files(q.spark, path, "*.txt").select(F.regexp_replace("tile", "^tile=", "").alias("tile"), "size").groupBy("tile").agg(F.sum("size").alias("size"))


@query(
    "src2_read_links",
    "SELECT tile_id AS tile, count(*) AS links, count(*) FILTER (WHERE status = ' Downloaded ') AS downloaded, round(sum(CASE WHEN link_seq % 17 <> 0 THEN cloud_fraction END), 4) AS cloud_sum FROM fx_links GROUP BY tile_id",
)
def src2(q):
    path = scratch(q.spark, "links")
    links_text(q).write.csv(path, header=True)
    back = files.read_links(q.spark, path)
    return back.groupBy(F.col("tileId").alias("tile")).agg(
        F.count(F.lit(1)).alias("links"),
        F.count_if(strip(F.col("status")) == "Downloaded").alias("downloaded"),
        F.round(F.sum(number(F.col("cloudCover"))), 4).alias("cloud_sum"),
    )


BANDS_SQL = ", ".join(f"('{b[0]}', {b[1]}::DOUBLE, '{b[2]}', {b[3]}::DOUBLE)" for b in cat.BANDS)


@query(
    "src4_read_collections",
    f"SELECT id, asset, gsd, asset AS name, common_name, center_wavelength FROM (SELECT DISTINCT concat('scenes-', year(sensed)) AS id FROM fx_scenes) s, (VALUES {BANDS_SQL}) b(asset, gsd, common_name, center_wavelength)",
)
def src4(q):
    """Collection documents written from the summary and read back, one row per band."""
    path = scratch(q.spark, "collections")
    band = lambda b: F.struct(F.lit(b[0]).alias("name"), F.lit(b[2]).alias("common_name"), F.lit(b[3]).alias("center_wavelength"))
    assets = F.create_map(*[
        v for b in cat.BANDS
        for v in (F.lit(b[0]), F.struct(F.lit("image/jp2").alias("type"), F.lit(float(b[1])).alias("gsd"), F.array(band(b)).alias("eo:bands")))
    ])
    with_collection(q).groupBy("collection").agg(
        F.array(F.array(F.min("min_lon"), F.min("min_lat"), F.max("max_lon"), F.max("max_lat"))).alias("bbox")
    ).select(
        F.col("collection").alias("id"),
        F.struct(F.struct("bbox").alias("spatial")).alias("extent"),
        assets.alias("item_assets"),
    ).write.option("maxRecordsPerFile", 1).json(path)
    return files.collection_bands(files.read_collections(q.spark, path))


@query(
    "src5_items_round_trip",
    f"SELECT name AS id, concat('scenes-', year(sensed)) AS collection, CASE WHEN scene_id % 9 <> 0 THEN cloud END AS cloud, min_lon AS west FROM (SELECT *, {NAME_SQL} AS name FROM fx_scenes) t WHERE scene_id % 13 <> 0",
)
def src5(q):
    path = scratch(q.spark, "items")
    built = cat.build_items(described_scenes(q))
    files.write_items(built.withColumn("properties", F.from_json("properties", "map<string,string>")), path)
    back = files.read_items(q.spark, path)
    return back.select("id", "collection", F.col("properties")["eo:cloud_cover"].cast("double").alias("cloud"), F.col("bbox")[0].alias("west"))


@query(
    "src9_tile_list",
    "SELECT DISTINCT tile FROM fx_scenes",
)
def src9(q):
    path = scratch(q.spark, "tiles")
    files.write_tile_list(q.scenes.select("tile").unionByName(q.spark.sql("SELECT '  ' AS tile")), path)
    return files.read_tile_list(q.spark, path)


UPSERT_SQL = """SELECT tile, day, sensed_id FROM (SELECT tile, strftime(sensed, '%Y-%m-%d') AS day, scene_id AS sensed_id,
 row_number() OVER (PARTITION BY tile, strftime(sensed, '%Y-%m-%d') ORDER BY scene_id DESC) AS rn FROM fx_scenes) t WHERE rn = 1"""


@query("src11_upsert", UPSERT_SQL)
def src11(q):
    """Two overlapping loads of one catalogue; the later row of a key replaces the earlier."""
    keyed = q.scenes.select("tile", F.date_format("sensed", "yyyy-MM-dd").alias("day"), F.col("scene_id").alias("sensed_id"))
    even, later = keyed.filter("sensed_id % 2 = 0"), keyed
    return cat.upsert(even, later, ["tile", "day"], ["sensed_id"])


@query(
    "src11_not_loaded",
    "SELECT DISTINCT year(sensed) AS year FROM fx_scenes WHERE year(sensed) NOT IN (SELECT year(sensed) FROM fx_scenes WHERE cloud > 99.97)",
)
def src11_log(q):
    years = q.scenes.select(F.year("sensed").cast("bigint").alias("year"), "cloud")
    return cat.not_loaded(years.select("year").distinct(), years.filter("cloud > 99.97"))


@query(
    "src12_head_sorted",
    f"SELECT name FROM (SELECT {NAME_SQL} AS name FROM fx_scenes) t ORDER BY name LIMIT 25",
)
def src12(q):
    return cat.head_sorted(scene_names(q.scenes).select("name"), "name", 25)


CLEAN_SQL = """SELECT tile_id AS tile, strftime(start_date, '%Y-%m-%d') AS day, lower(trim(status)) AS status, CASE WHEN link_seq % 17 <> 0 THEN round(cloud_fraction * 100, 4) END AS cloud,
 CASE WHEN link_seq % 3 = 0 THEN '05.10' END AS baseline, concat('S2A_', link_seq) AS title, link_seq, tie1, tie2, tie3 FROM fx_links"""


@query(
    "fil24_clean_links",
    f"SELECT tile, day, status, cloud, baseline, title FROM ({CLEAN_SQL}) t",
)
def fil24(q):
    return cat.clean_links(links_text(q)).select("tile", "day", "status", "cloud", "baseline", "title")


@query(
    "fil25_asset_checks",
    """SELECT scene_id, CASE WHEN size < 100000 THEN 'too small' WHEN scene_id % 5 = 0 THEN 'no validity mask' END AS reason, (max_lon - min_lon) * (1 + scene_id % 200) > 180 AS wide
FROM (SELECT *, scene_id * 7919 % 3000000 AS size FROM fx_scenes) t""",
)
def fil25(q):
    k = F.col("scene_id")
    df = q.scenes.select(
        "scene_id", (k * 7919 % 3_000_000).alias("size"), (k % 5 != 0).alias("has_mask"), F.lit(0.0).alias("min_lon"),
        ((F.col("max_lon") - F.col("min_lon")) * (1 + k % 200)).alias("max_lon"),
    )
    return cat.asset_checks(df).select("scene_id", "reason", "wide")


def with_collection(q):
    return q.scenes.withColumn("collection", F.concat(F.lit("scenes-"), F.year("sensed").cast("string"))).withColumn(
        "platform", rules.platform(F.col("title"))
    )


def described_scenes(q):
    """Scenes with names, collection and item columns; malformed names are left out."""
    named = scene_names(with_collection(q)).withColumn("p", rules.scene_name(F.col("name"))).filter("p IS NOT NULL")
    cloud = F.when(F.col("scene_id") % 9 != 0, F.col("cloud"))
    return named.select(
        "name", "collection", "tile", "p.datetime", "p.orbit", "title", "valid_fraction", cloud.alias("cloud"), *"min_lon min_lat max_lon max_lat".split()
    )


@query(
    "fil26_build_items",
    f"""SELECT name AS id, CASE WHEN scene_id % 9 <> 0 THEN cloud END AS cloud, CASE substr(title, 1, 3) WHEN 'S2A' THEN 'sentinel-2a' WHEN 'S2B' THEN 'sentinel-2b' END AS platform,
 7 + CAST(scene_id % 9 <> 0 AS INT) + 2 * CAST(title IS NOT NULL AS INT) AS n_properties FROM (SELECT *, {NAME_SQL} AS name FROM fx_scenes) t WHERE scene_id % 13 <> 0""",
)
def fil26(q):
    items = cat.build_items(described_scenes(q))
    return items.select(
        "id",
        F.get_json_object("properties", "$['eo:cloud_cover']").cast("double").alias("cloud"),
        F.get_json_object("properties", "$.platform").alias("platform"),
        F.json_object_keys("properties").alias("k"),
    ).select("id", "cloud", "platform", F.size("k").alias("n_properties"))


@query(
    "joi1_attach_links",
    f"""WITH l AS ({CLEAN_SQL}), b AS (SELECT *, row_number() OVER (PARTITION BY tile, day ORDER BY link_seq, tie1, tie2, tie3) AS rn FROM l WHERE status = 'downloaded')
SELECT s.scene_id, b.cloud AS link_cloud, b.title AS link_title, b.baseline FROM (SELECT *, strftime(sensed, '%Y-%m-%d') AS day FROM fx_scenes) s LEFT JOIN b ON s.tile = b.tile AND s.day = b.day AND b.rn = 1""",
)
def joi1(q):
    typed = q.links.select(
        F.col("tile_id").alias("tile"), F.date_format("start_date", "yyyy-MM-dd").alias("day"),
        F.lower(strip(F.col("status"))).alias("status"),
        F.when(F.col("link_seq") % 17 != 0, rules.cloud_percent(F.col("cloud_fraction").cast("string"))).alias("link_cloud"),
        F.concat(F.lit("S2A_"), "link_seq").alias("link_title"),
        F.when(F.col("link_seq") % 3 == 0, F.lit("05.10")).alias("baseline"),
        "link_seq", "tie1", "tie2", "tie3",
    )
    scenes = q.scenes.select("scene_id", "tile", F.date_format("sensed", "yyyy-MM-dd").alias("day"))
    return cat.attach_links(scenes, typed, ["link_seq", "tie1", "tie2", "tie3"]).select(
        "scene_id", "link_cloud", "link_title", "baseline"
    )


@query(
    "joi2_pair_granules",
    f"""SELECT tile, name, scene_id % 3 <> 0 AS paired FROM (SELECT *, {NAME_SQL} AS name FROM fx_scenes) t""",
)
def joi2(q):
    granules = scene_names(q.scenes).select("tile", "name", "scene_id")
    paired, alone = cat.pair_granules(granules.drop("scene_id"), granules.filter("scene_id % 3 <> 0").drop("scene_id"))
    return paired.withColumn("paired", F.lit(True)).unionByName(alone.withColumn("paired", F.lit(False)))


def band_files(q):
    """Twelve band files per scene; some are missing, some are too small."""
    bands = F.array(*[F.struct(F.lit(b[0]).alias("band"), F.lit(i).alias("no")) for i, b in enumerate(cat.BANDS)])
    df = q.scenes.select(F.col("scene_id").alias("granule"), F.explode(bands).alias("b"))
    size = (F.col("granule") * 7919 + F.col("b.no") * 104729) % 3_000_000
    return df.select("granule", "b.band", size.alias("size")).filter("size % 50 <> 0")


BAND_NAMES = ", ".join(f"('{b[0]}', {i})" for i, b in enumerate(cat.BANDS))


@query(
    "joi3_complete_granules",
    f"""WITH f AS (SELECT scene_id, band, no, (scene_id * 7919 + no * 104729) % 3000000 AS size FROM fx_scenes, (VALUES {BAND_NAMES}) b(band, no)),
r AS (SELECT scene_id, min(CASE WHEN size % 50 = 0 OR size < 100000 THEN no END) AS bad FROM f GROUP BY scene_id)
SELECT r.scene_id AS granule, CASE WHEN bad IS NOT NULL THEN concat(CASE WHEN size % 50 = 0 THEN 'missing ' ELSE 'truncated ' END, band) END AS reason FROM r LEFT JOIN f ON r.scene_id = f.scene_id AND r.bad = f.no""",
)
def joi3(q):
    return cat.complete_granules(band_files(q), q.scenes.select(F.col("scene_id").alias("granule")))


@query(
    "joi4_plan_conversion",
    "SELECT n AS to_convert, m AS skipped, (n * 45 // 5) // 60 AS minutes, (n * 261) // 1024 AS gigabytes FROM (SELECT count(*) FILTER (WHERE scene_id % 4 <> 0) AS n, count(*) FILTER (WHERE scene_id % 4 = 0) AS m FROM fx_scenes) t",
)
def joi4(q):
    return cat.plan_conversion(q.scenes, q.scenes.filter("scene_id % 4 = 0"))


@query(
    "joi5_semi_tiles",
    "SELECT scene_id, tile FROM fx_scenes WHERE tile IN (SELECT tile_id FROM fx_links WHERE cloud_fraction = 0.1 AND tie1 = 7)",
)
def joi5(q):
    tiles = q.links.filter("cloud_fraction = 0.1 AND tie1 = 7").select(F.col("tile_id").alias("tile"))
    return cat.in_tiles(q.scenes, tiles).select("scene_id", "tile")


@query(
    "joi7_tiles_in_box",
    """SELECT DISTINCT tile_id AS tile FROM fx_links WHERE tie2 % 40 * 0.5 <= 16.0 AND tie2 % 40 * 0.5 + 1 >= 5.0 AND 40 + tie3 % 20 <= 55.5 AND 41 + tie3 % 20 >= 46.5""",
)
def joi7(q):
    links = cat.clean_links(links_text(q))
    return cat.tiles_in_box(links, (5.0, 46.5, 16.0, 55.5))


@query(
    "agg1_collection_summary",
    """SELECT concat('scenes-', year(sensed)) AS collection, min(min_lon) AS west, min(min_lat) AS south, max(max_lon) AS east, max(max_lat) AS north,
 strftime(min(sensed), '%Y-%m-%d') AS first_day, strftime(max(sensed), '%Y-%m-%d') AS last_day, round(min(cloud), 4) AS cloud_min, round(max(cloud), 4) AS cloud_max,
 round(min(valid_fraction), 5) AS valid_min, round(max(valid_fraction), 5) AS valid_max, 'sentinel-2a,sentinel-2b' AS platforms FROM fx_scenes GROUP BY year(sensed)""",
)
def agg1(q):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return cat.collection_summary(with_collection(q)).withColumn("first_day", day("first_sensed")).withColumn(
        "last_day", day("last_sensed")
    ).withColumn("platforms", F.array_join("platforms", ",")).drop("first_sensed", "last_sensed")


@query(
    "agg2_build_counters",
    """SELECT concat('scenes-', year(sensed)) AS collection, count(*) FILTER (WHERE b) AS items, count(*) FILTER (WHERE NOT b) AS skipped, count(*) FILTER (WHERE b AND scene_id % 9 = 0) AS without_cloud,
 count(*) FILTER (WHERE b AND valid_fraction < 0.85) AS partial, count(*) FILTER (WHERE scene_id % 7 = 0) AS without_partner FROM (SELECT *, scene_id % 13 <> 0 AS b FROM fx_scenes) t GROUP BY year(sensed)""",
)
def agg2(q):
    k = F.col("scene_id")
    df = with_collection(q).withColumn("built", k % 13 != 0).withColumn("has_partner", k % 7 != 0)
    return cat.build_counters(df.withColumn("cloud", F.when(k % 9 != 0, F.col("cloud"))))


@query(
    "agg3_upper_median",
    """SELECT y AS year, v AS median, least FROM (SELECT year(sensed) AS y, cloud AS v, row_number() OVER (PARTITION BY year(sensed) ORDER BY cloud) AS rn, count(*) OVER (PARTITION BY year(sensed)) AS n, min(cloud) OVER (PARTITION BY year(sensed)) AS least FROM fx_scenes) t WHERE rn = n // 2 + 1""",
)
def agg3(q):
    return cat.upper_median(q.scenes.withColumn("year", F.year("sensed").cast("bigint")), ["year"], "cloud")


@query(
    "agg4_collection_counts",
    "SELECT concat('scenes-', year(sensed)) AS collection, count(*) AS items, strftime(min(sensed), '%Y-%m-%d') AS first_day, strftime(max(sensed), '%Y-%m-%d') AS last_day FROM fx_scenes GROUP BY year(sensed)",
)
def agg4(q):
    return cat.collection_counts(with_collection(q))


@query(
    "agg20_gsd_set",
    "SELECT year(sensed) AS year, '10,20,60' AS gsds FROM fx_scenes GROUP BY year(sensed)",
)
def agg20(q):
    bands = F.array(*[F.lit(b[1]) for b in cat.BANDS])
    per = q.scenes.select(F.year("sensed").cast("bigint").alias("year"), F.explode(bands).alias("gsd"))
    return cat.gsd_set(per, ["year"]).select("year", F.array_join("gsds", ",").alias("gsds"))


@query(
    "win5_order_by_property",
    "SELECT event_id, value AS v, row_number() OVER (ORDER BY value NULLS LAST, event_id) AS place FROM events",
)
def win5(q):
    """Documents ordered by a number inside them, not by its text."""
    docs = q.table("events").select(
        F.col("event_id").alias("id"), F.to_json(F.struct(F.col("value").cast("string").alias("v"))).alias("doc")
    )
    prop = F.get_json_object("doc", "$.v")
    ordered = cat.order_by_property(docs, prop).select(F.col("id").alias("event_id"), prop.cast("double").alias("v"))
    return numbered(ordered, [], ["v", "event_id"], "place")


@query(
    "win10_first_per_key",
    "SELECT tile_id, link_seq, tie1, tie2, tie3 FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY link_seq, tie1, tie2, tie3) AS rn FROM fx_links) t WHERE rn = 1",
)
def win10(q):
    cols = ["link_seq", "tie1", "tie2", "tie3"]
    return first_by(q.links.select("tile_id", *cols), ["tile_id"], [F.col(c) for c in cols])


@query(
    "set3_diff_ids",
    "SELECT DISTINCT tile FROM fx_scenes WHERE tile NOT IN (SELECT tile_id FROM fx_links WHERE link_seq % 997 = 0)",
)
def set3(q):
    done = q.links.filter("link_seq % 997 = 0").select(F.col("tile_id").alias("tile"))
    return cat.diff_ids(q.scenes, done, "tile")


@query(
    "fil26_whole_items",
    f"""WITH t AS (SELECT *, {NAME_SQL} AS name, round(min_lon * 1000) AS x0, round(min_lat * 1000) AS y0, round(max_lon * 1000) AS x1, round(max_lat * 1000) AS y1 FROM fx_scenes)
SELECT name AS id, 'Feature' AS type, 'Polygon' AS geometry_type, 5::BIGINT AS corners, x0 + 100 AS first_x, y0 AS first_y, x1 - x0 AS wide, y1 - y0 AS tall, 100000 + CAST(x0 AS BIGINT) AS size, 'scenes/' || name || '.tif' AS href,
 3::BIGINT AS bands, 3857 AS epsg, 50 AS height, 75 AS width, 2.0::DOUBLE AS pixel, 0::BIGINT AS links, CASE substr(title, 1, 3) WHEN 'S2A' THEN 'sentinel-2a' WHEN 'S2B' THEN 'sentinel-2b' END AS platform FROM t WHERE scene_id % 13 <> 0""",
)
def fil26_whole(q):
    """Whole item documents, read back: footprint, box, asset, raster description and properties."""
    x0, y0, x1, y1 = [F.round(F.col(c) * 1000) for c in ("min_lon", "min_lat", "max_lon", "max_lat")]
    ring = F.array(geo.point(x0 + 100, y0), geo.point(x1, y0 + 200), geo.point(x1 - 100, y1), geo.point(x0, y1 - 200), geo.point(x0 + 100, y0))
    scenes = described_scenes(q).withColumns({
        "geom": F.array(F.array(ring)), "href": F.concat(F.lit("scenes/"), F.col("name"), F.lit(".tif")), "size": 100000 + x0.cast("long"), "epsg": F.lit(3857),
        "height": F.lit(50), "width": F.lit(75), "left": F.lit(0.0), "bottom": F.lit(0.0), "right": F.lit(150.0), "top": F.lit(100.0),
    })
    get = lambda path: F.get_json_object("item", f"$.{path}")
    size = lambda path: F.json_array_length(get(path)).cast("long")
    number = lambda path: get(path).cast("double")
    return cat.whole_items(scenes).select(
        get("id").alias("id"), get("type").alias("type"), get("geometry.type").alias("geometry_type"), size("geometry.coordinates[0]").alias("corners"),
        number("geometry.coordinates[0][0][0]").alias("first_x"), number("geometry.coordinates[0][0][1]").alias("first_y"),
        (number("bbox[2]") - number("bbox[0]")).alias("wide"), (number("bbox[3]") - number("bbox[1]")).alias("tall"),
        get("assets.visual['file:size']").cast("long").alias("size"), get("assets.visual.href").alias("href"), size("assets.visual['eo:bands']").alias("bands"),
        get("properties['proj:epsg']").cast("int").alias("epsg"), get("properties['proj:shape'][0]").cast("int").alias("height"), get("properties['proj:shape'][1]").cast("int").alias("width"),
        number("properties['proj:transform'][0]").alias("pixel"), size("links").alias("links"), get("properties.platform").alias("platform"),
    )
