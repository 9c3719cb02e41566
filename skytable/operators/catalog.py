"""Scene catalogue: metadata joins, completeness, items, summaries, idempotent loads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytable.functions import geometry as geo
from skytable.functions import rules
from skytable.functions.text import non_blank, number, strip
from skytable.operators.features import proj_props
from skytable.operators.skew import first_by, prefix_scan, salted_join, spread

MIN_ASSET_BYTES = 100_000
PARTIAL_BELOW = 0.85

# The bands a granule must hold, with resolution in meters, common name and wavelength.
BANDS = (
    ("B01", 60, "coastal", 0.443),
    ("B02", 10, "blue", 0.490),
    ("B03", 10, "green", 0.560),
    ("B04", 10, "red", 0.665),
    ("B05", 20, "rededge", 0.705),
    ("B06", 20, "rededge", 0.740),
    ("B07", 20, "rededge", 0.783),
    ("B08", 10, "nir", 0.842),
    ("B8A", 20, "nir08", 0.865),
    ("B09", 60, "nir09", 0.945),
    ("B11", 20, "swir16", 1.610),
    ("B12", 20, "swir22", 2.190),
)

# Disk size in MB of one converted scene by compression.
SCENE_MB = {"ZSTD": 261, "DEFLATE": 275, "LZW": 306, "WEBP": 150, "JPEG": 40}


def clean_links(links: DataFrame) -> DataFrame:
    """Typed link columns: numbers or null, blank text as null, cloud as percent."""
    return links.select(
        strip(F.col("tileId")).alias("tile"),
        F.substring(strip(F.col("startDate")), 1, 10).alias("day"),
        F.lower(strip(F.col("status"))).alias("status"),
        rules.cloud_percent(F.col("cloudCover")).alias("cloud"),
        number(F.col("area_covered")).alias("area_covered"),
        number(F.col("black_area")).alias("black_area"),
        non_blank(F.col("processingBaseline")).alias("baseline"),
        non_blank(F.col("title")).alias("title"),
        non_blank(F.col("startDate")).alias("datatake"),
        non_blank(F.col("polygon")).alias("polygon"),
        *[c for c in links.columns if c == "ord"],
    )


def attach_links(scenes: DataFrame, links: DataFrame, order: Sequence[str]) -> DataFrame:
    """Left join of scenes and the first downloaded link of their tile and day.

    Only keys that some scene wants are reduced, with a hash aggregate per key, so
    a key with very many links is combined before the shuffle.
    """
    keys = ["tile", "day"]
    wanted = scenes.select(*keys).distinct()
    usable = links.filter("status = 'downloaded'").join(wanted, keys, "left_semi")
    best = first_by(usable, keys, [F.col(c) for c in order])
    return salted_join(scenes, best, keys, [c for c in scenes.columns if c not in keys], "left")


def pair_granules(granules: DataFrame, rasters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Granules with their converted raster, and granules without one: each granule once.

    Of several rasters of one tile and name the first by its other columns counts.
    """
    keys = ["tile", "name"]
    rest = [F.col(c) for c in rasters.columns if c not in keys]
    single = first_by(rasters, keys, rest) if rest else rasters.distinct()
    return granules.join(single, keys), granules.join(rasters.select(*keys), keys, "left_anti")


def complete_granules(files: DataFrame, granules: DataFrame, min_bytes: int = MIN_ASSET_BYTES) -> DataFrame:
    """Granules with the reason of refusal: a missing band or one that is too small; null when whole."""
    bands = [b for b, *_ in BANDS]
    per = (
        files.filter(F.col("band").isin(*bands))
        .groupBy("granule")
        .agg(
            F.collect_set("band").alias("_have"),
            F.collect_set(F.when(F.col("size") < min_bytes, F.col("band"))).alias("_small"),
        )
    )
    all_bands = F.array(*[F.lit(b) for b in bands])
    broken = lambda b: ~F.array_contains("_have", b) | F.array_contains("_small", b)
    empty = F.array().cast("array<string>")
    joined = granules.join(per, "granule", "left").withColumn("_have", F.coalesce("_have", empty)).withColumn(
        "_small", F.coalesce("_small", empty)
    )
    first = F.get(F.filter(all_bands, broken), F.lit(0))
    reason = F.when(
        first.isNotNull(),
        F.concat(F.when(F.array_contains("_have", first), F.lit("truncated ")).otherwise(F.lit("missing ")), first),
    )
    return joined.withColumn("reason", reason).drop("_have", "_small")


def plan_conversion(scenes: DataFrame, done: DataFrame, parallel: int = 5, compress: str = "ZSTD") -> DataFrame:
    """Scenes still to convert and done ones, with minutes and gigabytes by integer division."""
    flagged = scenes.join(done.select("scene_id").distinct().withColumn("_done", F.lit(True)), "scene_id", "left")
    counts = flagged.agg(
        F.count_if(F.col("_done").isNull()).alias("to_convert"), F.count_if(F.col("_done").isNotNull()).alias("skipped")
    )
    whole = lambda c: F.floor(c).cast("bigint")
    return counts.withColumn("minutes", whole(whole(F.col("to_convert") * 45 / parallel) / 60)).withColumn(
        "gigabytes", whole(F.col("to_convert") * SCENE_MB[compress] / 1024)
    )


def in_tiles(scenes: DataFrame, tiles: DataFrame) -> DataFrame:
    """Scenes whose tile is listed; Spark broadcasts the list when its size allows it."""
    return scenes.join(tiles.select("tile"), "tile", "left_semi")


def tiles_in_box(links: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Distinct tiles whose WKT polygon meets a box, in order."""
    geom = geo.parse_wkt_polygon(F.col("polygon"))
    meets = geo.let(geom, lambda g: geo.polygon_meets_box(g, *[F.lit(float(v)) for v in box]))
    # Many links repeat one tile outline: test each outline once.
    outlines = links.filter("tile IS NOT NULL").select("tile", "polygon").distinct()
    return outlines.filter(meets).select("tile").distinct().orderBy("tile")


def asset_checks(df: DataFrame) -> DataFrame:
    """Add the reason to refuse an asset, and a flag for a box wider than half the globe."""
    reason = F.when(F.col("size") < MIN_ASSET_BYTES, F.lit("too small")).when(
        ~F.col("has_mask"), F.lit("no validity mask")
    )
    return df.withColumn("reason", reason).withColumn("wide", F.col("max_lon") - F.col("min_lon") > 180)


# Extensions of an item, and how the true-colour raster is described.
ITEM_EXTENSIONS = tuple(f"https://stac-extensions.github.io/{name}/schema.json" for name in ("eo/v1.1.0", "projection/v1.1.0", "raster/v1.1.0", "sat/v1.0.0", "file/v2.1.0"))
RASTER_MEDIA_TYPE = "image/tiff; application=geotiff; profile=cloud-optimized"
RASTER_TITLE = "True-colour RGB (8-bit COG, EPSG:3857, internal mask)"
RASTER_ROLES = ("visual", "data", "overview")
RGB = ("B04", "B03", "B02")


def _properties(df: DataFrame) -> list[Column]:
    """Properties of a scene; their names are fixed values."""
    return [
        F.col("datetime"),
        F.lit("sentinel-2").alias("constellation"),
        F.col("tile").alias("s2:mgrs_tile"),
        F.col("orbit").alias("sat:absolute_orbit"),
        F.lit(10).alias("gsd"),
        F.lit("L2A").alias("s2:processing_level"),
        F.round("valid_fraction", 5).alias("s2:valid_fraction"),
        F.col("cloud").alias("eo:cloud_cover"),
        F.col("title").alias("s2:product_uri"),
        rules.platform(F.col("title")).alias("platform"),
        *[F.col(c).alias(n) for c, n in (
            ("area_covered", "s2:area_covered"), ("black_area", "s2:black_area"),
            ("baseline", "s2:processing_baseline"), ("datatake", "s2:datatake_start"),
        ) if c in df.columns],
    ]


def build_items(df: DataFrame) -> DataFrame:
    """Catalogue items; unknown properties are left out by the JSON writer."""
    return df.select(
        F.col("name").alias("id"), "collection",
        F.array("min_lon", "min_lat", "max_lon", "max_lat").alias("bbox"), F.to_json(F.struct(*_properties(df))).alias("properties"),
    )


def whole_items(df: DataFrame) -> DataFrame:
    """(id, collection, bbox, properties, geometry, assets, item) of scenes: ``item`` is the whole document as JSON text.

    Beside the columns of ``build_items``, scenes have ``geom`` (the footprint), href and size of the raster, epsg, height, width and the bounds left, bottom,
    right and top in its system. The box is that of the footprint. Unknown properties are left out. Scenes without a footprint are no items.
    """
    proj = proj_props(*[F.col(c) for c in ("epsg", "height", "width", "left", "bottom", "right", "top")])
    parts = spread(df.filter("geom IS NOT NULL"), "name").withColumn("_p", proj).withColumn("_b", geo.bounds(F.col("geom")))
    described = [F.col(f"_p.{c}").alias(f"proj:{c}") for c in ("epsg", "shape", "transform", "bbox")]
    bands = {name: (common, wavelength) for name, _, common, wavelength in BANDS}
    asset = F.struct(
        F.col("href"),
        F.lit(RASTER_MEDIA_TYPE).alias("type"),
        F.array(*[F.lit(r) for r in RASTER_ROLES]).alias("roles"),
        F.lit(RASTER_TITLE).alias("title"),
        F.lit(10).alias("gsd"),
        F.col("size").alias("file:size"),
        F.array(*[F.struct(F.lit(b).alias("name"), F.lit(bands[b][0]).alias("common_name"), F.lit(bands[b][1]).alias("center_wavelength")) for b in RGB]).alias("eo:bands"),
        F.array(*[F.struct(F.lit("uint8").alias("data_type"), F.lit(8).alias("bits_per_sample"), F.lit(bands[b][0]).alias("name")) for b in RGB]).alias("raster:bands"),
    )
    bbox = F.array(*[F.col(f"_b.{c}") for c in ("min_x", "min_y", "max_x", "max_y")])
    items = parts.select(
        F.col("name").alias("id"), "collection", bbox.alias("bbox"), F.to_json(F.struct(*_properties(df), *described)).alias("properties"),
        geo.geometry_json(F.col("geom")).alias("geometry"), F.to_json(F.struct(asset.alias("visual"))).alias("assets"),
    )
    # The parts are JSON already, so the document is put together from them.
    quoted = lambda c: F.substring(F.to_json(F.array(c)), 2, 2**30)
    text = lambda c: F.regexp_replace(quoted(c), r"\]$", "")
    head = F.lit('{"type":"Feature","stac_version":"1.1.0","stac_extensions":[' + ",".join(f'"{e}"' for e in ITEM_EXTENSIONS) + '],"id":')
    item = F.concat(
        head, text(F.col("id")), F.lit(',"geometry":'), F.col("geometry"), F.lit(',"bbox":'), F.to_json("bbox"), F.lit(',"properties":'), F.col("properties"),
        F.lit(',"links":[],"assets":'), F.col("assets"), F.lit(',"collection":'), text(F.col("collection")), F.lit("}"),
    )
    return items.withColumn("item", item)


def collection_summary(items: DataFrame) -> DataFrame:
    """Extent, time range, platforms and value ranges per collection; whole world without boxes."""
    return items.groupBy("collection").agg(
        F.coalesce(F.min("min_lon"), F.lit(-180.0)).alias("west"),
        F.coalesce(F.min("min_lat"), F.lit(-90.0)).alias("south"),
        F.coalesce(F.max("max_lon"), F.lit(180.0)).alias("east"),
        F.coalesce(F.max("max_lat"), F.lit(90.0)).alias("north"),
        F.min("sensed").alias("first_sensed"),
        F.max("sensed").alias("last_sensed"),
        F.array_sort(F.collect_set("platform")).alias("platforms"),
        F.round(F.min("cloud"), 4).alias("cloud_min"),
        F.round(F.max("cloud"), 4).alias("cloud_max"),
        F.round(F.min("valid_fraction"), 5).alias("valid_min"),
        F.round(F.max("valid_fraction"), 5).alias("valid_max"),
    )


def build_counters(df: DataFrame) -> DataFrame:
    """Counters of a catalogue build per collection; ``built`` and ``has_partner`` mark the rows."""
    built = F.col("built")
    return df.groupBy("collection").agg(
        F.count_if(built).alias("items"),
        F.count_if(~built).alias("skipped"),
        F.count_if(built & F.col("cloud").isNull()).alias("without_cloud"),
        F.count_if(built & (F.col("valid_fraction") < PARTIAL_BELOW)).alias("partial"),
        F.count_if(~F.col("has_partner")).alias("without_partner"),
    )


def upper_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Element at floor(n/2) of the sorted values, and the least one, for groups of any size.

    Equal values are counted first; the running count over the distinct values
    then tells which one covers the middle position.
    """
    if not keys:
        return upper_median(df.withColumn("_all", F.lit(0)), ["_all"], value).drop("_all")
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    running = prefix_scan(counts, keys, [value], {"_upto": ("sum", F.col("_n"))})
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"), F.min(value).alias("least"))
    joined = salted_join(running, totals, keys, [value])
    middle = F.floor(F.col("_total") / 2)
    return joined.filter((F.col("_upto") - F.col("_n") <= middle) & (middle < F.col("_upto"))).select(
        *keys, F.col(value).alias("median"), "least"
    )


def collection_counts(items: DataFrame) -> DataFrame:
    """Items per collection with first and last day, in order."""
    day = F.date_format("sensed", "yyyy-MM-dd")
    return items.groupBy("collection").agg(
        F.count(F.lit(1)).alias("items"), F.min(day).alias("first_day"), F.max(day).alias("last_day")
    ).orderBy("collection")


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest row per key of both tables, so that a rerun replaces instead of adding."""
    return first_by(target.unionByName(updates), keys, [-F.col(c) for c in order])


def not_loaded(years: DataFrame, load_log: DataFrame, key: str = "year") -> DataFrame:
    """Years whose done marker is not in the load log."""
    return years.join(load_log.select(key), key, "left_anti")


def head_sorted(df: DataFrame, order: str, n: int) -> DataFrame:
    """First n files in sorted order: a smoke run's limit."""
    return df.orderBy(order).limit(n)


def order_by_property(items: DataFrame, prop: Column, kind: str = "double") -> DataFrame:
    """Items by a typed property of a JSON document, unknown values last."""
    return items.orderBy(prop.try_cast(kind).asc_nulls_last(), "id")


def diff_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids of ``a`` that are not in ``b``."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def gsd_set(bands: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct resolutions in order."""
    return bands.groupBy(*keys).agg(F.array_sort(F.collect_set("gsd")).alias("gsds"))
