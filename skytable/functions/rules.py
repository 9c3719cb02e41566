"""Request, export and scene rules as Column expressions. A rule gives its message or null."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from skytable.functions.text import group_or_null, non_blank, number, strip

# Allowed models per imagery source, in message order.
MODELS_BY_SOURCE = {
    "ortho": ("tree", "tree_deepforest", "zeroshot", "yolo"),
    "satellite": ("tree_satlas",),
    "sentinel": ("tree_satlas_sentinel", "water_prithvi"),
}

# Model type, model name, result type.
MODEL_ATTRIBUTES = (
    ("tree", "tcd-segformer-mit-b2", "tree_detection"),
    ("tree_satlas", "satlas-tree-5m", "tree_detection"),
    ("tree_unet", "unet-resnet50-tree-5m", "tree_detection"),
    ("tree_satlas_sentinel", "satlas-tree-sentinel-ms-nir", "tree_detection"),
    ("tree_unet_sentinel", "unet-resnet50-tree-sentinel-10m", "tree_detection"),
    ("tree_deepforest", "deepforest-tree", "tree_detection"),
    ("zeroshot", "lang-sam", "zero_shot_detection"),
    ("yolo", "yolo26", "object_detection"),
    ("water_prithvi", "prithvi-eo-v2-300m-sen1floods11", "water_detection"),
)

# Model variants of the zero-shot model.
MODEL_VARIANTS = ("sam2.1_hiera_large", "sam2.1_hiera_tiny")
VARIANT_PREFIX = "lang-sam-"

# Failure kind, error code, response status.
FAILURES = (
    ("model_busy", "ml_service_busy", 429),
    ("model_timeout", "ml_service_timeout", 504),
    ("model_unavailable", "ml_service_unavailable", 503),
    ("model_bad_response", "ml_service_bad_response", 502),
    ("imagery_timeout", "titiler_timeout", 504),
    ("imagery_unavailable", "titiler_unavailable", 503),
    ("imagery_bad_response", "titiler_bad_response", 502),
)
OTHER_FAILURE = ("prediction_failed", 500)

# Media type by file suffix.
MEDIA_TYPES = {
    ".geojson": "application/geo+json",
    ".gpkg": "application/geopackage+sqlite3",
    ".fgb": "application/x-flatgeobuf",
    ".tif": "image/tiff",
    ".tiff": "image/tiff",
    ".json": "application/json",
    ".zip": "application/zip",
}
OTHER_MEDIA_TYPE = "application/octet-stream"

MAX_KEYWORDS = 20

# Search defaults.
SEARCH_FROM, SEARCH_TO, SEARCH_CLOUD = "2024-04-01", "2024-09-30", 30.0


def bbox_error(min_lat: Column, max_lat: Column, min_lon: Column, max_lon: Column) -> Column:
    """First broken rule of a lon/lat box, or null."""
    checks = [
        (max_lat <= min_lat, "max_lat must be greater than min_lat"),
        (max_lon <= min_lon, "max_lon must be greater than min_lon"),
    ]
    for column, name, limit in (
        (min_lat, "min_lat", 90),
        (max_lat, "max_lat", 90),
        (min_lon, "min_lon", 180),
        (max_lon, "max_lon", 180),
    ):
        checks.append((~column.between(-limit, limit), f"{name} must be between -{limit} and {limit}"))
    return F.coalesce(*[F.when(broken, F.lit(message)) for broken, message in checks])


def bbox_ordered(min_lat: Column, max_lat: Column, min_lon: Column, max_lon: Column) -> Column:
    """Strict corner order, the guard of a stored row."""
    return F.coalesce((min_lat < max_lat) & (min_lon < max_lon), F.lit(False))


def _text_map(values: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for pair in values.items() for v in pair])


def compatibility_error(
    source: Column, model: Column, models: Mapping[str, Sequence[str]] = MODELS_BY_SOURCE
) -> Column:
    """Message when the model does not serve the imagery source, or null."""
    listed = F.try_element_at(_text_map({k: ", ".join(v) for k, v in models.items()}), source)
    allowed = F.array_contains(F.split(listed, ", "), model)
    message = F.format_string(
        "Model '%s' is not compatible with source '%s'. Allowed models for '%s': %s",
        model, source, source, F.coalesce(listed, F.lit("")),
    )
    return F.when(~F.coalesce(allowed, F.lit(False)), message)


def distinct_in_order(values: Column) -> Column:
    """Distinct elements of an array, each at its first position."""
    return F.array_distinct(values)


def clean_terms(terms: Column) -> Column:
    """Stripped terms without blanks and repetitions."""
    return distinct_in_order(F.filter(F.transform(terms, strip), lambda t: t != ""))


def requested_keywords(keyword: Column, keywords: Column) -> Column:
    """The single keyword first, then the list; trimmed and distinct."""
    single = F.array_compact(F.array(non_blank(keyword)))
    return distinct_in_order(F.concat(single, clean_terms(F.coalesce(keywords, F.array().cast("array<string>")))))


def too_many_keywords(keywords: Column, before_dedupe: bool = True) -> Column:
    """The service counts the raw list, the browser the cleaned one."""
    return F.size(keywords if before_dedupe else clean_terms(keywords)) > MAX_KEYWORDS


def zeroshot_keywords(model: Column, keywords: Column) -> Column:
    """Keywords have no meaning for the fixed models: they are blanked."""
    return F.when(model == "zeroshot", keywords).otherwise(F.array().cast("array<string>"))


def zeroshot_error(model: Column, keywords: Column, strict: bool = False) -> Column:
    """Missing keywords; in strict mode also keywords given to a fixed model."""
    missing = F.when((model == "zeroshot") & (F.size(keywords) == 0), F.lit("keyword is required for zeroshot"))
    if not strict:
        return missing
    extra = F.when((model != "zeroshot") & (F.size(keywords) > 0), F.lit("keyword needs model zeroshot"))
    return F.coalesce(missing, extra)


def imagery_filter_error(source: Column, date_from: Column, date_to: Column, cloud: Column) -> Column:
    """Date and cloud options belong to the sentinel source; cloud is a percentage."""
    given = date_from.isNotNull() | date_to.isNotNull() | cloud.isNotNull()
    return F.coalesce(
        F.when(given & (source != "sentinel"), F.lit("date and cloud options require source sentinel")),
        F.when(~cloud.between(0, 100), F.lit("max cloud cover must be between 0 and 100")),
    )


def export_formats(formats: Column, geojson: Column) -> Column:
    """Distinct formats, with geojson put first or taken out."""
    distinct = distinct_in_order(formats)
    with_geojson = F.when(F.array_contains(distinct, "geojson"), distinct).otherwise(
        F.concat(F.array(F.lit("geojson")), distinct)
    )
    return F.when(geojson, with_geojson).otherwise(F.array_remove(distinct, "geojson"))


def export_error(formats: Column, others: Sequence[Column], min_area: Column, max_area: Column) -> Column:
    """Nothing selected, or an area range that is upside down."""
    any_other = others[0]
    for flag in others[1:]:
        any_other = any_other | flag
    return F.coalesce(
        F.when(min_area > max_area, F.lit("min_area_m2 must not exceed max_area_m2")),
        F.when((F.size(formats) == 0) & ~any_other, F.lit("At least one export artifact must be selected")),
    )


def hex_color(text: Column) -> Column:
    """A colour as # and six lower-case hex digits, or null."""
    clean = F.lower(strip(text))
    return F.when(clean.rlike("^#[0-9a-f]{6}$"), clean)


def label_colors(colors: Column) -> Column:
    """Colours by trimmed label; blank labels are dropped."""
    named = F.map_filter(colors, lambda label, _: strip(label) != "")
    pairs = F.transform(
        F.map_entries(named), lambda e: F.struct(strip(e["key"]).alias("key"), hex_color(e["value"]).alias("value"))
    )
    # Labels that trim to the same text: the last one stays, as in a dictionary.
    last = F.filter(
        F.transform(pairs, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("i"))),
        lambda e: e["i"] == F.array_max(F.transform(pairs, lambda o, i: F.when(o["key"] == e["key"], i))),
    )
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def model_variant(explicit: Column, model_name: Column) -> Column:
    """The known variant that was stored, else the one hidden in the model name."""
    rest = F.when(
        model_name.startswith(VARIANT_PREFIX), F.regexp_extract(model_name, f"^{VARIANT_PREFIX}(.*)$", 1)
    )
    return F.coalesce(
        F.when(explicit.isin(*MODEL_VARIANTS), explicit),
        F.when(rest.isin(*MODEL_VARIANTS), rest),
    )


# Where a result summary holds its keyword and its number.
KEYWORD_AFTER_FOR = r"(?i)\bfor\s+(.+)$"
KEYWORD_BEFORE_UNIT = r"(?i)^Found\s+\d+\s+(.+?)\s+polygons/clusters"
LEADING_NUMBER = r"(?i)^Found\s+(\d+)\b"


def keyword_text(keywords: Column, summary: Column) -> Column:
    """Joined keywords, else the text that a summary names."""
    joined = F.when(F.size(keywords) > 0, F.array_join(keywords, ", "))
    return F.coalesce(joined, *[group_or_null(summary, pattern) for pattern in (KEYWORD_AFTER_FOR, KEYWORD_BEFORE_UNIT)])


def tree_count(model_name: Column, feature_count: Column, summary: Column) -> Column:
    """Number of trees; only the box model counts trees."""
    counted = group_or_null(summary, LEADING_NUMBER).try_cast("bigint")
    return F.when(model_name == "deepforest-tree", F.coalesce(feature_count.cast("bigint"), counted))


def failure_code(kind: Column) -> Column:
    """Error code of a failure kind."""
    codes = _text_map({name: code for name, code, _ in FAILURES})
    return F.coalesce(F.try_element_at(codes, kind), F.lit(OTHER_FAILURE[0]))


def failure_status(kind: Column) -> Column:
    """Response status of a failure kind."""
    pairs = [F.lit(v) for name, _, status in FAILURES for v in (name, status)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit(OTHER_FAILURE[1]))


def file_suffix(path: Column) -> Column:
    """Lower-case suffix of the last path part, with its dot."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def media_type(path: Column) -> Column:
    """Media type by suffix."""
    return F.coalesce(F.try_element_at(_text_map(MEDIA_TYPES), file_suffix(path)), F.lit(OTHER_MEDIA_TYPE))


def download_url(export_id: Column, name: Column) -> Column:
    return F.format_string("/api/segmentation/exports/%s/download/%s", export_id, name)


def search_window(date_from: Column, date_to: Column) -> tuple[Column, Column]:
    """Inclusive day bounds of a search, with defaults."""
    start = F.to_timestamp(F.concat(F.coalesce(date_from, F.lit(SEARCH_FROM)), F.lit(" 00:00:00")))
    end = F.to_timestamp(F.concat(F.coalesce(date_to, F.lit(SEARCH_TO)), F.lit(" 23:59:59")))
    return start, end


def search_cloud(cloud: Column) -> Column:
    return F.coalesce(cloud, F.lit(SEARCH_CLOUD))


def class_filter(selected: Column, all_classes: Column) -> Column:
    """No filter (null) when all classes or none are selected."""
    partial = (F.size(selected) > 0) & (F.size(selected) < F.size(all_classes))
    return F.when(partial, selected)


def platform(title: Column) -> Column:
    """Satellite from the first letters of a product title."""
    head = F.upper(F.substring(title, 1, 3))
    return F.when(
        head.isin("S2A", "S2B", "S2C"), F.concat(F.lit("sentinel-2"), F.lower(F.substring(title, 3, 1)))
    )


# How scenes and their rasters are named.
SCENE_NAME = r"^L2A_(T\w{5})_A(\d+)_(\d{8}T\d{6})$"
COG_SUFFIX = "_rgb_3857_cog.tif"


def scene_name(name: Column) -> Column:
    """Tile, absolute orbit, instant and day of a scene name; null when the name does not fit."""
    stamp = F.regexp_extract(name, SCENE_NAME, 3)
    instant = F.try_to_timestamp(stamp, F.lit("yyyyMMdd'T'HHmmss"))
    return F.when(
        name.rlike(SCENE_NAME),
        F.struct(
            F.regexp_extract(name, SCENE_NAME, 1).alias("tile"),
            F.regexp_extract(name, SCENE_NAME, 2).cast("bigint").alias("orbit"),
            F.concat(
                F.substring(stamp, 1, 4), F.lit("-"), F.substring(stamp, 5, 2), F.lit("-"),
                F.substring(stamp, 7, 2), F.lit("T"), F.substring(stamp, 10, 2), F.lit(":"),
                F.substring(stamp, 12, 2), F.lit(":"), F.substring(stamp, 14, 2), F.lit("Z"),
            ).alias("datetime"),
            instant.alias("sensed"),
            F.concat_ws(
                "-", F.substring(stamp, 1, 4), F.substring(stamp, 5, 2), F.substring(stamp, 7, 2)
            ).alias("day"),
        ),
    )


def cloud_percent(fraction_text: Column) -> Column:
    """Cloud fraction 0..1 as percent with four decimals, null when it is no number."""
    return F.round(number(fraction_text) * 100.0, 4)


# Budgets and ground resolution by source.
RESOLUTION_M = {"ortho": 0.10, "satellite": 3.0, "sentinel": 10.0}
ORTHO_BUDGET = (210_000_000, 18_000)
GENERAL_BUDGET = (25_000_000, 8_000)
ESTIMATE_MARGIN = 1.10
