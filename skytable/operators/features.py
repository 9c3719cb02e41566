"""Features as rows: labels, filters, clipping, merging and counting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytable.functions import geometry as geo
from skytable.operators.footprints import cut_to_box
from skytable.functions.text import fold, non_blank, number
from skytable.operators.skew import numbered, salted_join

LABEL_KEYS = ("class", "label", "keyword", "category", "name")
SCORE_KEYS = ("confidence", "score", "probability")
POLYGON_TYPES = ("Polygon", "MultiPolygon")


def feature_label(props: Column) -> Column:
    """First non-blank of the label properties, else "annotation"."""
    return F.coalesce(*[non_blank(F.try_element_at(props, F.lit(k))) for k in LABEL_KEYS], F.lit("annotation"))


def feature_confidence(props: Column, fallback: bool = False) -> Column:
    """The ``confidence`` property as a number; ``fallback`` also reads the other score names."""
    keys = SCORE_KEYS if fallback else SCORE_KEYS[:1]
    return F.coalesce(*[number(F.try_element_at(props, F.lit(k))) for k in keys])


def feature_area(props: Column, geom: Column) -> Column:
    """Stored area when it is a number of at least zero, else the area on the ellipsoid."""
    stored = number(F.try_element_at(props, F.lit("area_m2")))
    return F.coalesce(F.when((stored >= 0) & ~F.isnan(stored), stored), geo.geodesic_area(geom))


def filter_features(
    df: DataFrame,
    geometry_types: Sequence[str] = (),
    labels: Sequence[str] = (),
    min_confidence: float | None = None,
    min_area_m2: float | None = None,
    max_area_m2: float | None = None,
    fallback: bool = False,
) -> DataFrame:
    """Keep polygonal features that pass every given filter; needs geom_type, props and geom."""
    props = F.col("props")
    keep = F.col("geom_type").isin(*POLYGON_TYPES)
    if geometry_types:
        keep = keep & F.col("geom_type").isin(*geometry_types)
    if labels:
        keep = keep & fold(feature_label(props)).isin(*[label.casefold() for label in labels])
    if min_confidence is not None:
        keep = keep & F.coalesce(feature_confidence(props, fallback) >= min_confidence, F.lit(False))
    if min_area_m2 is not None or max_area_m2 is not None:
        area = feature_area(props, F.col("geom"))
        if min_area_m2 is not None:
            keep = keep & (area >= min_area_m2)
        if max_area_m2 is not None:
            keep = keep & (area <= max_area_m2)
    return df.filter(keep)


def json_safe(props: Column) -> Column:
    """Property map of variants as JSON-safe texts: scalars as they are, nested values as JSON text."""
    return F.transform_values(
        props,
        lambda _, v: F.when(
            F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)"), F.to_json(v)
        ).otherwise(F.try_variant_get(v, "$", "string")),
    )


def clip_features(
    df: DataFrame, min_x: Column, min_y: Column, max_x: Column, max_y: Column, digits: int = 2
) -> DataFrame:
    """Cut features at a box; ``area_m2`` is refreshed only where it exists and the area shrank.

    Rectangles are cut by column functions. All others are made valid first and may fall in several parts: then the geometry has
    a polygon for each, and ``geom_type``, where there is one, says so. Features with nothing inside the box are dropped.
    """
    boxed = df.withColumn("_b", geo.bounds(F.col("geom")))
    outside = (
        (F.col("_b.max_x") <= min_x) | (F.col("_b.min_x") >= max_x)
        | (F.col("_b.max_y") <= min_y) | (F.col("_b.min_y") >= max_y)
    )
    inside = (
        (F.col("_b.min_x") >= min_x) & (F.col("_b.max_x") <= max_x)
        & (F.col("_b.min_y") >= min_y) & (F.col("_b.max_y") <= max_y)
    )
    near = boxed.filter(~outside).withColumn("_inside", inside).withColumn("_plain", geo.is_rectangle(F.col("geom")))
    sides = [s.cast("double") for s in (min_x, min_y, max_x, max_y)]
    near = cut_to_box(near, "_parts", F.when(~F.col("_plain"), F.col("geom")), *sides)
    common = [F.greatest(F.col("_b.min_x"), sides[0]), F.greatest(F.col("_b.min_y"), sides[1]), F.least(F.col("_b.max_x"), sides[2]), F.least(F.col("_b.max_y"), sides[3])]
    easy = F.when(F.col("_inside"), F.col("geom")).otherwise(geo.box_geometry(*common))
    cut = near.withColumn("_cut", F.when(F.col("_plain"), easy).otherwise(F.col("_parts.geom"))).filter(F.size("_cut") > 0)
    before = F.coalesce(F.col("_parts.area"), geo.planar_area(F.col("geom")))
    smaller = geo.planar_area(F.col("_cut")) < before * (1 - 1e-9)
    shrank = F.when(F.col("_inside"), F.lit(False)).otherwise(smaller)
    fresh = F.round(geo.geodesic_area(F.col("_cut")), digits)
    out = cut.withColumn("area_m2", F.when(F.col("area_m2").isNotNull() & shrank, fresh).otherwise(F.col("area_m2")))
    if "geom_type" in df.columns:
        changed = ~(F.col("_inside") & F.col("_plain"))
        kind = F.when(F.size("_cut") > 1, F.lit("MultiPolygon")).otherwise(F.lit("Polygon"))
        out = out.withColumn("geom_type", F.when(changed, kind).otherwise(F.col("geom_type")))
    return out.withColumn("geom", F.col("_cut")).select(*df.columns)


def proj_props(epsg: Column, height: Column, width: Column, left: Column, bottom: Column, right: Column, top: Column) -> Column:
    """Raster description: code, shape, nine-value transform and bounds."""
    return F.struct(
        epsg.alias("epsg"),
        F.array(height, width).alias("shape"),
        geo.transform_from_bounds(left, bottom, right, top, width, height).alias("transform"),
        F.array(left, bottom, right, top).alias("bbox"),
    )


def class_name(cls: Column, keyword: Column) -> Column:
    """Class, else keyword; empty text counts as none."""
    return F.coalesce(F.nullif(cls, F.lit("")), F.nullif(keyword, F.lit("")))


def class_registry(df: DataFrame, typed: Sequence[str], keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """Distinct classes with their place: typed ones in typed order, then extras by first appearance.

    Needs ``cls`` and ``ord``. Classes are reduced to one row each before any ordering.
    """
    present = (
        df.filter(F.col("cls").isNotNull()).groupBy(*keys, "cls").agg(F.min("ord").alias("first_ord"))
    )
    if not typed:
        extras = numbered(present, keys, ["first_ord", "cls"])
        return extras.withColumn("color_index", (F.col("rn") - 1).cast("int")).withColumn("place", F.col("rn")).drop("rn")
    place = F.array_position(F.array(*[F.lit(t) for t in typed]), F.col("cls")).cast("int")
    known = present.withColumn("_typed", place)
    named = known.filter("_typed > 0").withColumn("color_index", F.col("_typed") - 1).withColumn("is_extra", F.lit(False))
    extras = numbered(known.filter("_typed = 0"), keys, ["first_ord", "cls"]).withColumn(
        "color_index", (F.lit(len(typed)) + F.col("rn") - 1).cast("int")
    ).withColumn("is_extra", F.lit(True)).drop("rn")
    return named.unionByName(extras).drop("_typed")


def label_values(df: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """Values 1..k of the labels by first appearance, and the mask type that holds them."""
    first = df.groupBy(*keys, "label").agg(F.min("ord").alias("first_ord"))
    values = numbered(first, keys, ["first_ord", "label"], "value")
    widest = values.groupBy(*keys).agg(F.max("value").alias("_n"))
    return (
        values.join(widest, list(keys))
        .withColumn("dtype", F.when(F.col("_n") < 256, F.lit("uint8")).when(F.col("_n") < 65536, F.lit("uint16")).otherwise(F.lit("uint32")))
        .drop("_n")
    )


def export_counts(df: DataFrame, kept: Column, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """Source and exported feature counts in one pass."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("source_feature_count"), F.count_if(kept).alias("exported_feature_count")
    )


def merge_keyword_runs(df: DataFrame) -> DataFrame:
    """Features of all keyword runs: ``cls`` is filled only where missing, ``keyword`` is always the run's."""
    return df.withColumn("cls", F.coalesce("cls", "run_keyword")).withColumn("keyword", F.col("run_keyword"))


def keyword_summary(df: DataFrame, keywords: DataFrame) -> DataFrame:
    """Merged feature count and summary text per query; ``keywords`` holds the ordered list."""
    counts = df.groupBy("query_id").agg(F.count(F.lit(1)).alias("feature_count"))
    return keywords.join(counts, "query_id", "left").withColumn(
        "feature_count", F.coalesce("feature_count", F.lit(0))
    ).withColumn(
        "summary",
        F.format_string(
            "Found %d polygons/clusters for %s", F.col("feature_count"), F.array_join("keywords", ", ")
        ),
    )


def attach_label_values(df: DataFrame, values: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """Give every feature the value of its label; a label may hold most features."""
    return salted_join(df, values.select(*keys, "label", "value"), [*keys, "label"], ["ord"])
