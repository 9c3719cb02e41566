"""Readers and writers: inventories, links, features, items, tile lists, manifests, blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytable.functions import geometry as geo
from skytable.functions.text import strip
from skytable.operators.skew import salted_join

# Columns of the acquisition-links file, all text.
LINK_COLUMNS = (
    "tileId", "startDate", "status", "cloudCover", "area_covered",
    "black_area", "processingBaseline", "title", "polygon",
)
ITEM_SCHEMA = (
    "id string, collection string, geometry string, bbox array<double>, "
    "properties map<string,string>, assets map<string,string>"
)
COLLECTION_SCHEMA = (
    "id string, extent struct<spatial:struct<bbox:array<array<double>>>,temporal:struct<interval:array<array<string>>>>, "
    "summaries struct<platform:array<string>,gsd:array<double>,`eo:cloud_cover`:struct<minimum:double,maximum:double>>, "
    "item_assets map<string,struct<type:string,roles:array<string>,title:string,gsd:double,"
    "`eo:bands`:array<struct<name:string,common_name:string,center_wavelength:double>>>>"
)
MANIFEST_SCHEMA = (
    "export_id string, query_id string, created_at string, source_feature_count bigint, "
    "exported_feature_count bigint, output_crs string, label_values map<string,int>, "
    "artifacts array<struct<name:string,path:string,media_type:string>>"
)


def scan_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Path, tile folder, name and size of matching files; contents are not read."""
    found = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    )
    parts = F.split("path", "/")
    return found.select(
        "path", F.element_at(parts, -2).alias("tile"), F.element_at(parts, -1).alias("name"), F.col("length").alias("size")
    )


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """Acquisition links as text columns; types come later with lenient casts."""
    return spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in LINK_COLUMNS), escape='"')


def read_tile_list(spark: SparkSession, path: str) -> DataFrame:
    """One tile per line, blank lines dropped."""
    return spark.read.text(path).select(strip(F.col("value")).alias("tile")).filter("tile != ''")


def write_tile_list(df: DataFrame, path: str) -> None:
    """Distinct tiles in order; part files in name order form one list."""
    df.select("tile").filter("tile IS NOT NULL").distinct().orderBy("tile").write.mode("overwrite").text(path)


def write_items(df: DataFrame, path: str) -> None:
    """Publish items as newline-delimited JSON; an empty catalogue is refused."""
    if df.isEmpty():
        raise ValueError("no items built: refusing to write an empty catalogue")
    df.write.mode("overwrite").json(path)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ITEM_SCHEMA).json(path)


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    """Collection definitions, one document per file."""
    return spark.read.schema(COLLECTION_SCHEMA).json(path, multiLine=True)


def collection_bands(collections: DataFrame) -> DataFrame:
    """One row per collection, asset and band."""
    assets = collections.select("id", F.explode("item_assets").alias("asset", "a"))
    return assets.select("id", "asset", F.col("a.gsd").alias("gsd"), F.explode("a.`eo:bands`").alias("band")).select(
        "id", "asset", "gsd", "band.*"
    )


def write_feature_collections(df: DataFrame, path: str, name: str = "annotations") -> None:
    """One document per query, features in order, one feature per line.

    A query of any size is cut into ordered part files by range partitioning; the
    parts below ``query_id=..`` in name order are the document. First and last
    feature of a query carry the opening and closing text. Needs query_id, ord,
    geometry (JSON text) and properties (JSON text).
    """
    ends = df.groupBy("query_id").agg(F.min("ord").alias("_first"), F.max("ord").alias("_last"))
    feature = F.concat(
        F.lit('{"type":"Feature","geometry":'), "geometry", F.lit(',"properties":'), "properties", F.lit("}")
    )
    opening = F.concat(F.lit('{"type":"FeatureCollection","name":"'), F.lit(name), F.lit('","features":[\n'))
    line = F.concat(
        F.when(F.col("ord") == F.col("_first"), opening).otherwise(F.lit("")),
        feature,
        F.when(F.col("ord") == F.col("_last"), F.lit("\n]}")).otherwise(F.lit(",")),
    )
    joined = salted_join(df, ends, ["query_id"], ["ord"])
    (
        joined.select("query_id", "ord", line.alias("value"))
        .repartitionByRange("query_id", "ord")
        .sortWithinPartitions("query_id", "ord")
        .select("query_id", "value")
        .write.mode("overwrite").partitionBy("query_id").text(path)
    )


def read_feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """Features of documents with one feature per line: splittable, so documents may be huge.

    Lines between features are document text. The ordinal is not stored in a line,
    so the features keep their own ``ord`` property when they have one.
    """
    schema = "type string, geometry struct<type:string,coordinates:string>, properties map<string,string>"
    lines = spark.read.text(path)
    body = F.regexp_replace(F.regexp_replace("value", r"^\{\"type\":\"FeatureCollection\".*\[$|^\]\}$", ""), r",$", "")
    keep = ["query_id"] if "query_id" in lines.columns else []
    return (
        lines.withColumn("_f", F.from_json(body, schema)).filter("_f.type = 'Feature'")
        .select(*keep, F.col("_f.geometry.type").alias("geom_type"), F.col("_f.geometry.coordinates").alias("coordinates"),
                F.col("_f.properties").alias("props"))
    )


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Features of whole documents with their ordinal; a document of another type is an error."""
    schema = (
        "type string, name string, features array<struct<type:string,"
        "geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"
    )
    docs = spark.read.schema(schema).json(path, multiLine=True).withColumn("path", F.input_file_name())
    fail = F.raise_error(F.lit("prediction result must be a FeatureCollection")).cast("string")
    checked = docs.withColumn("type", F.when(F.col("type") == "FeatureCollection", F.col("type")).otherwise(fail))
    return checked.select("path", "type", F.posexplode_outer("features").alias("ord", "f")).filter("type IS NOT NULL").select(
        "path", "ord", F.col("f.geometry.type").alias("geom_type"),
        F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("props"),
    )


def parse_coordinates(coordinates, geom_type):
    """Coordinate text of a Polygon or MultiPolygon as a geometry."""
    polygon = F.from_json(coordinates, "array<array<array<double>>>")
    multi = F.from_json(coordinates, "array<array<array<array<double>>>>")
    nested = F.when(geom_type == "Polygon", F.array(polygon)).when(geom_type == "MultiPolygon", multi)
    return F.transform(
        nested, lambda p: F.transform(p, lambda r: F.transform(r, lambda c: geo.point(c[0], c[1])))
    )


def write_manifests(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Export manifests; unreadable ones are skipped."""
    return spark.read.schema(MANIFEST_SCHEMA).json(path, mode="DROPMALFORMED").filter("export_id IS NOT NULL")


def blocks_to_pixels(blocks: DataFrame, values: str, side: int, keep: Sequence[str] = ()) -> DataFrame:
    """Long pixel form of square blocks: row and column inside the block."""
    return blocks.select(*keep, F.posexplode(values).alias("_pos", "v")).select(
        *keep, F.floor(F.col("_pos") / side).cast("int").alias("r"), (F.col("_pos") % side).cast("int").alias("c"), "v"
    )
