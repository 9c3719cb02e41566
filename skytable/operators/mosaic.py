"""Mosaic index: map tiles of raster files, ordered lists, header."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytable.functions import geometry as geo
from skytable.operators.skew import numbered, ranges_of

EDGE = 1e-9
TILE_EDGE = 1e-11
MERCATOR_PIXEL_M = 156543.0339280410


def cover_tiles(files: DataFrame, zoom: int = 12) -> DataFrame:
    """One row per file and map tile; the east and north edges are pulled in a little."""
    x0, x1 = geo.tile_x(F.col("min_lon"), zoom), geo.tile_x(F.col("max_lon") - EDGE - TILE_EDGE, zoom)
    y0, y1 = geo.tile_y(F.col("max_lat") - EDGE, zoom), geo.tile_y(F.col("min_lat") + TILE_EDGE, zoom)
    columns = files.select("path", "pref", F.explode(F.sequence(x0, x1)).alias("tx"), y0.alias("_y0"), y1.alias("_y1"))
    cells = columns.withColumn("ty", F.explode(F.sequence("_y0", "_y1"))).drop("_y0", "_y1")
    return cells.withColumn("quadkey", geo.quadkey(F.col("tx"), F.col("ty"), zoom))


def quadkey_assets(cover: DataFrame) -> DataFrame:
    """Files of each quadkey in preference order as rows: quadkey, place, path.

    The list stays in rows, so a tile with very many files needs no large array.
    """
    listed = cover.select("quadkey", "pref", "path")
    return numbered(listed, ["quadkey"], ["pref", "path"], "place", ranges_of(listed)).select("quadkey", "place", "path")


def mosaic_header(files: DataFrame, min_zoom: int = 8, max_zoom: int | None = None) -> DataFrame:
    """Union bounds, centre and zoom range; ``res_m`` is the Web Mercator resolution of a file."""
    native = F.max(F.bround(F.log2(F.lit(MERCATOR_PIXEL_M) / F.col("res_m")), 0).cast("int"))
    top = F.least(F.lit(22), F.greatest(F.lit(0), native)) if max_zoom is None else F.lit(max_zoom)
    bounds = files.agg(
        F.min("min_lon").alias("west"), F.min("min_lat").alias("south"), F.max("max_lon").alias("east"),
        F.max("max_lat").alias("north"), top.alias("maxzoom"),
    )
    return bounds.withColumn("minzoom", F.lit(min_zoom)).withColumn(
        "center_lon", (F.col("west") + F.col("east")) / 2
    ).withColumn("center_lat", (F.col("south") + F.col("north")) / 2)
