"""Raster operators over pixel rows and block rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytable.functions import geometry as geo
from skytable.functions import pixels as px
from skytable.operators.skew import salted_join

PIXEL = ("raster", "r", "c")


def mosaic_first(pixels: DataFrame, rank: Sequence[Column], keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per pixel the values of the best ranked scene that is valid there; needs ``valid``."""
    best = F.min_by(F.struct(*values), F.struct(*rank))
    return pixels.filter("valid").groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def mask_outside(pixels: DataFrame, aoi: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Set all bands to zero where the pixel centre lies outside the area of its raster.

    ``aoi`` has one ring per raster in raster coordinates; pixels carry the world
    position of their centre as x and y. One raster may hold most pixels.
    """
    joined = salted_join(pixels, aoi.select("raster", "ring"), ["raster"], ["r", "c"], "left")
    inside = F.coalesce(geo.contains_point(F.col("ring"), F.col("x"), F.col("y")), F.lit(False))
    return joined.select(
        *[
            F.when(inside, F.col(c)).otherwise(F.lit(0).cast(pixels.schema[c].dataType)).alias(c) if c in bands else c
            for c in pixels.columns
        ]
    )


def stretch_percentiles(pixels: DataFrame, keys: Sequence[str], value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Contrast stretch between two exact percentiles per image and band, to 0..255.

    Equal values are counted before the percentile, so its state is bounded by the
    number of distinct pixel values (65536 for 16-bit bands), not by the image.
    """
    keys = list(keys)
    counts = pixels.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    limits = counts.groupBy(*keys).agg(
        F.percentile(value, F.array(F.lit(low), F.lit(high)), F.col("_n")).alias("_p")
    )
    joined = salted_join(pixels, limits, keys, [c for c in pixels.columns if c not in keys])
    p_low, p_high = F.col("_p")[0], F.col("_p")[1]
    out = px.truncate(px.clip((F.col(value) - p_low) / (p_high - p_low + 1e-8) * 255.0, 0.0, 255.0))
    return joined.withColumn("stretched", out).drop("_p")


def merge_tile_masks(tiles: DataFrame, keys: Sequence[str] = PIXEL) -> DataFrame:
    """A pixel is on when any overlapping tile says so."""
    return tiles.groupBy(*keys).agg(F.max("on").alias("on"))


def any_mask(masks: DataFrame, keys: Sequence[str] = PIXEL) -> DataFrame:
    """Many instance masks of one patch as one mask."""
    return masks.groupBy(*keys).agg(F.bool_or("on").alias("on"))


def valid_fraction(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pixels.groupBy(*keys).agg(F.avg(F.col("valid").cast("double")).alias("valid_fraction"))


def coverage(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixels and percent of the class."""
    return mask.groupBy(*keys).agg(
        F.count_if("on").alias("pixels"), (F.avg(F.col("on").cast("double")) * 100).alias("percent")
    )


def downsample_avg(pixels: DataFrame, keys: Sequence[str], value: str, factor: int) -> DataFrame:
    """Average over factor x factor cells; no-data pixels (null) do not mix in."""
    down = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return pixels.groupBy(*keys, down("r"), down("c")).agg(F.avg(value).alias(value))


def resample_average(pixels: DataFrame, keys: Sequence[str], value: str, size: tuple[int, int], new_size: tuple[int, int]) -> DataFrame:
    """Area-weighted average at any coarser grid: each pixel is shared among the cells it overlaps."""
    def shares(axis: str, n: int, m: int) -> Column:
        start, end = F.col(axis) * m / n, (F.col(axis) + 1) * m / n
        last = F.least(F.ceil(end) - 1, F.lit(m - 1))
        cells = F.sequence(F.floor(start).cast("int"), F.greatest(F.floor(start), last).cast("int"))
        return F.transform(
            cells, lambda i: F.struct(i.alias("i"), (F.least(end, i + 1) - F.greatest(start, i)).alias("w"))
        )

    (h, w), (new_h, new_w) = size, new_size
    spread = pixels.filter(F.col(value).isNotNull()).withColumn("_r", F.explode(shares("r", h, new_h))).withColumn(
        "_c", F.explode(shares("c", w, new_w))
    )
    weight = F.col("_r.w") * F.col("_c.w")
    return spread.groupBy(*keys, F.col("_r.i").alias("r"), F.col("_c.i").alias("c")).agg(
        (F.sum(F.col(value) * weight) / F.sum(weight)).alias(value)
    )


def tile_grid(rasters: DataFrame, patch: int, overlap: int, flush: bool = False) -> DataFrame:
    """Tiles of each raster (height, width): origin and size."""
    origins = px.tile_origins_flush if flush else px.tile_origins
    grid = rasters.withColumn("y", F.explode(origins(F.col("height"), patch, overlap))).withColumn(
        "x", F.explode(origins(F.col("width"), patch, overlap))
    )
    return grid.withColumn("tile_h", F.least(F.lit(patch), F.col("height") - F.col("y"))).withColumn(
        "tile_w", F.least(F.lit(patch), F.col("width") - F.col("x"))
    )


def pad_reflect(pixels: DataFrame, sizes: DataFrame, patch: int) -> DataFrame:
    """Reflect padding to a multiple of the patch.

    Every pixel is copied to the padded positions that mirror it (at most a few
    per axis), so no grid is generated and joined.
    """
    def mirrors(axis: str, n: str) -> Column:
        length = F.col(n)
        return F.filter(
            F.concat(F.array(F.col(axis)), F.sequence(length, F.greatest(px.padded(length, patch) - 1, length))),
            lambda i: (i == F.col(axis)) | ((i < px.padded(length, patch)) & (px.reflect_index(i, length) == F.col(axis))),
        )

    joined = salted_join(pixels, sizes, ["raster"], ["r", "c"])
    return joined.withColumn("_r", F.explode(mirrors("r", "height"))).withColumn(
        "_c", F.explode(mirrors("c", "width"))
    ).withColumn("r", F.col("_r").cast("int")).withColumn("c", F.col("_c").cast("int")).drop("_r", "_c")


def nonblank(tiles: DataFrame, values: str) -> DataFrame:
    """Block rows with at least one value that is not zero."""
    return tiles.filter(F.exists(values, lambda v: v != 0))


def resize_nearest(pixels: DataFrame, keys: Sequence[str], size: tuple[int, int], new_size: tuple[int, int]) -> DataFrame:
    """Nearest resize: a target pixel takes the source under its centre; sources list their targets."""
    def targets(axis: str, n: int, m: int) -> Column:
        first = F.greatest(F.lit(0), F.floor(F.col(axis) * m / n - 1).cast("int"))
        last = F.least(F.lit(m - 1), F.ceil((F.col(axis) + 1) * m / n).cast("int"))
        return F.filter(
            F.sequence(first, F.greatest(first, last)),
            lambda t: F.floor((t + 0.5) * n / m).cast("int") == F.col(axis),
        )

    (h, w), (new_h, new_w) = size, new_size
    spread = pixels.withColumn("_r", F.explode(targets("r", h, new_h))).withColumn("_c", F.explode(targets("c", w, new_w)))
    return spread.withColumn("r", F.col("_r")).withColumn("c", F.col("_c")).drop("_r", "_c")


def resize_bilinear(pixels: DataFrame, keys: Sequence[str], value: str, size: tuple[int, int], new_size: tuple[int, int]) -> DataFrame:
    """Bilinear resize (half-pixel centres): a source gives its weight to every target it touches."""
    def weights(axis: str, n: int, m: int) -> Column:
        i = F.col(axis)
        first = F.greatest(F.lit(0), F.floor((i - 1) * m / n - 1).cast("int"))
        last = F.least(F.lit(m - 1), F.ceil((i + 2) * m / n).cast("int"))

        def weight(t):
            at = F.greatest(F.lit(0.0), (t + 0.5) * n / m - 0.5)
            low = F.least(F.floor(at).cast("int"), F.lit(n - 1))
            high = F.least(low + 1, F.lit(n - 1))
            part = at - low
            return F.when(low == i, 1.0 - part).otherwise(0.0) + F.when(high == i, part).otherwise(0.0)

        shares = F.transform(F.sequence(first, F.greatest(first, last)), lambda t: F.struct(t.alias("i"), weight(t).alias("w")))
        return F.filter(shares, lambda s: s["w"] > 0)

    (h, w), (new_h, new_w) = size, new_size
    spread = pixels.withColumn("_r", F.explode(weights("r", h, new_h))).withColumn("_c", F.explode(weights("c", w, new_w)))
    return spread.groupBy(*keys, F.col("_r.i").alias("r"), F.col("_c.i").alias("c")).agg(
        F.sum(F.col(value) * F.col("_r.w") * F.col("_c.w")).alias(value)
    )


def decimate(pixels: DataFrame, factor: int) -> DataFrame:
    """Nearest sampling of every factor-th pixel; the filter runs before any shuffle."""
    return pixels.filter((F.col("r") % factor == 0) & (F.col("c") % factor == 0)).withColumn(
        "r", F.floor(F.col("r") / factor).cast("int")
    ).withColumn("c", F.floor(F.col("c") / factor).cast("int"))


def gate_mask(mask: DataFrame, vegetation: DataFrame | None, keys: Sequence[str] = PIXEL) -> DataFrame:
    """Mask and vegetation mask on one grid; without a NIR band the mask stays."""
    if vegetation is None:
        return mask
    veg = vegetation.select(*keys, F.col("on").alias("_veg"))
    return mask.join(veg, list(keys), "left").withColumn("on", px.gate(F.col("on"), F.col("_veg"))).drop("_veg")


def class_mask_blocks(blocks: DataFrame, value: Column, cls: int, side: int) -> DataFrame:
    """Add the block array ``mask`` of one class, and the counts ``pixels`` and ``on``, within the raster's own size.

    ``value`` is an array column of side x side classes; block_row, block_col, height and width say which of them lie in the raster. Rows and
    columns that padding added are false in the mask and are not counted. Nothing leaves its block.
    """
    def in_raster(i):
        return (F.col("block_row") * side + F.floor(i / side) < F.col("height")) & (F.col("block_col") * side + i % side < F.col("width"))

    rows = F.greatest(F.lit(0), F.least(F.lit(side), F.col("height") - F.col("block_row") * side))
    cols = F.greatest(F.lit(0), F.least(F.lit(side), F.col("width") - F.col("block_col") * side))
    masked = blocks.withColumn("mask", F.transform(value, lambda v, i: F.coalesce(v == cls, F.lit(False)) & in_raster(i)))
    return masked.withColumn("pixels", (rows * cols).cast("long")).withColumn("on", F.size(F.filter("mask", lambda m: m)).cast("long"))


def class_cover(masked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixels and pixels of the class per raster, with their share; one number of each leaves a block."""
    sums = masked.groupBy(*keys).agg(F.sum("pixels").alias("pixels"), F.sum("on").alias("on"))
    return sums.withColumn("share", F.try_divide(F.col("on"), F.col("pixels")))


def rasterize(features: DataFrame, grid: dict, keys: Sequence[str] = ("query_id",), strip_rows: int = 64) -> DataFrame:
    """Label grid of polygons: every touched cell, a later feature overwrites, background 0.

    Needs geom (in grid coordinates), value and ord. ``grid`` holds left, top,
    cell, height and width. A polygon is cut into strips of rows, the strips are
    spread over the cluster, and only then become cells, so one huge polygon does
    not end in one task.
    """
    left, top, cell, height, width = (grid[k] for k in ("left", "top", "cell", "height", "width"))
    boxed = features.withColumn("_b", geo.bounds(F.col("geom")))
    row = lambda y: (F.lit(top) - y) / cell
    col = lambda x: (x - F.lit(left)) / cell
    last = lambda v, n: F.least(F.ceil(v) - 1, F.lit(n - 1)).cast("int")
    first = lambda v: F.greatest(F.floor(v), F.lit(0)).cast("int")
    placed = (
        boxed.withColumn("_r0", first(row(F.col("_b.max_y")))).withColumn("_r1", last(row(F.col("_b.min_y")), height))
        .withColumn("_c0", first(col(F.col("_b.min_x")))).withColumn("_c1", last(col(F.col("_b.max_x")), width))
        .filter("_r0 <= _r1 AND _c0 <= _c1").drop("_b")
    )
    strips = placed.withColumn("_s", F.explode(F.sequence(F.col("_r0"), F.col("_r1"), F.lit(strip_rows)))).repartition(
        *[F.col(k) for k in keys], "ord", "_s"
    )
    cells = strips.withColumn(
        "r", F.explode(F.sequence(F.col("_s"), F.least(F.col("_s") + strip_rows - 1, F.col("_r1"))))
    ).withColumn("c", F.explode(F.sequence(F.col("_c0"), F.col("_c1"))))
    x0, y1 = F.lit(left) + F.col("c") * cell, F.lit(top) - F.col("r") * cell
    touched = cells.filter(geo.polygon_meets_box(F.col("geom"), x0, y1 - cell, x0 + cell, y1))
    background = (
        features.select(*keys).distinct()
        .withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
        .repartition(*[F.col(k) for k in keys], "r")
        .withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
        .withColumn("value", F.lit(0).cast("bigint")).withColumn("ord", F.lit(-1).cast("bigint"))
    )
    burned = touched.select(*keys, "r", "c", F.col("value").cast("bigint").alias("value"), F.col("ord").cast("bigint").alias("ord"))
    return burned.unionByName(background).groupBy(*keys, "r", "c").agg(F.max_by("value", "ord").alias("value"))
