"""Raster size estimates and budgets of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytable.functions import projection, rules
from skytable.operators.requests import attach_budget


def estimate_raster(df: DataFrame, margin: float = rules.ESTIMATE_MARGIN) -> DataFrame:
    """Add zone, extent in meters and raster size of the projected crop; needs ``resolution_m``."""
    if margin < 1:
        raise ValueError("margin must be at least 1.0")
    box = [F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")]
    df = df.withColumn("epsg", projection.utm_epsg(*box)).withColumn("_zone", (F.col("epsg") % 100).cast("double"))
    south = F.col("epsg") >= 32700
    corners = []
    for lon in ("min_lon", "max_lon"):
        for lat in ("min_lat", "max_lat"):
            x, y = projection.to_utm(F.col(lon), F.col(lat), F.col("_zone"), south)
            corners.append(F.struct(x.alias("x"), y.alias("y")))
    df = df.withColumn("_corners", F.array(*corners))
    xs, ys = F.col("_corners")["x"], F.col("_corners")["y"]
    pixels = lambda meters: F.greatest(F.lit(1), F.ceil(F.col(meters) / F.col("resolution_m") * margin))
    return (
        df.withColumn("width_m", F.array_max(xs) - F.array_min(xs))
        .withColumn("height_m", F.array_max(ys) - F.array_min(ys))
        .withColumn("width_px", pixels("width_m").cast("bigint"))
        .withColumn("height_px", pixels("height_m").cast("bigint"))
        .withColumn("total_px", F.col("width_px") * F.col("height_px"))
        .withColumn("megapixels", F.round(F.col("total_px") / 1_000_000, 2))
        .drop("_zone", "_corners")
    )


def fits_budget() -> Column:
    """Total and both sides within the limits of the row."""
    return (
        (F.col("total_px") <= F.col("max_total_pixels"))
        & (F.col("width_px") <= F.col("max_side_pixels"))
        & (F.col("height_px") <= F.col("max_side_pixels"))
    )


def check_budget(df: DataFrame) -> DataFrame:
    """Add ``allowed`` and the message for an oversize request."""
    message = F.format_string(
        "Requested area is too large for the selected imagery and model combination. Estimated raster: "
        "%,d × %,d pixels (%.1f MP). Current limits: %.1f MP total and %,d pixels per side. "
        "Please select a smaller area.",
        F.col("width_px"), F.col("height_px"), F.col("total_px") / 1_000_000,
        F.col("max_total_pixels") / 1_000_000, F.col("max_side_pixels"),
    )
    return df.withColumn("allowed", fits_budget()).withColumn("error", F.when(~F.col("allowed"), message))


def estimate_requests(df: DataFrame) -> DataFrame:
    """Budget columns, estimate and check of valid requests in one narrow plan."""
    return check_budget(estimate_raster(attach_budget(df)))
