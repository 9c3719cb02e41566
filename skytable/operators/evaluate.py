"""Scores of segmentations and of training histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytable.operators.skew import prefix_scan

SMOOTH = 1e-6


def _counts(pred: Column, truth: Column) -> list[Column]:
    return [
        F.count_if(pred & truth).alias("tp"), F.count_if(pred & ~truth).alias("fp"), F.count_if(~pred & truth).alias("fn")
    ]


def seg_metrics(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """IoU and Dice per batch from boolean pred and truth, smoothed."""
    counts = pixels.groupBy(*keys).agg(*_counts(F.col("pred"), F.col("truth")))
    both, either = F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")
    return counts.select(
        *keys,
        ((both + SMOOTH) / (either + SMOOTH)).alias("iou"),
        ((2 * both + SMOOTH) / (2 * both + F.col("fp") + F.col("fn") + SMOOTH)).alias("dice"),
    )


def epoch_means(batches: DataFrame, keys: Sequence[str] = ("epoch",)) -> DataFrame:
    """Mean over the batches of an epoch."""
    return batches.groupBy(*keys).agg(F.avg("iou").alias("iou"), F.avg("dice").alias("dice"))


def tversky(pixels: DataFrame, keys: Sequence[str], alpha: float = 0.3, beta: float = 0.7) -> DataFrame:
    """Overlap score with separate weights for false positives and false negatives."""
    counts = pixels.groupBy(*keys).agg(*_counts(F.col("pred"), F.col("truth")))
    return counts.select(*keys, F.try_divide(F.col("tp"), F.col("tp") + alpha * F.col("fp") + beta * F.col("fn")).alias("score"))


def best_so_far(df: DataFrame, keys: Sequence[str], order: Sequence[str], metric: str, start: float = 0.0) -> DataFrame:
    """Rows whose metric is above all earlier ones of their run, starting from ``start``."""
    scanned = prefix_scan(df, keys, order, {"_best": ("max", F.col(metric))}, inclusive=False)
    return scanned.filter(F.col(metric) > F.greatest(F.coalesce("_best", F.lit(start)), F.lit(start))).drop("_best")
