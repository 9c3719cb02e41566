"""Hooks for user models over tiles, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType

from skytable.operators.skew import salted_join

TILE = ("raster", "y", "x", "tile_h", "tile_w")


def _batches(frame: pd.DataFrame, keys: list[str], size: int) -> Iterator[pd.DataFrame]:
    for _, same in frame.groupby(keys, sort=False):
        for start in range(0, len(same), size):
            yield same.iloc[start:start + size]


def _call(fn: Callable, chunk: pd.DataFrame, args: tuple) -> list:
    tiles = [
        np.asarray(values).reshape(h, w) for values, h, w in zip(chunk["values"], chunk["tile_h"], chunk["tile_w"])
    ]
    results = fn(tiles, *args)
    if len(results) != len(tiles):
        raise ValueError("the model must give one result per tile")
    return list(results)


def _scored(fn: Callable, chunk: pd.DataFrame, args: tuple) -> list[tuple[str, object]]:
    """Results of a batch; a failed batch is tried again tile by tile."""
    try:
        return [("done", r) for r in _call(fn, chunk, args)]
    except Exception:  # a user model may fail in any way; the status column tells
        if len(chunk) == 1:
            return [("failed", None)]
    out = []
    for i in range(len(chunk)):
        out += _scored(fn, chunk.iloc[i:i + 1], args)
    return out


def score_tiles(tiles: DataFrame, fn: Callable, batch: int = 1, keyword: str | None = None) -> DataFrame:
    """Masks of a user model: one row per tile with its status (done, empty, failed) and mask.

    ``fn`` gets a list of equally sized arrays (and the keyword of the rows when a
    keyword column is named) and gives one mask or None per tile. Blank tiles are
    told apart before Python sees them.
    """
    extra = [keyword] if keyword else []
    blank = ~F.exists("values", lambda v: v != 0)
    schema = StructType(
        [tiles.schema[c] for c in (*TILE, *extra)]
    ).add("status", StringType()).add("mask", ArrayType(BooleanType()))

    def run(frames):
        for frame in frames:
            parts = []
            for chunk in _batches(frame, ["tile_h", "tile_w", *extra], batch):
                args = (chunk[keyword].iloc[0],) if keyword else ()
                results = _scored(fn, chunk, args)
                part = chunk[[*TILE, *extra]].copy()
                part["status"] = [s for s, _ in results]
                part["mask"] = [None if m is None else np.asarray(m).astype(bool).ravel() for _, m in results]
                parts.append(part)
            if parts:
                yield pd.concat(parts)

    scored = tiles.filter(~blank).select(*TILE, *extra, "values").mapInPandas(run, schema)
    empty = tiles.filter(blank).select(*TILE, *extra, F.lit("empty").alias("status"), F.lit(None).cast("array<boolean>").alias("mask"))
    return scored.unionByName(empty)


def score_keywords(tiles: DataFrame, requests: DataFrame, fn: Callable, batch: int = 1) -> DataFrame:
    """The model once per request and keyword over the tiles of the request's raster."""
    asked = requests.select("query_id", "raster", F.posexplode("keywords").alias("keyword_ord", "keyword"))
    work = salted_join(tiles, asked, ["raster"], ["y", "x"]).withColumn("task", F.struct("query_id", "keyword_ord", "keyword"))
    named = work.withColumn("task", F.to_json("task"))
    scored = score_tiles(named, lambda t, task: fn(t, _keyword(task)), batch, keyword="task")
    fields = F.from_json("task", "query_id bigint, keyword_ord int, keyword string")
    return scored.select(*TILE, "status", "mask", fields.alias("t")).select(*TILE, "status", "mask", "t.*")


def _keyword(task: str) -> str:
    import json

    return json.loads(task)["keyword"]


def tile_pixels(scored: DataFrame) -> DataFrame:
    """Pixels of the scored tiles in raster coordinates, with the model's answer."""
    cells = scored.filter("mask IS NOT NULL").select("raster", "y", "x", "tile_w", F.posexplode("mask").alias("_p", "on"))
    return cells.select(
        "raster", (F.col("y") + F.floor(F.col("_p") / F.col("tile_w"))).cast("int").alias("r"),
        (F.col("x") + F.col("_p") % F.col("tile_w")).cast("int").alias("c"), "on",
    )


def tile_report(tiles: DataFrame) -> DataFrame:
    """Done, empty and failed tiles per raster."""
    return tiles.groupBy("raster").agg(
        F.count(F.lit(1)).alias("tiles"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("done", "empty", "failed")],
    )


def detect(tiles: DataFrame, fn: Callable) -> DataFrame:
    """Boxes of a user model in tile coordinates: one row per box; blank tiles are left out.

    ``fn`` gets one tile array and gives rows of (xmin, ymin, xmax, ymax, score, class).
    """
    schema = "raster bigint, tile_y int, tile_x int, n int, xmin double, ymin double, xmax double, ymax double, score double, cls string"

    def run(frames):
        for frame in frames:
            rows = []
            for t in frame.itertuples():
                found = fn(np.asarray(t.values).reshape(t.tile_h, t.tile_w))
                rows += [(t.raster, t.y, t.x, i, *map(float, b[:5]), str(b[5])) for i, b in enumerate(found)]
            yield pd.DataFrame(rows, columns=[part.split()[0] for part in schema.split(", ")])

    visible = tiles.filter(F.exists("values", lambda v: v != 0)).select(*TILE, "values")
    return visible.mapInPandas(run, schema)
