"""Split touching objects: exact distances, peaks, and basins of steepest ascent."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skytable.operators.skew import salted_join
from skytable.session import materialize


def squared_distances(pixels: DataFrame) -> DataFrame:
    """Adds ``d2``: squared distance to the nearest background pixel; needs raster, r, c, on.

    First along rows, then along columns. A group is one row or column of a
    raster, which the raster budget bounds to some ten thousand pixels.
    """
    row = Window.partitionBy("raster", "r").orderBy("c")
    before = F.last(F.when(~F.col("on"), F.col("c")), ignorenulls=True).over(row)
    after = F.first(F.when(~F.col("on"), F.col("c")), ignorenulls=True).over(
        row.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    gaps = pixels.withColumn("_g", F.least(F.col("c") - before, after - F.col("c")).cast("double"))

    def along_column(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("r")
        low = int(frame["r"].iloc[0])
        size = int(frame["r"].iloc[-1]) - low + 1
        g2 = np.full(size, np.inf)
        at = frame["r"].to_numpy() - low
        g2[at] = frame["_g"].fillna(np.inf).to_numpy() ** 2
        best = g2.copy()
        for k in range(1, size):
            if k * k >= best[np.isfinite(best)].max(initial=0.0) and np.isfinite(best).all():
                break
            best[k:] = np.minimum(best[k:], g2[:-k] + k * k)
            best[:-k] = np.minimum(best[:-k], g2[k:] + k * k)
        return frame.assign(d2=best[at]).drop(columns="_g")

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pixels.schema)
    return gaps.groupBy("raster", "c").applyInPandas(along_column, f"{fields}, d2 double")


def split_touching(pixels: DataFrame, min_distance: int = 7) -> DataFrame:
    """One label per object part: raster, r, c, label (id of its peak); needs raster, r, c, id, on, label.

    ``label`` is the connected component on entry. A peak is the deepest pixel
    within ``min_distance`` (square window, same component, ties by lower id). Each
    pixel climbs to its deepest neighbour, and a local top that is no peak goes on
    to the deepest pixel in its window; pointers are followed by doubling.
    """
    rank = lambda d, i: F.struct(F.col(d).alias("d2"), (-F.col(i)).alias("neg"))
    depth = materialize(squared_distances(pixels).filter("on").select("raster", "label", "r", "c", "id", "d2"))
    offsets = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in (-1, 0, 1) for x in (-1, 0, 1)])
    sent = depth.withColumn("_o", F.explode(offsets)).select(
        "raster", "label", (F.col("r") + F.col("_o.y")).alias("r"), (F.col("c") + F.col("_o.x")).alias("c"), rank("d2", "id").alias("top")
    )
    tops = sent.groupBy("raster", "label", "r", "c").agg(F.max("top").alias("top"))
    climbing = materialize(
        depth.join(tops, ["raster", "label", "r", "c"]).withColumn("next", -F.col("top.neg")).drop("top")
    )
    size = min_distance + 1
    cell = lambda c: F.floor(F.col(c) / size)
    local = climbing.filter("next = id").select("raster", "label", F.col("id").alias("t_id"), F.col("r").alias("t_r"), F.col("c").alias("t_c"))
    near = local.withColumn("cr", F.explode(F.sequence(F.floor((F.col("t_r") - min_distance) / size), F.floor((F.col("t_r") + min_distance) / size)))).withColumn(
        "cc", F.explode(F.sequence(F.floor((F.col("t_c") - min_distance) / size), F.floor((F.col("t_c") + min_distance) / size)))
    )
    # A cell holds at most size * size pixels, so a local top meets a fixed number of them.
    around = depth.withColumn("cr", cell("r")).withColumn("cc", cell("c"))
    window = (F.abs(F.col("r") - F.col("t_r")) <= min_distance) & (F.abs(F.col("c") - F.col("t_c")) <= min_distance)
    strongest = near.join(around, ["raster", "label", "cr", "cc"]).filter(window).groupBy("raster", "t_id").agg(
        F.max(rank("d2", "id")).alias("top")
    ).select("raster", F.col("t_id").alias("id"), (-F.col("top.neg")).alias("_up"))
    pointers = climbing.join(strongest, ["raster", "id"], "left").select(
        "raster", "r", "c", "id", F.coalesce("_up", "next").alias("next")
    )
    open_, done = materialize(pointers), []
    links = open_.select("raster", F.col("id").alias("next"), F.col("next").alias("_n"))
    while not open_.isEmpty():
        stepped = materialize(salted_join(open_, links, ["raster", "next"], ["id"]))
        done.append(stepped.filter("_n = next").select("raster", "r", "c", F.col("next").alias("label")))
        open_ = stepped.filter("_n != next").select("raster", "r", "c", "id", F.col("_n").alias("next"))
        doubled = salted_join(links.filter("_n != next").withColumnsRenamed({"next": "id", "_n": "next"}), links, ["raster", "next"], ["id"])
        roots = links.filter("_n = next")
        links = materialize(doubled.select("raster", F.col("id").alias("next"), "_n").unionByName(roots))
    if not done:
        # A mask without pixels has no parts.
        return open_.select("raster", "r", "c", F.col("id").alias("label"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
