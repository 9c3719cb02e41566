"""Masks to instances: connected components, sizes, relabelling, splitting, polygons.

Masks come as blocks: raster, block_row, block_col, width (pixels of the raster)
and an array per block. A pixel id is row * width + column. Work inside a block is
bounded by the block; everything between blocks is joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytable.functions import geometry as geo
from skytable.operators.skew import numbered, salted_join
from skytable.session import materialize

BLOCK = ("raster", "block_row", "block_col")


def pixels_to_blocks(pixels: DataFrame, value: str, side: int, width: Column) -> DataFrame:
    """Pixel rows gathered to blocks of ``side``; missing pixels are null."""
    keyed = pixels.select(
        "raster", F.floor(F.col("r") / side).cast("int").alias("block_row"), F.floor(F.col("c") / side).cast("int").alias("block_col"),
        ((F.col("r") % side) * side + F.col("c") % side).alias("_pos"), F.col(value).alias("_v"), width.cast("bigint").alias("width"),
    )
    # At most side * side pixels per block.
    gathered = keyed.groupBy(*BLOCK, "width").agg(F.map_from_entries(F.collect_list(F.struct("_pos", "_v"))).alias("_m"))
    positions = F.sequence(F.lit(0), F.lit(side * side - 1))
    return gathered.withColumn(value, F.transform(positions, lambda i: F.try_element_at("_m", i))).drop("_m")


def block_pixels(blocks: DataFrame, value: str, side: int) -> DataFrame:
    """Pixel rows of blocks in raster coordinates."""
    cells = blocks.select(*BLOCK, F.posexplode(value).alias("_p", value))
    return cells.select(
        "raster", (F.col("block_row") * side + F.floor(F.col("_p") / side)).cast("int").alias("r"),
        (F.col("block_col") * side + F.col("_p") % side).cast("int").alias("c"), value,
    )


def _local_labels(masks: np.ndarray) -> np.ndarray:
    """4-connected labels of a stack of masks: the least pixel index of each part, -1 outside."""
    n, h, w = masks.shape
    big = h * w
    labels = np.where(masks, np.arange(big).reshape(1, h, w), big)
    stack = np.arange(n).reshape(n, 1)
    while True:
        new = labels.copy()
        new[:, 1:] = np.minimum(new[:, 1:], labels[:, :-1])
        new[:, :-1] = np.minimum(new[:, :-1], labels[:, 1:])
        new[:, :, 1:] = np.minimum(new[:, :, 1:], labels[:, :, :-1])
        new[:, :, :-1] = np.minimum(new[:, :, :-1], labels[:, :, 1:])
        new = np.where(masks, new, big)
        flat = np.concatenate([new.reshape(n, big), np.full((n, 1), big)], axis=1)
        flat = flat[stack, flat]  # a label points to a pixel, which may know a lesser one
        new = flat[:, :big].reshape(n, h, w)
        if np.array_equal(new, labels):
            return np.where(masks, labels, -1)
        labels = new


def label_blocks(blocks: DataFrame, side: int, mask: str = "mask") -> DataFrame:
    """Labels inside each block, as pixel ids of the raster; 0 ids are shifted by one, so 0 is background."""

    @F.pandas_udf("array<bigint>")
    def label(values: pd.Series, row: pd.Series, col: pd.Series, width: pd.Series) -> pd.Series:
        stack = np.stack([np.asarray([bool(x) for x in v]).reshape(side, side) for v in values]) if len(values) else np.zeros((0, side, side), bool)
        local = _local_labels(stack).reshape(len(values), -1)
        r, c = local // side, local % side
        ids = (row.to_numpy()[:, None] * side + r) * width.to_numpy()[:, None] + col.to_numpy()[:, None] * side + c + 1
        return pd.Series(list(np.where(local >= 0, ids, 0)))

    return blocks.withColumn("labels", label(F.col(mask), "block_row", "block_col", "width"))


def border_edges(labelled: DataFrame, side: int) -> DataFrame:
    """Label pairs that touch across a block border: raster, a, b."""
    at = lambda i: F.get("labels", i)
    span = F.sequence(F.lit(0), F.lit(side - 1))
    top, left = F.col("block_row") * side, F.col("block_col") * side

    def line(kind, key_r, key_c, index):
        return F.transform(
            span, lambda k: F.struct(F.lit(kind).alias("kind"), key_r(k).cast("bigint").alias("kr"), key_c(k).cast("bigint").alias("kc"), at(index(k)).alias("l"))
        )

    lines = F.concat(
        line(0, lambda k: top + k, lambda k: left, lambda k: k * side),
        line(0, lambda k: top + k, lambda k: left + side, lambda k: k * side + side - 1),
        line(1, lambda k: top, lambda k: left + k, lambda k: k),
        line(1, lambda k: top + side, lambda k: left + k, lambda k: k + side * (side - 1)),
    )
    sides = labelled.select("raster", F.explode(F.filter(lines, lambda s: s["l"] > 0)).alias("s")).select("raster", "s.*")
    met = sides.groupBy("raster", "kind", "kr", "kc").agg(F.min("l").alias("a"), F.max("l").alias("b"))
    return met.filter("a < b").select("raster", "a", "b").distinct()


def least_labels(edges: DataFrame) -> DataFrame:
    """Least reachable label of every label that has an edge: raster, node, root.

    Alternating star operations (large stars, then small stars) shrink every
    component to a star about its least label in a logarithmic number of rounds.
    The stars' centres become hot keys, so their joins are salted. Only a count and
    a checksum come to the driver.
    """
    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("raster", "u", "v"))).first())

    current = materialize(edges.select("raster", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    seen = state(current)
    while seen[0]:
        both = current.unionByName(current.select("raster", F.col("v").alias("u"), F.col("u").alias("v")))
        centre = both.groupBy("raster", "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = salted_join(both.filter("v > u"), centre, ["raster", "u"], ["v"], left_rows=2 * seen[0]).select(
            "raster", F.col("v").alias("u"), F.col("m").alias("v")
        ).distinct()
        low = large.groupBy("raster", "u").agg(F.min("v").alias("m"))
        joined = salted_join(large, low, ["raster", "u"], ["v"], left_rows=2 * seen[0])
        small = joined.filter("v > m").select("raster", F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("raster", "u", F.col("m").alias("v"))
        ).distinct()
        current = materialize(small)
        now = state(current)
        if now == seen:
            break
        seen = now
    return current.select("raster", F.col("u").alias("node"), F.col("v").alias("root"))


def connected_components(blocks: DataFrame, side: int, mask: str = "mask") -> DataFrame:
    """Blocks with ``labels``: the least pixel id (plus one) of the component, 0 outside."""
    labelled = materialize(label_blocks(blocks, side, mask).select(*BLOCK, "width", "labels"))
    roots = least_labels(border_edges(labelled, side))
    # A label lives in one block only, so the map of a block is bounded by the block.
    names = labelled.select(*BLOCK, F.explode(F.array_distinct("labels")).alias("node")).filter("node > 0")
    known = names.join(roots, ["raster", "node"]).groupBy(*BLOCK).agg(
        F.map_from_entries(F.collect_list(F.struct("node", "root"))).alias("_map")
    )
    empty = F.create_map().cast("map<bigint,bigint>")
    joined = labelled.join(known, list(BLOCK), "left").withColumn("_map", F.coalesce("_map", empty))
    named = joined.withColumn("labels", F.transform("labels", lambda l: F.coalesce(F.try_element_at("_map", l), l)))
    # The label blocks are read several times by what follows.
    return materialize(named.drop("_map"))


def min_pixels(pixel_area: Column, min_area_m2: float = 1.0) -> Column:
    """Least number of pixels of an instance."""
    return F.when(pixel_area > 0, F.floor(F.lit(min_area_m2) / pixel_area)).otherwise(0)


def label_sizes(labelled: DataFrame) -> DataFrame:
    """Pixels per label; equal labels are counted inside each task first."""
    return labelled.select("raster", F.explode("labels").alias("label")).filter("label > 0").groupBy("raster", "label").agg(
        F.count(F.lit(1)).alias("n")
    )


def _relabel(labelled: DataFrame, names: DataFrame, new: str) -> DataFrame:
    """Replace labels by a column of ``names``; labels that are not there become 0."""
    present = labelled.select(*BLOCK, F.explode(F.array_distinct("labels")).alias("label")).filter("label > 0")
    # One component may reach over very many blocks: its label is the hot key.
    found = salted_join(present, names.select("raster", "label", new), ["raster", "label"], ["block_row", "block_col"])
    maps = found.groupBy(*BLOCK).agg(F.map_from_entries(F.collect_list(F.struct("label", new))).alias("_map"))
    joined = labelled.join(maps, list(BLOCK), "left").withColumn("_map", F.coalesce("_map", F.create_map().cast("map<bigint,bigint>")))
    named = joined.withColumn(
        "labels", F.transform("labels", lambda l: F.coalesce(F.try_element_at("_map", l), F.lit(0).cast("bigint")))
    )
    return materialize(named.drop("_map"))


def drop_small(labelled: DataFrame, at_least: Column) -> DataFrame:
    """Labels with fewer pixels become background."""
    kept = label_sizes(labelled).filter(F.col("n") >= at_least)
    return _relabel(labelled, kept.withColumn("same", F.col("label")), "same")


def relabel(labelled: DataFrame) -> DataFrame:
    """Labels 1..N per raster in the order of their first pixel."""
    names = label_sizes(labelled).select("raster", "label")
    return _relabel(labelled, numbered(names, ["raster"], ["label"], "rank"), "rank")


# --- polygons ----------------------------------------------------------------

_STEP = ((1, 0), (0, 1), (-1, 0), (0, -1))  # east, south, west, north; y grows downwards


def _halo(labelled: DataFrame, side: int) -> DataFrame:
    """Border labels of the four neighbour blocks: north, south, west, east."""
    pick = lambda f: F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda k: F.get("labels", f(k)))
    sent = F.array(
        F.struct(F.lit("south").alias("side"), (F.col("block_row") - 1).alias("r"), F.col("block_col").alias("c"), pick(lambda k: k).alias("v")),
        F.struct(F.lit("north").alias("side"), (F.col("block_row") + 1).alias("r"), F.col("block_col").alias("c"), pick(lambda k: k + side * (side - 1)).alias("v")),
        F.struct(F.lit("east").alias("side"), F.col("block_row").alias("r"), (F.col("block_col") - 1).alias("c"), pick(lambda k: k * side).alias("v")),
        F.struct(F.lit("west").alias("side"), F.col("block_row").alias("r"), (F.col("block_col") + 1).alias("c"), pick(lambda k: k * side + side - 1).alias("v")),
    )
    got = labelled.select("raster", F.explode(sent).alias("s")).groupBy(
        "raster", F.col("s.r").alias("block_row"), F.col("s.c").alias("block_col")
    ).agg(*[F.first(F.when(F.col("s.side") == d, F.col("s.v")), ignorenulls=True).alias(d) for d in ("north", "south", "west", "east")])
    return labelled.join(got, list(BLOCK), "left")


def _block_paths(labels: np.ndarray, halo: dict, top: int, left: int) -> list[tuple]:
    """Boundary paths of the labels of one block.

    A boundary edge has its label on the right hand. Edges are chained through the
    inner corners of the block; a path ends where it reaches the block's border.
    Gives (label, closed, start point, start direction, end direction, points).
    """
    h, w = labels.shape
    wide = np.zeros((h + 2, w + 2), labels.dtype)
    wide[1:-1, 1:-1] = labels
    for name, view in (("north", wide[0, 1:-1]), ("south", wide[-1, 1:-1]), ("west", wide[1:-1, 0]), ("east", wide[1:-1, -1])):
        if halo[name] is not None:
            view[:] = halo[name]
    inner = wide[1:-1, 1:-1]
    out: dict[tuple, list[int]] = {}
    for d, (other, dx, dy) in enumerate(((wide[:-2, 1:-1], 0, 0), (wide[1:-1, 2:], 1, 0), (wide[2:, 1:-1], 1, 1), (wide[1:-1, :-2], 0, 1))):
        rows, cols = np.nonzero((inner > 0) & (inner != other))
        for r, c in zip(rows.tolist(), cols.tolist()):
            out.setdefault((int(inner[r, c]), c + dx, r + dy), []).append(d)

    def is_border(x, y):
        return x in (0, w) or y in (0, h)

    def follow(label, x, y, d):
        points, first = [(x, y)], (x, y, d)
        while True:
            x, y = x + _STEP[d][0], y + _STEP[d][1]
            points.append((x, y))
            if is_border(x, y):
                return points, d, False
            ways = out[(label, x, y)]
            turn = ways[0] if len(ways) == 1 else (d + 1) % 4
            if (x, y, turn) == first:
                return points, d, True
            ways.remove(turn)
            d = turn

    found = []
    borders = [k for k in out if is_border(k[1], k[2])]
    for label, x, y in borders:
        for d in list(out[(label, x, y)]):
            points, last, _ = follow(label, x, y, d)
            found.append((label, False, d, last, points))
        out[(label, x, y)].clear()
    for (label, x, y), ways in list(out.items()):
        while ways:
            d = ways[0]
            points, last, _ = follow(label, x, y, d)
            ways.remove(d)
            found.append((label, True, d, last, points))
    return [(label, closed, d, last, [(px + left, py + top) for px, py in pts]) for label, closed, d, last, pts in found]


def boundary_paths(labelled: DataFrame, side: int) -> DataFrame:
    """Boundary paths of all blocks: raster, label, closed, d0, d1, x0, y0, x1, y1, xs, ys."""
    schema = (
        "raster bigint, label bigint, closed boolean, d0 int, d1 int, x0 bigint, y0 bigint, x1 bigint, y1 bigint, "
        "xs array<bigint>, ys array<bigint>"
    )
    names = [part.split()[0] for part in schema.split(", ")]

    def run(frames):
        for frame in frames:
            rows = []
            for t in frame.itertuples():
                grid = np.asarray(t.labels).reshape(side, side)
                halo = {d: getattr(t, d) for d in ("north", "south", "west", "east")}
                for label, closed, d0, d1, pts in _block_paths(grid, halo, t.block_row * side, t.block_col * side):
                    rows.append((t.raster, label, closed, d0, d1, *pts[0], *pts[-1], [p[0] for p in pts], [p[1] for p in pts]))
            yield pd.DataFrame(rows, columns=names)

    visible = _halo(labelled, side).filter(F.exists("labels", lambda l: l > 0))
    return visible.select(F.col("raster").cast("bigint").alias("raster"), "block_row", "block_col", "labels", "north", "south", "west", "east").mapInPandas(run, schema)


def ordered_paths(paths: DataFrame) -> DataFrame:
    """Paths with their ring and place: adds ring (least path key of the ring) and place (0..).

    Open paths form circular lists. Pointer doubling finds the least key of each
    ring and then the distance to it, in rounds logarithmic in the paths per ring.
    """
    key = lambda x, y, d: F.format_string("%d:%d:%d", y, x, d)
    keyed = materialize(paths.withColumn("key", key(F.col("x0"), F.col("y0"), F.col("d0"))))
    ready = keyed.filter("closed").withColumn("ring", F.col("key")).withColumn("place", F.lit(0).cast("bigint"))
    opened = keyed.filter("NOT closed")
    starts = opened.groupBy("raster", "label", F.col("x0").alias("x1"), F.col("y0").alias("y1")).agg(F.collect_list("d0").alias("_ways"))
    turn = F.when(F.size("_ways") == 1, F.get("_ways", F.lit(0))).otherwise((F.col("d1") + 1) % 4)
    linked = opened.join(starts, ["raster", "label", "x1", "y1"]).select(
        "raster", "label", "key", key(F.col("x1"), F.col("y1"), turn).alias("next")
    )
    on = ["raster", "label", "next"]
    jump = materialize(linked.withColumn("least", F.least("key", "next")))
    while True:
        ahead = jump.select("raster", "label", F.col("key").alias("next"), F.col("next").alias("_n"), F.col("least").alias("_l"))
        step = materialize(
            jump.join(ahead, on).select(
                "raster", "label", "key", F.col("_n").alias("next"), F.least("least", "_l").alias("least"),
                (F.col("_l") < F.col("least")).alias("moved"),
            )
        )
        moved = not step.filter("moved").isEmpty()
        jump = step.drop("moved")
        if not moved:
            break
    # The least key of a ring is its head; count the steps from each path to the head.
    rank = linked.join(jump.select("raster", "label", "key", F.col("least").alias("ring")), ["raster", "label", "key"])
    rank = materialize(rank.withColumn("next", F.when(F.col("next") != F.col("ring"), F.col("next"))).withColumn("left_over", F.when(F.col("next").isNotNull(), 1).otherwise(0).cast("bigint")))
    while not rank.filter("next IS NOT NULL").isEmpty():
        ahead = rank.select("raster", "label", F.col("key").alias("next"), F.col("next").alias("_n"), F.col("left_over").alias("_d"))
        rank = materialize(
            rank.join(ahead, on, "left").select(
                "raster", "label", "key", "ring", F.col("_n").alias("next"), (F.col("left_over") + F.coalesce("_d", F.lit(0))).alias("left_over")
            )
        )
    totals = rank.groupBy("raster", "label", "ring").agg(F.max("left_over").alias("_t"))
    placed = rank.join(totals, ["raster", "label", "ring"]).select("raster", "label", "key", "ring", (F.col("_t") - F.col("left_over")).alias("place"))
    return ready.unionByName(opened.join(placed, ["raster", "label", "key"]).select(*ready.columns))


def polygonize(labelled: DataFrame, side: int) -> DataFrame:
    """One polygon per label in pixel corners: raster, label, geom; outer ring first, then holes.

    Points inside straight runs are left out. A ring is one array, as a feature's
    geometry is one row; ``ordered_paths`` has the same rings in rows.
    """
    ordered = ordered_paths(boundary_paths(labelled, side))
    points = F.zip_with("xs", "ys", geo.point)
    rings = ordered.withColumn("pts", points).groupBy("raster", "label", "ring").agg(
        F.array_sort(F.collect_list(F.struct("place", "pts"))).alias("parts")
    )
    joined = F.flatten(F.transform("parts", lambda p: F.slice(p["pts"], 1, F.size(p["pts"]) - 1)))

    def corners(ring):
        n = F.size(ring)

        def bends(p, i):
            before, after = F.get(ring, (i + n - 1) % n), F.get(ring, (i + 1) % n)
            return (p["x"] - before["x"]) * (after["y"] - p["y"]) != (p["y"] - before["y"]) * (after["x"] - p["x"])

        return F.filter(ring, bends)

    closed = geo.let(geo.let(joined, corners), lambda r: F.concat(r, F.slice(r, 1, 1)))
    flat = rings.select("raster", "label", closed.alias("ring")).withColumn("_area", geo.signed_ring_area(F.col("ring")))
    per = flat.groupBy("raster", "label").agg(F.array_sort(F.collect_list(F.struct((-F.col("_area")).alias("a"), "ring"))).alias("rings"))
    return per.select("raster", "label", F.array(F.transform("rings", lambda r: r["ring"])).alias("geom"))


def dissolve(parts: DataFrame, keys: Sequence[str], order: str, attributes: Sequence[str]) -> DataFrame:
    """One feature per key: first attributes, all polygons of its (disjoint) parts.

    The polygons of a key become one row, as one feature; ``dissolve_rows`` is for
    keys whose parts are not bounded.
    """
    ordered = F.array_sort(F.collect_list(F.struct(order, "geom")))
    firsts = F.min_by(F.struct(*attributes), order)
    per = parts.groupBy(*keys).agg(firsts.alias("_a"), F.flatten(F.transform(ordered, lambda p: p["geom"])).alias("geom"))
    return per.select(*keys, "_a.*", "geom")


def dissolve_rows(parts: DataFrame, keys: Sequence[str], order: str, attributes: Sequence[str]) -> DataFrame:
    """Like ``dissolve`` for keys with any number of parts: one row per polygon, numbered per key."""
    firsts = parts.groupBy(*keys).agg(F.min_by(F.struct(*attributes), order).alias("_a"))
    polygons = parts.select(*keys, order, F.posexplode("geom").alias("_i", "polygon"))
    placed = numbered(polygons, keys, [order, "_i"], "part").drop("_i")
    return salted_join(placed, firsts, keys, [order, "part"]).select(*keys, "_a.*", "part", "polygon")


def instances_to_features(labelled: DataFrame, side: int, transform: Column, epsg: int, class_name: str, scores: DataFrame | None = None) -> DataFrame:
    """Label blocks to features: instance id, class, score, area in square meters, lon/lat geometry."""
    polygons = polygonize(labelled, side).withColumn("_t", transform)
    world = geo.map_points(F.col("geom"), lambda p: geo.pixel_to_world(p["y"], p["x"], F.col("_t")))
    placed = polygons.withColumn("geom", world).drop("_t").withColumn("area_m2", geo.planar_area(F.col("geom")))
    if scores is not None:
        placed = placed.join(scores.select("raster", "label", "score"), ["raster", "label"], "left")
    else:
        placed = placed.withColumn("score", F.lit(None).cast("double"))
    return placed.select(
        "raster", F.col("label").alias("instance_id"), F.lit(class_name).alias("class"), "score", "area_m2",
        geo.to_lonlat(F.col("geom"), epsg, 8).alias("geom"),
    )
