"""Polygons burned into label rasters, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytable.functions import geometry as geo
from skytable.functions import projection
from skytable.functions.planar_batch import Shapes
from skytable.operators.skew import salted_join, spread
from skytable.session import materialize

# Features of one block that are painted in one go; others of it are painted elsewhere and laid over it.
PART_FEATURES = 1 << 16
# Runs of cells, and cells, that a task looks at in one go, about.
SOME_RUNS = 1 << 17
SOME_CELLS = 1 << 19
_NOTHING = np.iinfo(np.int64).min
_SPANS = "query_id long, block_row int, block_col int, part long, ord long, value long, spans array<int>"
_PAINTED = "query_id long, block_row int, block_col int, part long, values array<long>"


def project_to(geom: Column, epsg: Column) -> Column:
    """Lon/lat geometry in the system that each row names: lon/lat, Web Mercator or a UTM zone of WGS 84 or ETRS89."""
    group, zone = F.floor(epsg / 100), F.pmod(epsg, F.lit(100)).cast("double")

    def utm(ellipsoid: str) -> Column:
        def move(p):
            angles = projection.utm_angles(p["x"], p["y"], zone, ellipsoid)
            return geo.let(geo.point(*angles), lambda a: geo.point(*projection.utm_plane(a["x"], a["y"], group == 327, ellipsoid)))

        return geo.map_points(geom, move)

    return (
        F.when(epsg.isin(4326, 4258), geom)
        .when(epsg == 3857, geo.map_points(geom, lambda p: geo.point(*projection.to_mercator(p["x"], p["y"]))))
        .when(group.isin(326, 327) & zone.between(1, 60), utm("WGS84"))
        .when((group == 258) & zone.between(28, 38), utm("GRS80"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown system "), epsg.cast("string"))))
    )


def to_pixels(geom: Column, transform: Column) -> Column:
    """Geometry in columns and rows of a raster by its affine array (a b c d e f)."""
    a, b, c, d, e, f = [F.get(transform, i) for i in range(6)]
    straight = (b == 0) & (d == 0)

    def move(p):
        x, y = p["x"] - c, p["y"] - f
        turn = a * e - b * d
        return geo.point(F.when(straight, x / a).otherwise((e * x - b * y) / turn), F.when(straight, y / e).otherwise((a * y - d * x) / turn))

    return geo.map_points(geom, move)


def touched_spans(rings, height: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, last column) of runs of cells that a polygon touches; runs may lie over one another.

    A cell is touched where an edge meets it or its middle is inside by the even-odd rule; cells that only share a side with the
    polygon's box are not.
    """
    rings = [np.asarray(r, float).reshape(-1, 2) for r in rings]
    edges = np.concatenate([np.concatenate([r[:-1], r[1:]], axis=1) for r in rings] or [np.zeros((0, 4))])
    return _spans(edges, np.zeros(len(edges), np.int64), np.array([height]), np.array([width]))[1:]


def _spans(edges: np.ndarray, owner: np.ndarray, height: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, ...]:
    """(owner, row, first column, last column): ``touched_spans`` of many polygons, whose edges come one after another."""
    none = np.zeros(0, np.int64)
    if not len(edges):
        return none, none, none, none
    if not np.isfinite(edges).all():
        raise ValueError("coordinates must be finite")
    firsts = np.flatnonzero(np.diff(owner, prepend=-1))
    of = np.cumsum(np.diff(owner, prepend=-1) != 0) - 1
    own = owner[firsts]
    (x0, y0), (x1, y1) = np.minimum.reduceat(edges[:, :2], firsts).T, np.maximum.reduceat(edges[:, :2], firsts).T
    top, bottom = np.maximum(np.floor(y0), 0), np.minimum(np.ceil(y1) - 1, height[own] - 1)
    left, right = np.maximum(np.floor(x0), 0), np.minimum(np.ceil(x1) - 1, width[own] - 1)
    # Rows and columns beyond the grid have no numbers.
    use = ((top <= bottom) & (left <= right))[of]
    edges, owner, of = edges[use], owner[use], of[use]
    top, bottom, left, right = (v[of] for v in (top, bottom, left, right))
    flip = edges[:, 1] > edges[:, 3]
    edges[flip] = edges[flip][:, [2, 3, 0, 1]]
    ax, ay, bx, by = edges.T

    def rows_of(first, last):
        some = first <= last
        first, many = np.where(some, first, 0).astype(np.int64), np.where(some, last - first + 1, 0).astype(np.int64)
        k = np.repeat(np.arange(len(edges)), many)
        return k, np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many) + first[k]

    k, row = rows_of(np.maximum(np.ceil(ay) - 1, top), np.minimum(np.floor(by), bottom))
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.where(by > ay, (bx - ax) / (by - ay), 0.0)
    low, high = np.maximum(row, ay[k]), np.minimum(row + 1, by[k])
    u = np.where(by[k] > ay[k], ax[k] + (low - ay[k]) * slope[k], ax[k])
    v = np.where(by[k] > ay[k], ax[k] + (high - ay[k]) * slope[k], bx[k])
    # The ends themselves are exact.
    u, v = np.where(low == ay[k], ax[k], u), np.where(high == by[k], bx[k], v)
    edge_from, edge_to = np.ceil(np.minimum(u, v)) - 1, np.floor(np.maximum(u, v))

    # Middles of rows: sorted crossings come in pairs.
    m, line = rows_of(np.maximum(np.ceil(ay - 0.5), top), np.minimum(np.ceil(by - 0.5) - 1, bottom))
    if (np.bincount(of[m]) % 2).any():
        raise ValueError("rings must be closed")
    x = ax[m] + (line + 0.5 - ay[m]) * slope[m]
    order = np.lexsort((x, line, owner[m]))
    x, m, line = x[order].reshape(-1, 2), m[order][::2], line[order][::2]
    inner_from, inner_to = np.ceil(x[:, 0] - 0.5), np.ceil(x[:, 1] - 0.5) - 1
    k, rows = np.concatenate([k, m]), np.concatenate([row, line])
    start, end = np.maximum(np.concatenate([edge_from, inner_from]), left[k]), np.minimum(np.concatenate([edge_to, inner_to]), right[k])
    kept = start <= end
    return owner[k[kept]], rows[kept], start[kept].astype(np.int64), end[kept].astype(np.int64)


def _pieces(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of items whose sizes add up to about ``limit``, one item at least."""
    total, start = np.cumsum(sizes), 0
    while start < len(total):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + limit, "right")))
        yield start, end
        start = end


def _to_blocks(side: int):
    """Features as runs of cells, one row for each block that a feature touches."""
    bits = side.bit_length() - 1

    def some(batch: pa.RecordBatch, shapes: Shapes, a: int, b: int) -> pa.RecordBatch | None:
        query, order, value, height, width = batch.columns[:5]
        points = np.arange(shapes.first_point[a], shapes.first_point[b])
        ring = np.repeat(np.arange(len(shapes.points) - 1), np.diff(shapes.points))[points]
        inner = np.flatnonzero(ring[:-1] == ring[1:])
        edges = np.concatenate([shapes.xy[points[inner]], shapes.xy[points[inner] + 1]], axis=1)
        feature = np.searchsorted(shapes.first_ring, ring[inner], "right") - 1
        f, rows, start, end = _spans(edges, feature, height.to_numpy(), width.to_numpy())
        if not len(rows):
            return None
        many = (end >> bits) - (start >> bits) + 1
        k = np.repeat(np.arange(len(rows)), many)
        block = np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many) + (start >> bits)[k]
        packed = ((rows[k] & side - 1) << 2 * bits) | ((np.maximum(start[k], block << bits) & side - 1) << bits) | (np.minimum(end[k], (block << bits) + side - 1) & side - 1)
        order_by = np.lexsort((block, rows[k] >> bits, f[k]))
        f, down, across, packed = f[k][order_by], (rows[k] >> bits)[order_by], block[order_by], packed[order_by]
        cuts = np.flatnonzero(np.any([np.diff(c, prepend=-1) != 0 for c in (f, down, across)], axis=0))
        at = pa.array(f[cuts])
        lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(packed)), pa.int32()), pa.array(packed, pa.int32()))
        parts = pa.array(order.to_numpy()[f[cuts]] // PART_FEATURES, pa.int64())
        columns = [query.take(at), pa.array(down[cuts], pa.int32()), pa.array(across[cuts], pa.int32()), parts, order.take(at), value.take(at), lists]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SPANS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = Shapes(batch.column(5))
            # Every edge gives a run in each row of the grid at most.
            sizes = np.diff(shapes.first_point) * (np.minimum(batch.column(3).to_numpy(), _rows_of(shapes)) + 1)
            for a, b in _pieces(sizes, SOME_RUNS):
                if (out := some(batch, shapes, a, b)) is not None:
                    yield out

    return run


def _rows_of(shapes: Shapes) -> np.ndarray:
    """Rows that each geometry reaches over."""
    out = np.zeros(len(shapes.null), np.int64)
    has = np.flatnonzero(np.diff(shapes.first_point))
    if len(has):
        y, at = shapes.xy[:, 1], shapes.first_point[has]
        out[has] = np.minimum(np.nan_to_num(np.maximum.reduceat(y, at) - np.minimum.reduceat(y, at)), 2.0**31)
    return out


def _folded(batches, keys: list[str], side: int, lay, last: bool) -> Iterator[pa.RecordBatch]:
    """One block for each key of rows sorted by it; blocks are painted while their rows come."""
    cells, names = side * side, [c.split()[0] for c in _PAINTED.split(", ")]
    held, block = None, None

    def done(columns: list, values: np.ndarray):
        values = np.where(values == _NOTHING, 0, values) if last else values
        n = len(values)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * cells, pa.int32()), pa.array(values.ravel(), pa.int64()))
        more = [] if "part" in keys else [pa.array(np.zeros(n, np.int64))]
        return pa.RecordBatch.from_arrays([*columns, *more, lists], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for k, c in enumerate(columns):
            # A null is a key of its own.
            for v in (c.fill_null(0).to_numpy(), c.is_null().to_numpy(zero_copy_only=False)):
                new[1:] |= v[1:] != v[:-1]
            new[0] |= held is None or held[k][0].as_py() != c[0].as_py()
        for a, b in _pieces(new.astype(np.int64), max(1, SOME_CELLS // cells)):
            # Block 0 is the one that is held, if there is one.
            run = np.cumsum(new[a:b]) - (held is None)
            grid = np.full((int(run[-1]) + 1, cells), _NOTHING)
            if held is not None:
                grid[0] = block
            lay(grid, run, batch.slice(a, b - a))
            starts = pa.array(a + np.flatnonzero(new[a:b]))
            known = [c.take(starts) if held is None else pa.concat_arrays([h, c.take(starts)]) for c, h in zip(columns, held or columns)]
            if len(grid) > 1:
                yield done([c.slice(0, len(grid) - 1) for c in known], grid[:-1])
            held, block = [c.slice(len(grid) - 1) for c in known], grid[-1]
    if held is not None:
        yield done(held, block[None])


def _paint(side: int):
    """Runs of cells get the value of their row; a later row is painted over those before it."""
    bits = side.bit_length() - 1

    def lay(grid: np.ndarray, run: np.ndarray, batch: pa.RecordBatch) -> None:
        flat, lists = grid.reshape(-1), batch.column("spans")
        spans, values = lists.flatten().to_numpy(), batch.column("value").to_numpy()
        row = np.repeat(np.arange(len(run)), lists.value_lengths().to_numpy())
        first, last = (spans >> bits) & side - 1, spans & side - 1
        at = run[row] * side * side + (spans >> 2 * bits).astype(np.int64) * side + first
        many = (last - first + 1).astype(np.int64)
        for a, b in _pieces(many, SOME_CELLS):
            n = many[a:b]
            k = np.repeat(np.arange(a, b), n)
            # Of several values for one cell the last one stays.
            flat[at[k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)] = values[row[k]]

    return lay


def _lay_over(side: int):
    """Blocks are laid over those before them where they hold something."""

    def lay(grid: np.ndarray, run: np.ndarray, batch: pa.RecordBatch) -> None:
        over = batch.column("values").flatten().to_numpy().reshape(-1, side * side)
        firsts = np.flatnonzero(np.diff(run, prepend=-1))
        depth = np.arange(len(run)) - np.repeat(firsts, np.diff(np.append(firsts, len(run))))
        for a, b in _pieces(np.full(len(run), side * side), SOME_CELLS):
            for d in np.unique(depth[a:b]):
                rows = a + np.flatnonzero(depth[a:b] == d)
                grid[run[rows]] = np.where(over[rows] != _NOTHING, over[rows], grid[run[rows]])

    return lay


def rasterize_blocks(features: DataFrame, grids: DataFrame, side: int = 64) -> DataFrame:
    """(query_id, block_row, block_col, values): label blocks of ``side`` x ``side`` cells for every grid, background 0.

    Features have query_id, ``geom`` in lon/lat, value and ord; grids have query_id (one row each), epsg, the affine array ``transform``, height
    and width. Every touched cell gets the value of the feature that comes last by ord, then by value. Polygons become runs of
    cells, only the runs travel, and a block is painted in the order of its features without holding them. The features of a crowded block
    are painted in parts by ord and the parts laid over one another. Features without a grid or a geometry burn nothing.
    """
    if side < 2 or side & (side - 1):
        raise ValueError("the side must be a power of two")
    shapes = features.filter("geom IS NOT NULL AND value IS NOT NULL AND ord IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.col("ord").cast("long").alias("ord"), F.col("value").cast("long").alias("value"), "geom")
    known = grids.select(F.col("query_id").cast("long").alias("query_id"), "epsg", F.col("transform").cast("array<double>").alias("transform"), F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"))
    placed = spread(salted_join(shapes, known, ["query_id"], ["ord"]), "query_id", "ord")
    pixels = to_pixels(project_to(F.col("geom"), F.col("epsg")), F.col("transform")).cast(geo.GEOMETRY)
    runs = placed.select("query_id", "ord", "value", "height", "width", pixels.alias("geom")).mapInArrow(_to_blocks(side), _SPANS)
    blocks = lambda n: F.sequence(F.lit(0), F.floor((F.col(n) - 1) / side).cast("int"))
    empty = (
        known.filter("height > 0 AND width > 0")
        .select("query_id", F.explode(blocks("height")).alias("block_row"), "width")
        .select("query_id", "block_row", F.explode(blocks("width")).alias("block_col"))
        .select("query_id", "block_row", "block_col", F.lit(-(2**62)).alias("part"), F.lit(-(2**62)).alias("ord"), F.lit(0).cast("long").alias("value"), F.array().cast("array<int>").alias("spans"))
    )
    part = ["query_id", "block_row", "block_col", "part"]
    parts = runs.unionByName(empty).repartition(*part).sortWithinPartitions(*part, "ord", "value")
    painted = parts.mapInArrow(lambda batches: _folded(batches, part, side, _paint(side), False), _PAINTED)
    whole = painted.repartition(*part[:3]).sortWithinPartitions(*part)
    return whole.mapInArrow(lambda batches: _folded(batches, part[:3], side, _lay_over(side), True), _PAINTED).drop("part")


def block_cells(blocks: DataFrame, grids: DataFrame, side: int = 64) -> DataFrame:
    """(query_id, r, c, value): the cells of blocks that lie in their grid."""
    # The join counts the blocks before it reads them.
    sized = salted_join(materialize(blocks), grids.select(F.col("query_id").cast("long").alias("query_id"), "height", "width"), ["query_id"], ["block_row", "block_col"])
    cells = sized.select("query_id", "block_row", "block_col", "height", "width", F.posexplode("values").alias("place", "value"))
    row, col = F.col("block_row") * side + F.floor(F.col("place") / side), F.col("block_col") * side + F.col("place") % side
    return cells.select("query_id", row.cast("int").alias("r"), col.cast("int").alias("c"), "value", "height", "width").filter("r < height AND c < width").drop("height", "width")
