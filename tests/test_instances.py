"""Components, polygons, splitting and suppression against brute force on small grids."""

from collections import Counter, deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skytable.functions import geometry as geo
from skytable.operators import components as comp
from skytable.operators import detections as det
from skytable.operators import footprints as foot
from skytable.operators import splitting

SIDE = 4


def blocks_of(spark, mask, parts=3):
    h, w = mask.shape
    rows = [
        (7, r, c, w, [bool(v) for v in mask[r * SIDE:(r + 1) * SIDE, c * SIDE:(c + 1) * SIDE].ravel()])
        for r in range(h // SIDE) for c in range(w // SIDE)
    ]
    schema = "raster bigint, block_row int, block_col int, width bigint, mask array<boolean>"
    return spark.createDataFrame(rows, schema).repartition(parts)


def brute_labels(mask):
    h, w = mask.shape
    labels = np.zeros((h, w), int)
    for r in range(h):
        for c in range(w):
            if mask[r, c] and not labels[r, c]:
                queue = deque([(r, c)])
                labels[r, c] = r * w + c + 1
                while queue:
                    y, x = queue.popleft()
                    for ny, nx in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                        if 0 <= ny < h and 0 <= nx < w and mask[ny, nx] and not labels[ny, nx]:
                            labels[ny, nx] = labels[r, c]
                            queue.append((ny, nx))
    return labels


def grid(df, shape, column):
    out = np.zeros(shape, int)
    for row in df.collect():
        out[row["r"], row["c"]] = row[column]
    return out


@pytest.fixture(scope="module")
def mask():
    m = np.random.default_rng(3).random((24, 32)) < 0.62
    m[5:18, 6:25] |= np.add.outer(np.arange(13), np.arange(19)) % 5 > 0
    return m


def test_components_equal_brute_force_for_any_partitioning(spark, mask):
    want = brute_labels(mask)
    for parts in (1, 16):
        labelled = comp.connected_components(blocks_of(spark, mask, parts), SIDE)
        assert (grid(comp.block_pixels(labelled, "labels", SIDE), mask.shape, "labels") == want).all()


def test_a_long_snake_is_one_component(spark):
    m = np.zeros((16, 16), bool)
    m[::2] = True
    m[1::4, 15] = True
    m[3::4, 0] = True
    labelled = comp.connected_components(blocks_of(spark, m), SIDE)
    assert set(np.unique(grid(comp.block_pixels(labelled, "labels", SIDE), m.shape, "labels"))) == {0, 1}


def test_small_parts_go_and_ranks_are_dense(spark, mask):
    want = brute_labels(mask)
    sizes = Counter(want[want > 0].tolist())
    kept = sorted(k for k, n in sizes.items() if n >= 5)
    labelled = comp.relabel(comp.drop_small(comp.connected_components(blocks_of(spark, mask), SIDE), F.lit(5)))
    got = grid(comp.block_pixels(labelled, "labels", SIDE), mask.shape, "labels")
    expected = np.zeros_like(want)
    for rank, label in enumerate(kept, start=1):
        expected[want == label] = rank
    assert (got == expected).all()


def fill(polygon, shape):
    """Pixels whose centre lies inside by the even-odd rule over all rings."""
    inside = np.zeros(shape, bool)
    for r in range(shape[0]):
        for c in range(shape[1]):
            y, x, hits = r + 0.5, c + 0.5, 0
            for ring in polygon:
                for p, q in zip(ring[:-1], ring[1:]):
                    if (p["y"] > y) != (q["y"] > y):
                        hits += x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]
            inside[r, c] = hits % 2
    return inside


def test_polygons_cover_exactly_their_pixels(spark, mask):
    want = brute_labels(mask)
    labelled = comp.connected_components(blocks_of(spark, mask), SIDE)
    rows = comp.polygonize(labelled, SIDE).withColumn("area", geo.planar_area(F.col("geom"))).collect()
    assert {r["label"] for r in rows} == set(np.unique(want[want > 0]))
    for row in rows:
        assert row["area"] == (want == row["label"]).sum()
        assert (fill(row["geom"][0], mask.shape) == (want == row["label"])).all()


def test_distances_equal_brute_force(spark, mask):
    frame = pd.DataFrame([(1, r, c, bool(mask[r, c])) for r in range(mask.shape[0]) for c in range(mask.shape[1])], columns=["raster", "r", "c", "on"])
    got = splitting.squared_distances(spark.createDataFrame(frame)).toPandas()
    off = np.argwhere(~mask)
    for row in got.itertuples():
        assert row.d2 == ((off - [row.r, row.c]) ** 2).sum(axis=1).min()


def test_two_discs_with_a_bridge_become_two(spark):
    y, x = np.mgrid[0:24, 0:40]
    m = ((y - 11) ** 2 + (x - 10) ** 2 <= 64) | ((y - 11) ** 2 + (x - 29) ** 2 <= 64) | ((abs(y - 11) <= 1) & (x > 10) & (x < 29))
    labels = brute_labels(m)
    frame = pd.DataFrame(
        [(1, r, c, r * 40 + c + 1, bool(m[r, c]), int(labels[r, c])) for r in range(24) for c in range(40)],
        columns=["raster", "r", "c", "id", "on", "label"],
    )
    got = grid(splitting.split_touching(spark.createDataFrame(frame)), m.shape, "label")
    assert ((got > 0) == m).all()
    assert len(np.unique(got[m])) == 2
    assert got[11, 10] != got[11, 29]
    assert len(np.unique(got[:, :16][m[:, :16]])) == 1


def random_boxes(n, seed, size=300):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, size, n), rng.integers(0, size, n)
    w, h = rng.integers(5, 60, n), rng.integers(5, 60, n)
    frame = pd.DataFrame({"det_id": np.arange(n), "image_id": rng.integers(0, 2, n), "cls": rng.choice(["a", "b"], n), "score": rng.integers(0, 20, n) / 20.0})
    frame["xmin"], frame["ymin"], frame["xmax"], frame["ymax"] = x * 1.0, y * 1.0, (x + w) * 1.0, (y + h) * 1.0
    copies = frame.iloc[: n // 3].assign(det_id=np.arange(n, n + n // 3))
    pile = frame.iloc[[0] * (n // 2)].assign(det_id=np.arange(2 * n, 2 * n + n // 2), score=0.5)
    return pd.concat([frame, copies, pile])


def brute_iou(a, b):
    w = max(0.0, min(a.xmax, b.xmax) - max(a.xmin, b.xmin))
    h = max(0.0, min(a.ymax, b.ymax) - max(a.ymin, b.ymin))
    area = lambda t: (t.xmax - t.xmin) * (t.ymax - t.ymin)
    return w * h / (area(a) + area(b) - w * h)


def brute_nms(frame, threshold):
    kept = []
    for box in sorted(frame.itertuples(), key=lambda b: (-b.score, b.det_id)):
        if all((k.image_id, k.cls) != (box.image_id, box.cls) or brute_iou(k, box) <= threshold for k in kept):
            kept.append(box)
    return {k.det_id for k in kept}


@pytest.mark.parametrize("threshold,cell_boxes", [(0.5, 256), (0.5, 3), (0.3, 4)])
def test_suppression_equals_the_greedy_loop(spark, threshold, cell_boxes):
    frame = random_boxes(160, 5)
    got = det.nms(spark.createDataFrame(frame).repartition(5), threshold, cell_boxes).toPandas()
    assert set(got["det_id"]) == brute_nms(frame, threshold)
    assert len(got) == got["det_id"].nunique()


def crowded_boxes(n=1500):
    rng = np.random.default_rng(11)
    x, y, w, h = rng.integers(0, 460, n), rng.integers(0, 420, n), rng.integers(40, 60, n), rng.integers(66, 90, n)
    return pd.DataFrame({
        "det_id": np.arange(n), "image_id": 0, "cls": "a", "score": rng.permutation(n) / n,
        "xmin": x * 1.0, "ymin": y * 1.0, "xmax": (x + w) * 1.0, "ymax": (y + h) * 1.0,
    })


def test_crowded_boxes_need_no_thinning(spark, monkeypatch):
    """Cells are as large as the cores of boxes, so this crowd fills none of them."""
    calls = []
    thin = det._thin
    monkeypatch.setattr(det, "_thin", lambda *args: calls.append(args) or thin(*args))
    frame = crowded_boxes()
    got = det.nms(spark.createDataFrame(frame)).toPandas()
    assert not calls
    assert set(got["det_id"]) == brute_nms(frame, 0.5)


def test_cells_hold_few_pairs_that_do_not_overlap(spark):
    sizes = det._registered(spark.createDataFrame(crowded_boxes()), 0.5).groupBy(*det.CELL).count()
    assert sizes.selectExpr("sum(count * count)").first()[0] < 500_000


@pytest.mark.parametrize("threshold", [0.5, 0.25])
def test_overlap_pairs_equal_brute_force(spark, threshold):
    frame = random_boxes(90, 8)
    distinct = frame.groupby(["image_id", "cls", "xmin", "ymin", "xmax", "ymax"], as_index=False).agg(det_id=("det_id", "min"), n=("det_id", "size"))
    rows = list(distinct.itertuples())
    want = {
        (min(a.det_id, b.det_id), max(a.det_id, b.det_id))
        for i, a in enumerate(rows) for b in rows[i + 1:]
        if (a.image_id, a.cls) == (b.image_id, b.cls) and brute_iou(a, b) > threshold
    } | {(a.det_id, a.det_id) for a in rows if a.n > 1}
    got = det.box_iou_pairs(spark.createDataFrame(frame), threshold).toPandas()
    assert {(a, b) for a, b in zip(got["id_a"], got["id_b"])} == want
    assert len(got) == len(want)


@pytest.mark.parametrize("limits", [{"TILE_BOXES": 40}, {"CHUNK_ROWS": 50, "CHUNK_PAIRS": 7}, {"TILE_CELLS": 1}])
def test_pairs_do_not_depend_on_tiles_and_chunks(spark, monkeypatch, limits):
    """Tiles that are too full go to cells; tiles may come in pieces and pairs in small parts."""
    frame = crowded_boxes(400).assign(image_id=lambda f: f.det_id % 2)
    wide = random_boxes(60, 3).assign(det_id=lambda f: f.det_id + 1000)
    boxes = spark.createDataFrame(pd.concat([frame, wide], ignore_index=True)[frame.columns.tolist()].astype({"image_id": str}))
    want = det.box_iou_pairs(boxes, 0.3).toPandas()
    for name, value in limits.items():
        monkeypatch.setattr(det, name, value)
    got = det.box_iou_pairs(boxes, 0.3).toPandas()
    order = ["id_a", "id_b", "n_a", "n_b", "iou"]
    assert len(want) > 500 and got.sort_values(order, ignore_index=True).equals(want.sort_values(order, ignore_index=True))


def test_boxes_travel_to_tiles_and_not_to_every_cell(spark):
    boxes = spark.createDataFrame(crowded_boxes())
    tiles, cells = det._tiled(boxes, 0.5).count(), det._registered(boxes, 0.5).count()
    assert tiles <= 2.2 * 1500 and 1.5 * tiles < cells, (tiles, cells)


def test_simplify_bounds_the_vertices_and_stays_near():
    t = np.linspace(0, 2 * np.pi, 400)
    ring = [[100 * np.cos(a), 100 * np.sin(a)] for a in t[:-1]]
    ring.append(ring[0])
    thin = foot.simplify_polygons([[ring]], 0.01, 50)[0][0]
    assert len(thin) <= 50 and thin[0] == thin[-1]
    assert abs(abs(foot._ring_area(np.asarray(thin))) / (np.pi * 1e4) - 1) < 0.05


def test_repair_keeps_holes_with_their_ring():
    outer = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]
    hole = [[2, 2], [2, 4], [4, 4], [4, 2], [2, 2]]
    fixed = foot.repair_polygons([[outer, hole]])
    assert len(fixed) == 1 and len(fixed[0]) == 2
    assert foot.repair_polygons([[[[0, 0], [2, 2], [2, 0], [0, 1], [0, 0]]]]) is None


def test_split_of_an_empty_mask(spark):
    schema = "raster long, r int, c int, id long, on boolean, label long"
    assert splitting.split_touching(spark.createDataFrame([], schema)).count() == 0
