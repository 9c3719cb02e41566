"""Burning by runs and blocks against tests of every cell."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skytable.functions import geometry as geo
from skytable.functions import projection as proj
from skytable.functions.planar_batch import packed
from skytable.operators import burn
from skytable.operators import raster as ras

GEOM = geo.GEOMETRY


def touched(rings, r, c):
    """The closed cell meets an edge, or its middle is inside."""
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            t0, t1 = 0.0, 1.0
            for p, d, low, high in ((ax, bx - ax, c, c + 1), (ay, by - ay, r, r + 1)):
                if d == 0:
                    if p < low or p > high:
                        t0, t1 = 1.0, 0.0
                else:
                    u, v = sorted(((low - p) / d, (high - p) / d))
                    t0, t1 = max(t0, u), min(t1, v)
            if t0 <= t1:
                return True
            if (ay > r + 0.5) != (by > r + 0.5) and c + 0.5 < (bx - ax) * (r + 0.5 - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def shape(rng):
    points = [(rng.randrange(-40, 240) / 8, rng.randrange(-40, 240) / 8) for _ in range(rng.choice([3, 4, 6]))]
    rings = [points + points[:1]]
    if rng.random() < 0.3:
        rings.append([(5, 5), (9, 5), (9, 9), (5, 9), (5, 5)])
    return rings


def test_spans_equal_every_cell():
    rng = random.Random(4)
    for _ in range(150):
        rings = shape(rng)
        xs, ys = zip(*[p for r in rings for p in r])
        got = np.zeros((25, 23), bool)
        for r, a, b in zip(*burn.touched_spans(rings, 25, 23)):
            got[r, a : b + 1] = True
        want = np.array([[touched(rings, r, c) and np.floor(min(xs)) <= c <= np.ceil(max(xs)) - 1 and np.floor(min(ys)) <= r <= np.ceil(max(ys)) - 1 for c in range(23)] for r in range(25)])
        assert (got == want).all()


@pytest.mark.parametrize("part", [1 << 16, 3])
def test_blocks_equal_the_cell_form(spark, monkeypatch, part):
    monkeypatch.setattr(burn, "PART_FEATURES", part)
    rng = random.Random(part)
    rows = [(k % 2, k, 1 + k % 5, [[[(x / 10, y / 10) for x, y in r] for r in shape(rng)]], "x") for k in range(40)]
    rows += [(0, 100, 9, None, "x"), (5, 1, 9, rows[0][3], "x")]
    features = spark.createDataFrame(rows, f"query_id long, ord long, value int, geom {GEOM}, part string")
    grid = {"left": 0.0, "top": 2.5, "cell": 0.125, "height": 20, "width": 21}
    grids = spark.createDataFrame([(q, 4326, [0.125, 0.0, 0.0, 0.0, -0.125, 2.5], 20, 21) for q in (0, 1, 7)], "query_id long, epsg int, transform array<double>, height int, width int")
    got = burn.block_cells(burn.rasterize_blocks(features, grids, 8), grids, 8)
    want = {(r.query_id, r.r, r.c): r.value for r in ras.rasterize(features.filter("query_id < 2 AND geom IS NOT NULL"), grid).collect()}
    want |= {(7, r, c): 0 for r in range(20) for c in range(21)}
    assert {(r.query_id, r.r, r.c): r.value for r in got.collect()} == want


def test_each_raster_has_its_system(spark):
    box = [[[(7.612, 51.952), (7.618, 51.952), (7.618, 51.958), (7.612, 51.958), (7.612, 51.952)]]]
    features = spark.createDataFrame([(q, 1, 3, box) for q in (1, 2, 3)], f"query_id long, ord long, value int, geom {GEOM}")
    zone = spark.range(1).select(*proj.to_utm(F.lit(7.61), F.lit(51.96), F.lit(32.0), F.lit(False))).first()
    web = spark.range(1).select(*proj.to_mercator(F.lit(7.61), F.lit(51.96))).first()
    grids = spark.createDataFrame(
        [(1, 4326, [0.001, 0.0, 7.61, 0.0, -0.001, 51.96], 10, 10), (2, 32632, [70.0, 0.0, zone[0], 0.0, -112.0, zone[1]], 10, 10), (3, 3857, [112.0, 0.0, web[0], 0.0, -181.0, web[1]], 10, 10)],
        "query_id long, epsg int, transform array<double>, height int, width int",
    )
    counts = {r.query_id: r.n for r in burn.block_cells(burn.rasterize_blocks(features, grids, 8), grids, 8).filter("value = 3").groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    assert set(counts) == {1, 2, 3} and all(36 <= n <= 64 for n in counts.values())
    wrong = grids.withColumn("epsg", F.lit(1234))
    with pytest.raises(Exception, match="unknown system"):
        burn.rasterize_blocks(features, wrong).collect()
    with pytest.raises(ValueError):
        burn.rasterize_blocks(features, grids, 10)


def test_features_are_burned_in_batches():
    """Runs of many features come in one batch, equal to those of each feature alone."""
    rng = random.Random(5)
    geoms = [[shape(rng)] for _ in range(200)] + [None, [], [[]]]
    n = len(geoms)
    columns = [pa.array([k % 3 for k in range(n)], pa.int64()), pa.array(range(n), pa.int64()), pa.array([k * 7 for k in range(n)], pa.int64()), *[pa.array([v] * n, pa.int32()) for v in (23, 29)], packed(geoms)]
    names = ["query_id", "ord", "value", "height", "width", "geom"]
    run = burn._to_blocks(8)
    whole = list(run(iter([pa.RecordBatch.from_arrays(columns, names=names)])))
    assert len(whole) == 1
    alone = [b for k in range(n) for b in run(iter([pa.RecordBatch.from_arrays([c.slice(k, 1) for c in columns], names=names)]))]
    assert len(alone) > 100 and [r for b in alone for r in b.to_pylist()] == whole[0].to_pylist()


@pytest.mark.parametrize("some", [1, 200, 1 << 19])
def test_blocks_go_on_over_batches(monkeypatch, some):
    monkeypatch.setattr(burn, "SOME_CELLS", some)
    rng, rows = random.Random(6), []
    for key in [(None, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 1), (0, 0, 1, 0), (4, 2, 0, 0)]:
        for order in range(rng.choice([1, 5, 40])):
            spans = [(r << 4) | (min(a, b) << 2) | max(a, b) for r, a, b in ([rng.randrange(4) for _ in range(3)] for _ in range(rng.randrange(4)))]
            rows.append((*key, order, rng.randrange(1, 9), spans))
    want = {}
    for *key, _, value, spans in rows:
        block = want.setdefault(tuple(key), [0] * 16)
        for span in spans:
            for c in range((span >> 2) & 3, (span & 3) + 1):
                block[(span >> 4) * 4 + c] = value
    names = [c.split()[0] for c in burn._SPANS.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    got = [r for b in burn._folded(iter(table.to_batches(max_chunksize=3)), names[:4], 4, burn._paint(4), True) for r in b.to_pylist()]
    assert [(tuple(r[k] for k in names[:4]), r["values"]) for r in got] == list(want.items())
