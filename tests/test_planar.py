"""Overlay, validity and true clipping against counted pixels and sampled points."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytable.functions import geometry as geo
from skytable.functions import planar
from skytable.operators import features as feat
from skytable.operators import footprints as foot


def area(polygons):
    return sum(abs(planar._twice_area(r[:-1])) / 2 * (-1 if k else 1) for p in polygons for k, r in enumerate(p))


def parts(mask):
    """Parts of a mask whose pixels share sides."""
    left, n = {tuple(map(int, p)) for p in zip(*np.nonzero(mask))}, 0
    while left:
        n, stack = n + 1, [left.pop()]
        while stack:
            r, c = stack.pop()
            for p in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if p in left:
                    left.remove(p)
                    stack.append(p)
    return n


def squares(mask):
    return [[(c, r), (c + 1, r), (c + 1, r + 1), (c, r + 1), (c, r)] for r, c in zip(*np.nonzero(mask))]


def test_pixels_and_their_clips():
    rng = np.random.default_rng(0)
    for _ in range(120):
        mask = rng.random((9, 9)) < rng.choice([0.3, 0.5, 0.7])
        shape = planar.overlay(squares(mask))
        assert area(shape) == pytest.approx(mask.sum()) and len(shape) == parts(mask)
        x0, x1 = sorted(rng.integers(0, 10, 2))
        y0, y1 = sorted(rng.integers(0, 10, 2))
        if x0 < x1 and y0 < y1:
            clip = planar.overlay([r for p in shape for r in p], (x0, y0, x1, y1))
            assert area(clip) == pytest.approx(mask[y0:y1, x0:x1].sum()) and len(clip) == parts(mask[y0:y1, x0:x1])
        assert planar.holes_fit(shape)


def test_crossing_rings_become_simple():
    rng = np.random.default_rng(1)
    for _ in range(150):
        ring = [tuple(map(float, q)) for q in rng.integers(0, 12, (rng.integers(4, 9), 2))]
        ring.append(ring[0])
        shape = planar.overlay([ring])
        assert all(planar.is_simple([r]) for p in shape for r in p) and planar.holes_fit(shape)
        for x, y in rng.random((60, 2)) * 12:
            inside = sum(planar._contains(r[:-1], x, y) for p in shape for r in p) % 2 == 1
            assert inside == planar._contains(ring[:-1], x, y)


def test_validity():
    square = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    assert planar.is_simple([square]) and not planar.is_simple([[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]])
    assert not planar.is_simple([[(0, 0), (1, 0), (3, 0), (1, 0), (1, 1), (0, 0)]])
    assert not planar.is_simple([[(0, 0), (1, 0), (1, 0), (1, 1), (0, 0)]]) and not planar.is_simple([[(0, 0), (1, 1), (0, 0)]])
    assert not planar.holes_fit([[square, [(5, 5), (6, 5), (6, 6), (5, 5)]]])


def column(spark, rows):
    return spark.createDataFrame([(k, [[[(float(x), float(y)) for x, y in r] for r in p] for p in g] if g is not None else None) for k, g in rows], f"id int, geom {geo.GEOMETRY}")


def test_make_valid(spark):
    bow = [[[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]]]
    square = [[[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]]]
    flat = [[[(0, 0), (4, 0), (0, 0)]]]
    outside = [[square[0][0], [(3, 3), (6, 3), (6, 6), (3, 6), (3, 3)]]]
    df = column(spark, [(1, bow), (2, square), (3, flat), (4, None), (5, outside), (6, [])])
    rows = df.select("id", foot.make_valid(F.col("geom")).alias("v")).select("id", F.size("v.geom").alias("n"), geo.planar_area(F.col("v.geom")).alias("a"), "v.reason").collect()
    assert {tuple(r) for r in rows} == {
        (1, 2, 2.0, "repaired"), (2, 1, 16.0, None), (3, None, None, "no area"), (4, None, None, "no geometry"), (5, 2, 23.0, "repaired"), (6, 0, 0.0, None)
    }


def test_clip_gives_true_parts(spark):
    u = [[[(0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6), (0, 0)]]]
    bow = [[[(0, 0), (6, 6), (6, 0), (0, 6), (0, 0)]]]
    box = [[[(0, 4), (6, 4), (6, 8), (0, 8), (0, 4)]]]
    away = [[[(10, 10), (11, 10), (10, 11), (10, 10)]]]
    df = column(spark, [(1, u), (2, bow), (3, box), (4, away)]).withColumns({"area_m2": F.lit(1.0), "geom_type": F.lit("Polygon"), "_note": F.lit("x")})
    got = feat.clip_features(df, *[F.lit(v) for v in (0.0, 3.0, 6.0, 5.0)])
    assert got.columns == df.columns
    rows = {r.id: (r.n, round(r.a, 9), r.geom_type, r.area_m2 > 1) for r in got.select("id", F.size("geom").alias("n"), geo.planar_area(F.col("geom")).alias("a"), "geom_type", "area_m2").collect()}
    # The upper half of the bow tie's two lobes, up to y = 5, is two trapezoids that meet in the middle.
    assert rows == {1: (2, 8.0, "MultiPolygon", True), 2: (2, 8.0, "MultiPolygon", True), 3: (1, 6.0, "Polygon", True)}


def test_thinning_never_crosses():
    rng = np.random.default_rng(3)
    for tolerance in (0.8, 1.5, 4.0):
        for _ in range(60):
            mask = rng.random((12, 12)) < rng.choice([0.5, 0.7, 0.85])
            shape = planar.overlay(squares(mask))
            rings = [r for p in shape for r in p]
            if not rings:
                continue
            thin = planar.thinned(rings, tolerance)
            again = iter(thin)
            polygons = [[[tuple(q) for q in next(again).tolist()] for _ in p] for p in shape]
            # Pixel polygons may touch at corners, so crossings are looked for ring by ring and pair by pair.
            assert all(planar.is_simple([r]) for p in polygons for r in p)
            whole = planar.overlay([r for p in polygons for r in p])
            assert area(whole) == pytest.approx(sum(area([p]) for p in polygons))
            assert sum(map(len, thin)) <= sum(map(len, rings))
            for old, new in zip(rings, thin):
                a, b = new[:-1], new[1:]
                for x, y in old:
                    t = np.clip((((x, y) - a) * (b - a)).sum(axis=1) / ((b - a) ** 2).sum(axis=1), 0, 1)
                    assert np.sqrt(((a + t[:, None] * (b - a) - (x, y)) ** 2).sum(axis=1)).min() <= tolerance + 1e-9


def test_few_points_give_what_arrays_give(monkeypatch):
    """Small geometries take a way of their own: it finds the same crossings and thins to the same rings."""
    rng = random.Random(7)
    seen = set()
    for k in range(400):
        n = rng.randrange(3, 9)
        ring = [(float(rng.randrange(6)), float(rng.randrange(6))) for _ in range(n)]
        hole = [(10.0 + rng.randrange(3), float(rng.randrange(3))) for _ in range(3)]
        rings = [[*ring, ring[0]], [*hole, hole[0]]][: 1 + k % 2]
        small = planar.is_simple(rings)
        with monkeypatch.context() as m:
            m.setattr(planar, "_FEW", 0)
            assert small == planar.is_simple(rings), rings
        seen.add(small)
    assert seen == {True, False}
    for k in range(40):
        rings = [jagged(rng, 12 + k, 20.0, 5.0), jagged(rng, 6 + k % 20, 12.0, 4.0)]
        small = planar.thinned(rings, 2.0)
        with monkeypatch.context() as m:
            m.setattr(planar, "_SMALL", 0)
            arrays = planar.thinned(rings, 2.0)
        assert [r.tolist() for r in small] == [r.tolist() for r in arrays]


def jagged(rng, corners, reach, spread):
    ring = [((reach + rng.random() * spread) * np.cos(a), (reach + rng.random() * spread) * np.sin(a)) for a in np.arange(corners) * 2 * np.pi / corners]
    return np.array([*ring, ring[0]])
