"""Granules and items whose names or ids are not unique."""

import json
import os

from skytable.operators.catalog import pair_granules
from skytable.streaming import items


def test_a_granule_with_several_rasters_is_paired_once(spark):
    granules = spark.createDataFrame([("T1", "a", 1), ("T1", "a", 2), ("T1", "b", 3)], "tile string, name string, id int")
    rasters = spark.createDataFrame([("T1", "a", "y"), ("T1", "a", "x"), ("T2", "b", "z")], "tile string, name string, path string")
    paired, alone = pair_granules(granules, rasters)
    assert sorted(map(tuple, paired.collect())) == [("T1", "a", 1, "x"), ("T1", "a", 2, "x")]
    assert [tuple(r) for r in alone.collect()] == [("T1", "b", 3)]
    paired, _ = pair_granules(granules, rasters.drop("path"))
    assert sorted(map(tuple, paired.collect())) == [("T1", "a", 1), ("T1", "a", 2)]


def test_of_one_batch_the_later_file_counts(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for name, mark, when in (("a.json", "new", 2_000_000_000), ("b.json", "old", 1_000_000_000)):
        (source / name).write_text(json.dumps({"id": "i", "collection": "c", "properties": {"mark": mark}}) + "\n")
        os.utime(source / name, (when, when))
    items.run_items(spark, str(source), str(tmp_path / "out"), str(tmp_path / "mark"))
    current = items.current_items(spark, str(tmp_path / "out")).collect()
    assert [(r["id"], r["properties"]["mark"]) for r in current] == [("i", "new")]


def test_documents_grow_with_the_features_of_a_query(spark, monkeypatch):
    """15,000 features of 100 queries are 100 documents, not one for each 5,000 numbers of ``ord``."""
    from skytable.plans import all_queries, feature_checks

    paths = []
    read = feature_checks.files.read_features
    monkeypatch.setattr(feature_checks.files, "read_features", lambda s, path: paths.append(path) or read(s, path))
    got = all_queries.QUERIES["src3_read_features"](spark, "/root/testdata/sf0.01")
    assert got.schema.names == ["query_id", "features", "blank"]
    assert read(spark, paths[0]).select("path").distinct().count() == 100


def test_items_are_built_in_many_tasks(spark):
    from skytable.operators.catalog import whole_items
    from skytable.plans import catalog_checks
    from skytable.plans.registry import Inputs

    scenes = catalog_checks.described_scenes(Inputs(spark, "/root/testdata/sf0.001"))
    from pyspark.sql import functions as F

    from skytable.functions import geometry as geo

    extra = {c: F.lit(1) for c in ("epsg", "height", "width", "size")} | {c: F.lit(1.0) for c in ("left", "bottom", "right", "top")}
    placed = scenes.withColumns(extra | {"href": F.lit("h"), "geom": geo.box_geometry(*[F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")])})
    assert whole_items(placed.coalesce(1)).rdd.getNumPartitions() >= 64
