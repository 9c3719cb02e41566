"""Golden values of estimates, areas and clipping, and the guards of sources."""

import pytest
from pyspark.sql import functions as F

from skytable.functions import geometry as geo
from skytable.functions import projection as proj
from skytable.operators import estimates
from skytable.operators import features as feat
from skytable.sources import files

SMALL = dict(min_lon=7.610, min_lat=51.950, max_lon=7.611, max_lat=51.951)
LARGE = dict(min_lon=7.60, min_lat=51.90, max_lon=7.70, max_lat=52.00)


def request(spark, box, source):
    return spark.createDataFrame([{**box, "source_type": source}])


@pytest.mark.parametrize(
    "box,source,width,height", [
        (SMALL, "ortho", 780, 1238), (SMALL, "satellite", 26, 42), (SMALL, "sentinel", 8, 13),
        (LARGE, "ortho", 77865, 123739), (LARGE, "sentinel", 779, 1238),
    ],
)
def test_raster_estimates(spark, box, source, width, height):
    row = estimates.estimate_requests(request(spark, box, source)).first()
    assert (row["width_px"], row["height_px"], row["epsg"]) == (width, height, 32632)
    assert row["allowed"] == (source != "ortho" or box is SMALL)


def test_estimate_in_meters(spark):
    row = estimates.estimate_requests(request(spark, SMALL, "ortho")).first()
    assert row["width_m"] == pytest.approx(70.84571925, abs=1e-4)
    assert row["height_m"] == pytest.approx(112.52673464, abs=1e-4)


def test_geodesic_area_of_a_feature(spark):
    box = geo.box_geometry(*[F.lit(v) for v in (7.612, 51.952, 7.618, 51.958)])
    assert spark.range(1).select(geo.geodesic_area(box)).first()[0] == pytest.approx(275372.00, rel=1e-6)


def test_utm_round_trip(spark):
    df = spark.createDataFrame([(lon, lat) for lon in (-179.5, 3.1, 9.0, 14.9) for lat in (-33.3, 0.5, 51.9, 79.0)], "lon double, lat double")
    zone, south = proj.utm_zone(F.col("lon")).cast("double"), F.col("lat") < 0
    x, y = proj.to_utm(F.col("lon"), F.col("lat"), zone, south)
    lon, lat = proj.from_utm(x, y, zone, south)
    for row in df.select("lon", "lat", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert row["lon2"] == pytest.approx(row["lon"], abs=1e-9)
        assert row["lat2"] == pytest.approx(row["lat"], abs=1e-9)


CONCAVE = "POLYGON ((0 0, 6 0, 6 6, 4 6, 4 2, 2 2, 2 6, 0 6, 0 0))"
DONUT = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 2 8, 8 8, 8 2, 2 2))"


@pytest.mark.parametrize(
    "wkt,box,area", [
        (CONCAVE, (0, 3, 6, 5), 8.0), (CONCAVE, (-1, -1, 7, 7), 28.0), (CONCAVE, (7, 7, 8, 8), None),
        (DONUT, (0, 0, 5, 10), 32.0), (DONUT, (1, 1, 9, 9), 28.0), (DONUT, (3, 3, 7, 7), None), (DONUT, (-5, -5, 20, 20), 64.0),
    ],
)
def test_clip(spark, wkt, box, area):
    df = spark.range(1).select(geo.parse_wkt_polygon(F.lit(wkt)).alias("geom"), F.lit(None).cast("double").alias("area_m2"))
    got = feat.clip_features(df, *[F.lit(float(v)) for v in box]).select(geo.planar_area(F.col("geom")).alias("a")).collect()
    if area is None:
        assert got == []
    else:
        assert got[0]["a"] == pytest.approx(area)


def test_wkt_multipolygon(spark):
    text = "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 9 5, 9 9, 5 5), (6 5.5, 7 5.5, 7 6, 6 5.5)))"
    row = spark.range(1).select(geo.parse_wkt_polygon(F.lit(text)).alias("g")).first()["g"]
    assert [len(p) for p in row] == [1, 2]


def test_empty_catalogue_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        files.write_items(spark.createDataFrame([], files.ITEM_SCHEMA), str(tmp_path / "items"))


def test_only_feature_collections_are_read(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"type": "Feature", "features": [{"type": "Feature"}]}')
    with pytest.raises(Exception, match="FeatureCollection"):
        files.read_features(spark, str(tmp_path)).collect()


def test_label_and_confidence_rules(spark):
    df = spark.createDataFrame(
        [(1, {"class": "  ", "keyword": " Straße "}), (2, {"score": "0.9"}), (3, {"confidence": "high", "score": "0.4"})],
        "id int, props map<string,string>",
    )
    p = F.col("props")
    rows = {r["id"]: r for r in df.select("id", feat.feature_label(p).alias("l"), feat.feature_confidence(p).alias("c"), feat.feature_confidence(p, True).alias("f")).collect()}
    assert [rows[i]["l"] for i in (1, 2, 3)] == ["Straße", "annotation", "annotation"]
    assert rows[2]["c"] is None and rows[2]["f"] == 0.9 and rows[3]["c"] is None and rows[3]["f"] == 0.4
    kept = feat.filter_features(df.withColumn("geom_type", F.lit("Polygon")), labels=["STRASSE"])
    assert [r["id"] for r in kept.collect()] == [1]
