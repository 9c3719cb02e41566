"""Helpers for hot keys give what plain Spark or pandas gives."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from skytable.operators import skew


def hot_table(spark, n=900):
    rng = np.random.default_rng(1)
    keys = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 12, n))
    frame = pd.DataFrame({"k": keys, "o": rng.permutation(n), "v": rng.integers(-50, 50, n).astype(float)})
    frame.loc[rng.random(n) < 0.2, "v"] = None
    return frame, spark.createDataFrame(frame.replace({np.nan: None})).repartition(7)


def test_prefix_scan_equals_pandas(spark):
    frame, df = hot_table(spark)
    want = frame.sort_values(["k", "o"])
    grouped = want.groupby("k")["v"]
    want = want.assign(s=grouped.transform(lambda v: v.fillna(0).cumsum()), m=grouped.transform(lambda v: v.cummax().ffill()), l=grouped.ffill())
    got = skew.prefix_scan(
        df, ["k"], ["o"], {"s": ("sum", F.coalesce("v", F.lit(0.0))), "m": ("max", F.col("v")), "l": ("last", F.col("v"))}
    ).toPandas().sort_values(["k", "o"])
    for column in ("s", "m", "l"):
        np.testing.assert_allclose(got[column].to_numpy(float), want[column].to_numpy(float), equal_nan=True)


def test_prefix_scan_exclusive_starts_empty(spark):
    frame, df = hot_table(spark)
    got = skew.prefix_scan(df, ["k"], ["o"], {"m": ("max", F.col("v"))}, inclusive=False).toPandas().sort_values(["k", "o"])
    want = frame.sort_values(["k", "o"]).groupby("k")["v"].transform(lambda v: v.cummax().ffill().shift(1))
    np.testing.assert_allclose(got["m"].to_numpy(float), want.to_numpy(float), equal_nan=True)


def test_numbered_without_keys(spark):
    df = spark.range(500).withColumn("x", F.hash("id")).repartition(5)
    got = skew.numbered(df, [], ["x", "id"]).orderBy("rn").toPandas()
    assert got["rn"].tolist() == list(range(1, 501))
    assert got["x"].is_monotonic_increasing


def test_salted_join_equals_plain_join(spark):
    _, df = hot_table(spark)
    right = spark.range(8).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = df.join(right, ["k"], how)
        salted = skew.salted_join(df, right, ["k"], ["o"], how, hot_rows=50)
        order = ["k", "o"]
        pd.testing.assert_frame_equal(
            plain.toPandas().sort_values(order).reset_index(drop=True),
            salted.select(*plain.columns).toPandas().sort_values(order).reset_index(drop=True),
        )


def test_first_by_takes_whole_rows(spark):
    frame, df = hot_table(spark)
    got = skew.first_by(df, ["k"], [F.col("o")]).toPandas().sort_values("k")
    want = frame.sort_values("o").groupby("k").head(1).sort_values("k")
    assert got["o"].tolist() == want["o"].tolist()


def test_error_text_is_whole_unless_a_limit_is_given(spark):
    from skytable.operators.lifecycle import apply_transitions

    rows = [(1, 1, "failed", 10, "x" * 5000, 1)]
    events = spark.createDataFrame(rows, "query_id long, event_id long, status string, progress int, error_message string, ts long")
    assert len(apply_transitions(events).first().error_message) == 5000
    assert len(apply_transitions(events, 2000).first().error_message) == 2000


def test_spent_tables_are_deleted(spark):
    import os

    from skytable.session import discard, materialize

    kept, spent = materialize(spark.range(5)), materialize(spark.range(7))
    discard(spent, spark.range(3))
    assert kept.count() == 5 and not os.path.exists(spent._scratch_path.removeprefix("file:"))


def test_spent_shuffles_are_deleted(spark):
    import time

    from skytable.session import materialize

    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {name for name in (str(x) for x in blocks.getAllBlocks().mkString(" ").split(" ")) if name.startswith("shuffle_")}

    before = shuffles()
    table = materialize(spark.range(20_000).repartition(3, "id").withColumn("x", F.sha2(F.col("id").cast("string"), 256)))
    end = time.time() + 10
    while shuffles() - before and time.time() < end:
        time.sleep(0.1)
    assert not shuffles() - before
    assert table.count() == 20_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_costly_steps_do_not_wait_for_one_file(spark):
    """One input partition is dealt over many tasks before clipping and burning."""
    from pyspark.sql import functions as F

    from skytable.functions import geometry as geo
    from skytable.operators import burn
    from skytable.operators import features as feat

    places = spark.range(0, 100, 1, 1).select("id", geo.box_geometry(*[F.lit(v) for v in (0.0, 0.0, 1.0, 1.0)]).alias("geom"), F.lit(None).cast("double").alias("area_m2"))
    assert feat.clip_features(places, *[F.lit(v) for v in (0.5, 0.5, 2.0, 2.0)]).rdd.getNumPartitions() >= 64
    shapes = places.select(F.lit(1).alias("query_id"), F.col("id").alias("ord"), F.lit(1).alias("value"), "geom")
    grids = spark.createDataFrame([(1, 4326, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0], 4, 4)], "query_id int, epsg int, transform array<double>, height int, width int")
    plan = burn.rasterize_blocks(shapes, grids, 4)._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_ranges_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(skew, "RANGE_ROWS", 10)
    df = spark.range(300).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"))
    assert skew.ranges_of(df) == 30
    out = skew.numbered(df, ["k"], ["o"], "n", skew.ranges_of(df))
    assert out.rdd.getNumPartitions() == 30
    assert {(r.k, r.o, r.n) for r in out.collect()} == {(o % 2, o, o // 2 + 1) for o in range(300)}
