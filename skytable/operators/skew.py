"""Building blocks that stay whole when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skytable.session import materialize

# A key is hot above this many rows. The threshold also grows with the table
# (rows / MAX_HOT_KEYS), so at most MAX_HOT_KEYS keys can ever be hot and the
# table of hot keys is small enough to broadcast at any input size.
HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 10_000
# Rows of one range, about, where the number of ranges follows the table.
RANGE_ROWS = 1_000_000
# Tasks at least that costly steps on rows are dealt over.
SPREAD_TASKS = 64


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    left_rows: int | None = None,
) -> DataFrame:
    """Equi join where hot keys of ``left`` are cut into pieces of about ``hot_rows`` rows.

    ``spread`` are columns of ``left`` that tell the rows of one key apart; they
    choose the piece, so a retried task picks the same one. ``how`` is any join
    that keeps or drops left rows (inner, left, left_semi, left_anti). A caller who
    knows the number of left rows, or a bound on those of one key, gives it: with no more
    rows than a hot key needs, no key can be hot and the join is plain.
    """
    on = list(on)
    if left_rows is not None and left_rows <= hot_rows:
        return left.join(right, on, how)
    counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    limit = counts.agg((F.sum("_rows") / MAX_HOT_KEYS).alias("_limit")).scalar()
    threshold = F.greatest(F.lit(float(hot_rows)), F.coalesce(limit, F.lit(0.0)))
    hot = counts.filter(F.col("_rows") > threshold).select(
        *on, F.ceil(F.col("_rows") / threshold).cast("int").alias("_pieces")
    )
    pick = F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.col("_pieces")).cast("int")
    salted_left = (
        left.join(F.broadcast(hot), on, "left")
        .withColumn("_salt", F.coalesce(pick, F.lit(0)))
        .drop("_pieces")
    )
    pieces = F.sequence(F.lit(0), F.coalesce(F.col("_pieces"), F.lit(1)) - 1)
    salted_right = (
        right.join(F.broadcast(hot), on, "left")
        .withColumn("_salt", F.explode(pieces))
        .drop("_pieces")
    )
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The same rows dealt over many tasks, before a costly step on each row: a small file is read by one task only."""
    parts = max(SPREAD_TASKS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *by)


def ranges_of(df: DataFrame) -> int:
    """Ranges of about ``RANGE_ROWS`` rows, and no fewer than the session's shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))


_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    running: Mapping[str, tuple[str, Column]],
    inclusive: bool = True,
    ranges: int | None = None,
) -> DataFrame:
    """Running aggregates per key in ``order``, for keys of any size.

    ``running`` maps an output name to (kind, column); the kinds are ``sum``,
    ``max``, ``min`` and ``last`` (the last non-null value). Rows are range
    partitioned by key and order, each range is scanned on its own, and what the
    earlier ranges of the same key hold is carried in. A range can continue only
    one key, so there are at most as many carries as ranges and they are
    broadcast. ``order`` must be unique within a key. ``ranges`` is the number of ranges, and
    of tasks that scan them; without it the session's shuffle partitions hold.
    """
    keys, order = list(keys), list(order)
    count = [] if ranges is None else [ranges]
    sources = {name: f"_in_{name}" for name in running}
    ranged = df
    for name, (_, column) in running.items():
        ranged = ranged.withColumn(sources[name], column)
    ranged = materialize(
        ranged.repartitionByRange(*count, *[F.col(c) for c in keys + order])
        .withColumn("_range", F.spark_partition_id())
    )

    def total(name: str) -> Column:
        kind, source = running[name][0], F.col(sources[name])
        if kind == "last":
            rank = F.struct(*[F.col(c) for c in order])
            return F.max_by(source, F.when(source.isNotNull(), rank))
        return _COMBINE[kind](source)

    summary = ranged.groupBy(*keys, "_range").agg(
        *[total(name).alias(f"_sum_{name}") for name in running]
    )
    # A key in several ranges continues at least one of them, so these keys and
    # their summaries are bounded by the number of ranges, not by the table.
    several = summary.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    edges = summary.join(F.broadcast(several), keys, "left_semi") if keys else summary
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        *keys,
        "_range",
        *[
            (
                F.last(f"_sum_{name}", ignorenulls=True)
                if running[name][0] == "last"
                else _COMBINE[running[name][0]](f"_sum_{name}")
            ).over(earlier).alias(f"_carry_{name}")
            for name in running
        ],
    )
    end = 0 if inclusive else -1
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    dealt = ranged.repartition(*count, *keys, "_range") if count else ranged
    joined = dealt.join(F.broadcast(carried), [*keys, "_range"], "left")
    out = joined
    for name, (kind, _) in running.items():
        source, carry = F.col(sources[name]), F.col(f"_carry_{name}")
        if kind == "last":
            value = F.coalesce(F.last(source, ignorenulls=True).over(inside), carry)
        else:
            part = _COMBINE[kind](source).over(inside)
            if kind == "sum":
                value = F.when(part.isNull(), carry).when(carry.isNull(), part).otherwise(part + carry)
            elif kind == "max":
                value = F.greatest(part, carry)
            else:
                value = F.least(part, carry)
        out = out.withColumn(name, value)
    drop = [*sources.values(), *[f"_carry_{name}" for name in running], "_range"]
    return out.drop(*drop)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn", ranges: int | None = None) -> DataFrame:
    """Row number 1.. per key in ``order``, without holding a key in one task."""
    out = prefix_scan(df, keys, order, {name: ("sum", F.lit(1).cast("long"))}, ranges=ranges)
    return out


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One whole row per key, the first in ``order``; a hash aggregate, not a sort."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_best")).select(
        *[F.col(c) if c in keys else F.col(f"_best.`{c}`").alias(c) for c in df.columns]
    )
