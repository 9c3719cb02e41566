"""Lifecycle of prediction requests from their transition events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytable.operators.skew import prefix_scan

# States, and the progress of each stage.
STATUSES = ("queued", "preparing", "inferencing", "postprocessing", "completed", "failed", "cancelled")
TERMINAL = ("completed", "failed", "cancelled")
STAGE_PROGRESS = {"preparing": 10, "inferencing": 45, "postprocessing": 85, "completed": 100}


def split_transitions(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with a known state and a progress of 0..100, and the refused rest."""
    ok = F.coalesce(F.col("progress").between(0, 100) & F.col("status").isin(*STATUSES), F.lit(False))
    return events.filter(ok), events.filter(~ok)


def state_columns() -> list[Column]:
    """Aggregates that give the state of a request after its events, in any order of arrival."""
    latest = F.struct("ts", "event_id")
    return [
        F.max_by("status", latest).alias("status"),
        F.max_by("progress", latest).alias("progress"),
        F.min(F.when(F.col("status") != "queued", F.col("ts"))).alias("started_at"),
        F.max(F.when(F.col("status").isin(*TERMINAL), F.col("ts"))).alias("completed_at"),
        F.max("ts").alias("updated_at"),
    ]


def apply_transitions(events: DataFrame, error_limit: int | None = None) -> DataFrame:
    """State per request: last status and progress, first start, last completion, message, error code and error text.

    Message, code and text are those of the last event, null where it has none, if the events have such columns. The
    error text is whole; ``error_limit`` cuts it for a store with a column of that width.
    """
    good, _ = split_transitions(events)
    columns = state_columns()
    columns += [F.max_by(c, F.struct("ts", "event_id")).alias(c) for c in ("status_message", "error_code") if c in events.columns]
    if "error_message" in events.columns:
        text = F.col("error_message") if error_limit is None else F.substring("error_message", 1, error_limit)
        columns.append(F.max_by(F.nullif(text, F.lit("")), F.struct("ts", "event_id")).alias("error_message"))
    return good.groupBy("query_id").agg(*columns)


def stage_progress(events: DataFrame) -> DataFrame:
    """Progress after each event: fixed per stage; a failure keeps the last one."""
    table = F.create_map(*[F.lit(v) for kv in STAGE_PROGRESS.items() for v in kv])
    step = F.when(F.col("status") == "queued", F.lit(0)).otherwise(F.try_element_at(table, F.col("status")))
    out = prefix_scan(events, ["query_id"], ["ts", "event_id"], {"stage_progress": ("last", step)})
    return out.withColumn("stage_progress", F.coalesce("stage_progress", F.lit(0)))
