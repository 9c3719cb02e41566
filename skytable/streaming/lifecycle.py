"""Lifecycle state as a stream: the batch rules over a growing event table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skytable.operators.lifecycle import STATUSES, TERMINAL, split_transitions, state_columns
from skytable.operators.skew import first_by


def stream_states(events: DataFrame) -> DataFrame:
    """Streaming aggregate of the lifecycle columns per request, for update mode.

    Only partial aggregates are kept as state (one row per request), whatever the
    number of events of a request.
    """
    good, _ = split_transitions(events)
    return good.groupBy("query_id").agg(*state_columns())


def run_states(events: DataFrame, out: str, checkpoint: str) -> None:
    """Read what is available and append the changed states of each batch to ``out``."""

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    (
        stream_states(events)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(append)
        .start()
        .awaitTermination()
    )


def latest_states(spark: SparkSession, out: str) -> DataFrame:
    """The newest state of each request out of the appended batches."""
    batches = spark.read.option("basePath", out).parquet(out).drop("batch")
    return first_by(batches, ["query_id"], [-F.col("batch_id")]).drop("batch_id")


# What is kept of a request, and what comes out: ``kind`` is state, refused or expired.
_STATE = "event_id long, ts timestamp, status string, progress int, status_message string, error_code string, error_message string, started_at timestamp, completed_at timestamp"
_CHANGES = f"kind string, query_id long, {_STATE}"
_FIELDS = [c.split()[0] for c in _STATE.split(", ")]


def stream_changes(events: DataFrame, delay: str = "10 minutes", keep: str = "1 hour") -> DataFrame:
    """Changes of requests as a stream that forgets: (kind, query_id, event_id, ts, status, progress, messages, started_at, completed_at).

    Events have event_id, query_id, ts, status, progress, and may have status_message, error_code and error_message. A request that got
    events gives one ``state`` row for each batch: its last event by time and id, its first start and last completion. An event
    with an unknown status or a progress outside 0..100, or without a time, is refused: it comes out once as a ``refused`` row and
    changes nothing. ``keep`` after the end of a request, by event time, its state is dropped and an ``expired`` row tells so. Events
    later than ``delay`` are ignored. Only one row for each request that has not expired is kept.
    """
    texts = [F.col(c) if c in events.columns else F.lit(None).cast("string").alias(c) for c in ("status_message", "error_code", "error_message")]
    rows = events.select(F.col("query_id").cast("long").alias("query_id"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), "status", F.col("progress").cast("int").alias("progress"), *texts)
    wait = pd.Timedelta(keep)

    def change(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(zip(_FIELDS, state.get)) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([{"kind": "expired", "query_id": key[0], **known}])
            return
        changed = False
        for batch in batches:
            good = batch["status"].isin(STATUSES) & batch["progress"].between(0, 100) & batch["ts"].notna()
            refused = batch[~good]
            if len(refused):
                yield refused.assign(kind="refused", started_at=pd.NaT, completed_at=pd.NaT)[["kind", "query_id", *_FIELDS]]
            for event in batch[good].sort_values(["ts", "event_id"]).to_dict("records"):
                known, changed = known or dict.fromkeys(_FIELDS), True
                if event["status"] != "queued" and (pd.isna(known["started_at"]) or event["ts"] < known["started_at"]):
                    known["started_at"] = event["ts"]
                if event["status"] in TERMINAL and (pd.isna(known["completed_at"]) or event["ts"] > known["completed_at"]):
                    known["completed_at"] = event["ts"]
                if pd.isna(known["ts"]) or (known["ts"], known["event_id"]) <= (event["ts"], event["event_id"]):
                    known |= {c: event[c] for c in _FIELDS[:7]}
        if not changed:
            return
        known = {c: None if pd.isna(v) else v for c, v in known.items()}
        state.update(tuple(known[c] for c in _FIELDS))
        if known["status"] in TERMINAL:
            # A timer must lie after the watermark, also for a request that ended long ago.
            due = int((known["completed_at"] + wait).timestamp() * 1000)
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([{"kind": "state", "query_id": key[0], **known}])

    return rows.withWatermark("ts", delay).groupBy("query_id").applyInPandasWithState(change, _CHANGES, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
