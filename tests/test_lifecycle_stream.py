"""A lifecycle stream that refuses, ends and forgets."""

from datetime import datetime, timedelta

from skytable.operators.lifecycle import apply_transitions
from skytable.streaming.lifecycle import stream_changes

SCHEMA = "event_id long, query_id long, ts timestamp, status string, progress int, status_message string, error_code string, error_message string"
NOON = datetime(2024, 1, 1, 12)


def at(minutes):
    return NOON + timedelta(minutes=minutes)


BATCHES = [
    [(1, 1, at(0), "queued", 0, "waiting", None, None), (2, 1, at(1), "preparing", 10, "cutting", None, None), (3, 1, at(2), "preparing", 400, None, None, None), (4, 2, at(3), "lost", 5, None, None, None)],
    [(6, 1, at(5), "failed", 45, "Prediction failed", "prediction_failed", "no tiles"), (5, 1, at(4), "inferencing", 45, None, None, None), (7, 2, at(5), "queued", 0, None, None, None)],
    [(8, 2, at(300), "preparing", 10, None, None, None)],
    [(9, 3, at(301), "queued", 0, None, None, None)],
    [(10, 1, at(6), "completed", 100, "too late", None, None)],
    [(11, 3, at(420), "completed", 100, "done", None, None)],
]


def test_refused_ended_and_forgotten(spark, tmp_path):
    source = tmp_path / "events"
    checkpoint, out = str(tmp_path / "checkpoint"), {}
    progress = []

    def keep(batch, batch_id):
        for r in batch.collect():
            out.setdefault(r.kind, []).append(r)

    for k, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(source / f"b={k}"))
        stream = stream_changes(spark.readStream.schema(SCHEMA).parquet(str(source / "*")))
        query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
        progress.append(query.lastProgress)
    assert sorted(r.event_id for r in out["refused"]) == [3, 4]
    states = [(r.query_id, r.status, r.progress, r.status_message, r.error_code, r.error_message, r.started_at, r.completed_at) for r in out["state"]]
    assert states[0] == (1, "preparing", 10, "cutting", None, None, at(1), None)
    assert (1, "failed", 45, "Prediction failed", "prediction_failed", "no tiles", at(1), at(5)) in states
    # The first request ended at 12:05 and was forgotten an hour later by event time; its late event changes nothing.
    assert [(r.query_id, r.status, r.completed_at) for r in out["expired"]] == [(1, "failed", at(5))]
    assert not any(s[3] == "too late" for s in states)
    assert sum(o.numRowsTotal for o in progress[-1].stateOperators) == 2


def test_message_and_code_of_the_last_event(spark):
    rows = [r for b in BATCHES[:2] for r in b]
    got = {r.query_id: (r.status, r.status_message, r.error_code, r.error_message) for r in apply_transitions(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: ("failed", "Prediction failed", "prediction_failed", "no tiles"), 2: ("queued", None, None, None)}
    again = spark.createDataFrame([*rows, (20, 1, at(50), "queued", 0, "once more", None, None)], SCHEMA)
    assert apply_transitions(again).filter("query_id = 1").first().error_code is None
