"""Streams of task events: a state machine for each task with event-time order and a timeout for stale ones, and first errors of a kind.

Rows that arrive behind the watermark are dropped; rows out of order but within it never set a task back,
because a row older than the task's last one changes nothing but its start. (Last arrival wins nowhere.)
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Statuses that end a task, and those in which it is active.
TERMINAL, ACTIVE = ("success", "failure", "revoked"), ("pending", "started", "processing", "retry")
STATES = "task string, status string, progress int, began timestamp, ended timestamp, seen timestamp, updates long, reason string"
_KEPT = "status string, progress int, began long, ended long, seen long, updates long"


def _micros(ts) -> int:
    return int(pd.Timestamp(ts).value // 1000)


def _time(micros: int | None):
    return None if micros is None else pd.Timestamp(micros, unit="us")


def advanced(state: tuple | None, ts: int, status: str, progress: int | None) -> tuple:
    """The state after one row: status, progress between 0 and 100, first start, end of a finished task, last time, updates."""
    was, done, began, ended, seen, updates = state or ("pending", 0, None, None, None, 0)
    if status == "started":
        began = ts if began is None else min(began, ts)
    if (seen is not None and ts < seen) or was in TERMINAL:  # too late to change anything else
        return was, done, began, ended, max(seen, ts), updates + 1
    done = 100 if status == "success" else min(100, max(0, done if progress is None else progress))
    return status, done, began, ts if status in TERMINAL else None, ts, updates + 1


def task_states(events: DataFrame, late: str = "10 minutes", stale: str = "2 hours") -> DataFrame:
    """Each task's state whenever rows of it arrive, and once more when it has been active without a row for ``stale``.

    events: a stream of task (string), ts, status, progress (int). Null tasks and times are dropped. A stale
    task fails with reason ``stale``. State of finished tasks is dropped after the same time.
    """
    wait = int(pd.Timedelta(stale).total_seconds() * 1000)

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, reason = (state.get if state.exists else None), None
        if state.hasTimedOut:
            state.remove()
            if held[0] in TERMINAL:
                return
            held, reason = ("failure", held[1], held[2], held[4] + wait * 1000, held[4], held[5]), "stale"
        else:
            rows = pd.concat(list(frames)).sort_values(["ts", "status"], kind="stable")
            for ts, status, progress in zip(rows["ts"], rows["status"], rows["progress"], strict=True):
                held = advanced(held, _micros(ts), status, None if pd.isna(progress) else int(progress))
            state.update(held)
            state.setTimeoutTimestamp(max(held[4] // 1000, state.getCurrentWatermarkMs()) + wait)
        yield pd.DataFrame(
            {"task": [key[0]], "status": [held[0]], "progress": [held[1]], "began": [_time(held[2])], "ended": [_time(held[3])], "seen": [_time(held[4])], "updates": [held[5]], "reason": [reason]}
        ).astype({"began": "datetime64[us]", "ended": "datetime64[us]", "seen": "datetime64[us]"})

    rows = events.where("task IS NOT NULL AND ts IS NOT NULL").select("task", F.col("ts").cast("timestamp").alias("ts"), "status", F.col("progress").cast("int").alias("progress"))
    return rows.withWatermark("ts", late).groupBy("task").applyInPandasWithState(step, STATES, _KEPT, "update", GroupStateTimeout.EventTimeTimeout)


def first_errors(events: DataFrame, within: str = "1 hour") -> DataFrame:
    """The first error of each signature (type and key) within the watermark; repeats are suppressed."""
    signature = F.md5(F.concat_ws("|", "event_type", F.get_json_object("props", "$.k")))
    errors = events.where("event_type = 'error'").select(signature.alias("signature"), F.col("ts").cast("timestamp").alias("ts"), "user_id")
    return errors.withWatermark("ts", within).dropDuplicatesWithinWatermark(["signature"])


def latest_states(events: DataFrame) -> DataFrame:
    """Each user's last status over a stream in complete mode, by event time."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("n"))
