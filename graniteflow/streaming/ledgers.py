"""State kept by key over streams of events: repeated errors as records, bounded histories, and task states that lapse.

Rows of a key are combined inside each task's batches before the shuffle, so a key with a third of all rows costs a few
rows a batch. Every ledger has a twin on a table (``*_of_table``) that gives the rows that the stream ends with.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.window import Window

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Statuses that end a task.
TERMINAL = ("success", "failure", "revoked")
RECORDS = "signature string, first_seen timestamp, last_seen timestamp, n long, closed boolean"
HISTORY = "user long, total long, held long, oldest timestamp, newest timestamp, tasks array<string>"
TASKS = "task string, status string, progress int, updates long"
_HOUR = 3_600_000_000
#: Groups that signatures are dealt to: each keeps its signatures in a map state.
BUCKETS = 1024


def rocks(spark: SparkSession) -> None:
    """Map, list and timer states need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _times(micros: list) -> pd.Series:
    return pd.Series(pd.to_datetime(pd.Series(micros, dtype="int64"), unit="us"), dtype="datetime64[us]")


def _combined(frames: Iterator[pd.DataFrame], fold: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        if len(frame):
            yield fold(frame)


def joined_spells(spells: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """(first, last, n) in order of first, where those no more than ``gap`` apart are one."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(spells):
        if out and first - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


class ErrorLedger(StatefulProcessor):
    """Records of a bucket of signatures: an error within ``gap`` microseconds of a record's times belongs to it; a record closes when the watermark is ``gap`` past its last time."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.records = handle.getMapState("records", "signature string", "firsts array<long>, lasts array<long>, counts array<long>")

    def _rows(self, signature: str, spells: list[tuple[int, int, int]], closed: bool) -> pd.DataFrame:
        firsts, lasts, counts = zip(*spells, strict=True)
        return pd.DataFrame({"signature": signature, "first_seen": _times(list(firsts)), "last_seen": _times(list(lasts)), "n": list(counts), "closed": closed})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new: dict[str, list] = {}
        for frame in rows:
            for signature, first, last, n in zip(frame["signature"], frame["first"].astype("int64"), frame["last"].astype("datetime64[us]").astype("int64"), frame["n"], strict=True):
                new.setdefault(signature, []).append((int(first), int(last), int(n)))
        for signature, spells in new.items():
            held = self.records.getValue((signature,)) if self.records.containsKey((signature,)) else ([], [], [])
            before = list(zip(*held, strict=True))
            after = joined_spells([*map(tuple, before), *spells], self.gap)
            self.records.updateValue((signature,), tuple(list(x) for x in zip(*after, strict=True)))
            for _, last, _ in after:
                self.handle.registerTimer((last + self.gap) // 1000 + 1)
            changed = [s for s in after if s not in set(map(tuple, before))]
            yield self._rows(signature, changed, False)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        for (signature,), held in list(self.records.iterator()):
            spells = list(zip(*held, strict=True))
            over = [s for s in spells if s[1] + self.gap < now]
            if over:
                rest = [s for s in spells if s not in over]
                if rest:
                    self.records.updateValue((signature,), tuple(list(x) for x in zip(*rest, strict=True)))
                else:
                    self.records.removeKey((signature,))
                yield self._rows(signature, over, True)


def signature_of(event: str = "event_type", props: str = "props") -> Column:
    """An error's signature: its type and the key of its properties."""
    return F.md5(F.concat_ws("|", event, F.get_json_object(props, "$.k")))


def error_records(events: DataFrame, window_hours: int = 24, late: str = "2 hours") -> DataFrame:
    """A stream's errors as records of their signatures: first_seen, last_seen, n; a row whenever a record changes, and one, closed, when it ends.

    events: event_type, props, ts. Repeats within twice the window of a record count for it and give no record of
    their own; records that a late row joins become one, under the earlier first_seen. Rows behind the watermark
    (of ``late``) and null times are dropped. State goes with the closed record.
    """
    rocks(events.sparkSession)
    gap = 2 * window_hours * _HOUR
    errors = events.where("event_type = 'error' AND ts IS NOT NULL").select(signature_of().alias("signature"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        out = [(signature, *spell) for signature, at in frame.groupby("signature")["at"] for spell in joined_spells([(t, t, 1) for t in at.tolist()], gap)]
        table = pd.DataFrame(out, columns=["signature", "first", "last", "n"])
        return table.assign(last=_times(table["last"].tolist()))

    spells = errors.mapInPandas(lambda frames: _combined(frames, fold), "signature string, first long, last timestamp, n long")
    keyed = spells.withColumn("bucket", F.pmod(F.xxhash64("signature"), F.lit(BUCKETS))).withWatermark("last", late)
    return keyed.groupBy("bucket").transformWithStateInPandas(ErrorLedger(gap), RECORDS, "update", "eventTime")


def error_records_of_table(events: DataFrame, window_hours: int = 24) -> DataFrame:
    """The records that a stream of these events ends with: signature, first_seen, last_seen, n.

    Errors of one span of the gap's length can't be further apart than it, so they are summed first; a signature's
    sums are as many as spans of time, whatever its rows.
    """
    gap = 2 * window_hours * _HOUR
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    errors = events.where("event_type = 'error' AND ts IS NOT NULL").select(signature_of().alias("signature"), at.alias("at"))
    spans = errors.groupBy("signature", F.floor(F.col("at") / gap).alias("span")).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"))
    order = Window.partitionBy("signature").orderBy("first")
    parted = spans.withColumn("new", F.coalesce(F.col("first") - F.lag("last").over(order) > gap, F.lit(True)).cast("int")).withColumn("record", F.sum("new").over(order))
    time = lambda c: F.timestamp_micros(c)
    return parted.groupBy("signature", "record").agg(time(F.min("first")).alias("first_seen"), time(F.max("last")).alias("last_seen"), F.sum("n").alias("n")).drop("record")


class TaskHistory(StatefulProcessor):
    """The newest ``most`` ended tasks of a user within ``keep`` microseconds of the newest, in a list state, and how many there were in all."""

    def __init__(self, most: int, keep: int):
        self.most, self.keep = most, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "ts long, task string")
        self.total = handle.getValueState("total", "total long")

    def _row(self, user: int, total: int, held: list[tuple[int, str]]) -> pd.DataFrame:
        times = _times([held[0][0], held[-1][0]]) if held else pd.Series([pd.NaT, pd.NaT], dtype="datetime64[us]")
        return pd.DataFrame({"user": [user], "total": [total], "held": [len(held)], "oldest": times[:1], "newest": times[1:].reset_index(drop=True), "tasks": [[task for _, task in held]]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held, total = [tuple(x) for x in self.held.get()], self.total.get()[0] if self.total.exists() else 0
        for frame in rows:
            total += int(frame["n"].sum())
            held += list(zip(frame["ts"].astype("datetime64[us]").astype("int64").tolist(), frame["task"].tolist(), strict=True))
        held = trimmed(held, self.most, self.keep)
        self.held.put(held)
        self.total.update((total,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((held[-1][0] + self.keep) // 1000 + 1)
        yield self._row(key[0], total, held)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        total = self.total.get()[0]
        self.held.clear()
        self.total.clear()
        yield self._row(key[0], total, [])


def trimmed(held: list[tuple[int, str]], most: int, keep: int) -> list[tuple[int, str]]:
    """The newest of (time, task), oldest first: ``most`` at most, none older than the newest by over ``keep``."""
    held = sorted(held)[-most:]
    return [x for x in held if x[0] >= held[-1][0] - keep]


def ended_tasks(events: DataFrame) -> DataFrame:
    """user, task, ts of the tasks that end, from a table or stream of user, task, status, ts; rows without user, task or time are dropped."""
    ended = events.where(F.col("status").isin(*TERMINAL) & F.col("ts").isNotNull() & F.col("user").isNotNull() & F.col("task").isNotNull())
    return ended.select(F.col("user").cast("long").alias("user"), "task", F.col("ts").cast("timestamp").alias("ts"))


def task_history(events: DataFrame, most: int = 100, keep_hours: int = 72, late: str = "2 hours") -> DataFrame:
    """Each user's newest ended tasks as a bounded list, whenever it changes, and an empty one when its time is over.

    The list has ``most`` tasks at most, none older than the user's newest by over ``keep_hours``, oldest first; it is
    dropped, with a row, once the watermark is ``keep_hours`` past the newest. Rows behind the watermark are dropped.
    A stream that stops and starts again goes on from its checkpoint.
    """
    rocks(events.sparkSession)
    keep = keep_hours * _HOUR

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        # only a user's newest in a batch can stay; what is cut is counted on the first that stays
        frame = frame.sort_values(["user", "ts", "task"])
        n = frame.groupby("user")["ts"].transform("size")
        last = frame.groupby("user").tail(most)
        first = ~last["user"].duplicated()
        return last.assign(n=(n.loc[last.index] - most).clip(lower=0).where(first, 0) + 1)

    rows = ended_tasks(events).mapInPandas(lambda frames: _combined(frames, fold), "user long, task string, ts timestamp, n long")
    return rows.withWatermark("ts", late).groupBy("user").transformWithStateInPandas(TaskHistory(most, keep), HISTORY, "update", "eventTime")


def task_history_of_table(events: DataFrame, most: int = 100, keep_hours: int = 72) -> DataFrame:
    """The lists that a stream of these events ends with, before their time is over."""
    rows = ended_tasks(events)
    order = Window.partitionBy("user").orderBy(F.col("ts").desc(), F.col("task").desc())
    newest = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)  # limited before the shuffle
    totals = rows.groupBy("user").agg(F.count("*").alias("total"), F.max("ts").alias("newest"))
    kept = newest.join(totals, "user").where(F.col("ts") >= F.col("newest") - F.make_interval(hours=F.lit(keep_hours)))
    tasks = F.transform(F.array_sort(F.collect_list(F.struct("ts", "task"))), lambda x: x["task"])
    return kept.groupBy("user", "total", "newest").agg(F.count("*").alias("held"), F.min("ts").alias("oldest"), tasks.alias("tasks")).select("user", "total", "held", "oldest", "newest", "tasks")


class TaskRegistry(StatefulProcessor):
    """A task's last status and progress, for ``ttl`` milliseconds after each write."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("task", "seen long, status string, progress int, updates long", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        seen, status, progress, updates = self.state.get() if self.state.exists() else (0, "pending", 0, 0)
        frame = pd.concat(list(rows)).sort_values(["ts", "status"], kind="stable")
        for ts, now, done in zip(frame["ts"].astype("datetime64[us]").astype("int64").tolist(), frame["status"].tolist(), frame["progress"].tolist(), strict=True):
            updates += 1
            if ts >= seen and status not in TERMINAL:
                seen, status = ts, now
                progress = 100 if now == "success" else progress if done != done or done is None else int(min(100, max(0, done)))
        self.state.update((seen, status, progress, updates))
        yield pd.DataFrame({"task": [key[0]], "status": [status], "progress": [progress], "updates": [updates]}).astype({"progress": "int32"})


def task_registry(events: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """Each task's state whenever rows of it arrive: a stream of task, ts, status, progress. State that isn't written for ``ttl`` of the clock lapses.

    Rows older than the task's last, or after its end, only count. Null tasks and times are dropped. A run with
    ``availableNow`` only ends if ``spark.sql.streaming.noDataMicroBatches.enabled`` is false.
    """
    rocks(events.sparkSession)
    milliseconds = int(pd.Timedelta(ttl).total_seconds() * 1000)
    rows = events.where("task IS NOT NULL AND ts IS NOT NULL").select("task", F.col("ts").cast("timestamp").alias("ts"), "status", F.col("progress").cast("double").alias("progress"))
    return rows.groupBy("task").transformWithStateInPandas(TaskRegistry(milliseconds), TASKS, "update", "processingTime")
