"""Keyed state with timers: stuck jobs by event time, silent runs by the clock."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lorekeep.constants import MAX_ATTEMPTS, STALE_MINUTES
from lorekeep.session import keep_state_in_rocksdb

EVENT = "ts bigint, processing boolean, attempts int"
LAST = "tick bigint, done bigint, cursor bigint, still bigint, silent boolean"


def _milliseconds(micros: int, minutes: int) -> int:
    """When a timer that starts at ``micros`` runs out; never before the whole time has passed."""
    return -(-micros // 1000) + minutes * 60_000


class StuckJobs(StatefulProcessor):
    """Per job the rows that still matter: processing rows without a verdict, and rows newer than the watermark.

    An older row may still come for the latter. A processing row that a later one of its job cancels is forgotten
    at once. Jobs share the state and the timer of their bucket, which stands at the earliest time that is up
    next, so that a batch costs a few state calls per bucket and not per job. A bucket without open rows leaves
    no state behind.
    """

    def __init__(self, minutes: int, max_attempts: int, job_type: str) -> None:
        self.minutes, self.max_attempts, self.layout = minutes, max_attempts, f"job {job_type}, {EVENT}"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.layout)

    def _open(self, rows: list[tuple]) -> list[tuple]:
        """The processing rows that no row of the job follows in time; rows are sorted, processing rows first."""
        reach = self.minutes * 60_000_000
        after = [*rows[1:], (None, 0, False, 0)]
        return [r for r, n in zip(rows, after) if r[2] and not (n[0] == r[0] and n[1] <= r[1] + reach)]

    def _settle(self, rows: list[tuple], watermark: int) -> list[tuple]:
        """Store what still matters, set the timer and return the rows whose time is up."""
        opened = self._open(rows)
        due = [r for r in opened if _milliseconds(r[1], self.minutes) <= watermark]
        waiting = set(opened) - set(due)
        kept = [r for r in rows if r in waiting or r[1] > watermark * 1000]
        if kept:
            self.rows.put(kept)
        else:
            self.rows.clear()
        moment = min((_milliseconds(r[1], self.minutes) for r in waiting), default=None)
        known = list(self.handle.listTimers())
        for old in known:
            if old != moment:
                self.handle.deleteTimer(old)
        if moment is not None and moment not in known:
            self.handle.registerTimer(moment)
        return due

    def _events(self, due: list[tuple]) -> Iterator[pd.DataFrame]:
        if due:
            action = ["failed" if r[3] >= self.max_attempts else "requeue" for r in due]
            yield pd.DataFrame({"job_id": [r[0] for r in due], "action": action, "attempts": [r[3] for r in due]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        merged = {tuple(r[:3]): r[3] for r in self.rows.get()}
        for frame in rows:
            columns = (frame[c].tolist() for c in ("job_id", "micros", "processing", "attempts"))
            for job, ts, processing, attempts in zip(*columns):
                at = (job, ts, processing)
                merged[at] = max(merged.get(at, 0), attempts)
        held = sorted(((*at, n) for at, n in merged.items()), key=lambda r: (r[0], r[1], not r[2]))
        yield from self._events(self._settle(held, timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.rows.get()]
        yield from self._events(self._settle(held, timerValues.getCurrentWatermarkInMs()))

    def close(self) -> None:
        pass


def stuck_job_timeout(
    log: DataFrame,
    minutes: int = STALE_MINUTES,
    max_attempts: int = MAX_ATTEMPTS,
    late: str = "10 minutes",
    buckets: int = 256,
) -> DataFrame:
    """Timeout events (job_id, action, attempts) from a job log stream (job_id, status, ts, attempts).

    A job that stays in processing for ``minutes`` of event time is requeued, or failed after too many attempts.
    The log is scanned once. Each processing row starts a time; any later row of its job within it cancels it, in
    whatever order and batch they come, as long as they are no later than ``late``. What is left is sent on when
    the watermark has passed its time. At equal times another status comes after processing; of repeated
    processing rows the one with most attempts counts. State holds rows newer than the watermark and processing
    rows whose time is not up, in ``buckets`` of jobs: take about a hundredth of the jobs that are open at a time.
    Rows without a job are left out. The session's streams then keep their state in RocksDB, as timers need.
    """
    keep_state_in_rocksdb(log.sparkSession)
    kinds = {c: log.schema[c].dataType.simpleString() for c in ("job_id", "attempts")}
    rows = log.filter(F.col("job_id").isNotNull()).select(
        F.pmod(F.xxhash64("job_id"), F.lit(buckets)).alias("bucket"),
        "job_id",
        "ts",
        F.unix_micros("ts").alias("micros"),
        (F.coalesce("status", F.lit("")) == "processing").alias("processing"),
        F.coalesce("attempts", F.lit(0)).alias("attempts"),
    )
    return (
        rows.withWatermark("ts", late)
        .groupBy("bucket")
        .transformWithStateInPandas(
            StuckJobs(minutes, max_attempts, kinds["job_id"]),
            f"job_id {kinds['job_id']}, action string, attempts {kinds['attempts']}",
            "append",
            "eventTime",
        )
    )


class LiveHealth(StatefulProcessor):
    """Health of every sample as it comes, and STALLED when none has come for too long by the clock."""

    def __init__(self, stale_seconds: int, idle: int, forget_seconds: int) -> None:
        self.stale, self.idle, self.forget = stale_seconds, idle, forget_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", LAST, self.forget * 1000)

    def _row(self, key: tuple, tick: int, still: int, health: str) -> pd.DataFrame:
        return pd.DataFrame({"run_id": [key[0]], "tick": [tick], "stagnant_ticks": [still], "health": [health]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        samples = pd.concat(frames).sort_values("tick", kind="stable")
        last = self.last.get() if self.last.exists() else None
        for s in samples.itertuples():
            if last is not None and s.tick <= last[0]:
                continue
            # the first sample has nothing to differ from and counts as the first still one
            same = last is None or (last[1], last[2]) == (s.done, s.cursor)
            still = (0 if last is None else last[3]) + 1 if same else 0
            stalled = bool(s.scanning) and not pd.isna(s.heartbeat_age) and s.heartbeat_age > self.stale
            health = "STALLED" if stalled else "LIVE" if s.processing > 0 or still < self.idle else "IDLE"
            last = (int(s.tick), int(s.done), int(s.cursor), int(still), False)
            yield self._row(key, last[0], last[3], health)
        if last is not None:
            self.last.update(last)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.stale * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            last = tuple(self.last.get())
            self.last.update((*last[:4], True))
            yield self._row(key, last[0], last[3], "STALLED")

    def close(self) -> None:
        pass


def live_health(
    samples: DataFrame, stale_seconds: int = 30, interval: float = 2.0, forget_seconds: int = 24 * 3600
) -> DataFrame:
    """Health rows (run_id, tick, stagnant_ticks, health) from a stream of samples, as in ``stall_detection``.

    Samples of a run come in the order of their ticks from batch to batch; within a batch they are ordered, and one
    that is older than the last is left out. When a run sends nothing for ``stale_seconds`` of the clock, one
    STALLED row with its last tick comes without any new input. The state of a run is forgotten after
    ``forget_seconds`` without a sample. Timers of the clock keep a query going: run it with a processing-time
    trigger, not to the end of what is there. The session's streams then keep their state in RocksDB, as timers need.
    """
    from lorekeep.streaming.jobs import idle_ticks

    keep_state_in_rocksdb(samples.sparkSession)
    kind = samples.schema["run_id"].dataType.simpleString()
    rows = samples.select(
        "run_id", "tick", "done", "cursor", "processing", "scanning", F.col("heartbeat_age").cast("double").alias("heartbeat_age")
    )
    return rows.groupBy("run_id").transformWithStateInPandas(
        LiveHealth(stale_seconds, idle_ticks(interval), forget_seconds),
        f"run_id {kind}, tick bigint, stagnant_ticks bigint, health string",
        "append",
        "processingTime",
    )
