"""Heartbeats of a sync: rows that say that a run is alive and how far it is, written while it goes on.

A beat is one small JSON file, written by the driver without a Spark job, so it does not wait for the tasks of the
run that it reports. A batch beats when it starts, when its rows are classified and when they are written, and
every few seconds between, with the tasks of its running stages. A batch that is repeated overwrites its beats.
"""

from __future__ import annotations

import contextlib
import json
import threading
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COUNTERS = ("total_items", "new_items", "updated_items", "unchanged_items", "skipped_items", "queued_items")
STAGES = ("started", "classified", "written")
SCHEMA = (
    "run_id string, batch_id bigint, beat bigint, stage string, at timestamp, tasks_done bigint, tasks bigint, "
    + ", ".join(f"{c} bigint" for c in COUNTERS)
)


class Heartbeats:
    """Writer of the beats of one run."""

    def __init__(self, spark: SparkSession, root: str, run_id: str, every: float = 10.0) -> None:
        self.spark, self.folder, self.run_id, self.every = spark, folder(root, run_id), run_id, every
        self._lock = threading.Lock()
        self._batch, self._beat = 0, 0

    def _tasks(self) -> tuple[int, int]:
        """Finished and all tasks of the stages that run in this session."""
        tracker = self.spark.sparkContext.statusTracker()
        infos = [i for s in tracker.getActiveStageIds() if (i := tracker.getStageInfo(s))]
        return sum(i.numCompletedTasks for i in infos), sum(i.numTasks for i in infos)

    def beat(self, stage: str, counters: dict[str, int] | None = None) -> None:
        """One row: the counters are those that this batch has added with this beat."""
        with self._lock:
            done, tasks = self._tasks()
            row = {
                "run_id": self.run_id,
                "batch_id": self._batch,
                "beat": self._beat,
                "stage": stage,
                "at": time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime()) + "Z",
                "tasks_done": done,
                "tasks": tasks,
                **{c: int((counters or {}).get(c, 0)) for c in COUNTERS},
            }
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{self._batch:08d}/{self._beat:06d}.json")
            out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True)
            try:
                out.write(bytearray((json.dumps(row) + "\n").encode()))
            finally:
                out.close()
            self._beat += 1

    def _clear(self) -> None:
        """Beats of an earlier try of this batch."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{self._batch:08d}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    @contextlib.contextmanager
    def batch(self, number: int) -> Iterator[Heartbeats]:
        """Beat around and during one batch. A batch that fails has no beat ``written``."""
        with self._lock:
            self._batch, self._beat = number, 0
            self._clear()
        over = threading.Event()

        def tick() -> None:
            while not over.wait(self.every):
                # a beat that cannot be written must not end the run; its absence is what a monitor looks for
                with contextlib.suppress(Exception):
                    self.beat("working")

        self.beat("started")
        ticker = threading.Thread(target=tick, daemon=True)
        ticker.start()
        try:
            yield self
        finally:
            over.set()
            ticker.join()
        self.beat("written")


def folder(root: str, run_id: str) -> str:
    return f"{root}/sync_heartbeats/run_id={run_id}"


def read_heartbeats(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """The beats of a run in order, with its counters so far. There are a few beats per batch."""
    rows = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").json(folder(root, run_id))
    so_far = Window.partitionBy("run_id").orderBy("batch_id", "beat").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.sum(c).over(so_far) for c in COUNTERS})


def last_heartbeat(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """One row: the newest beat, the number of beats and the counters of the run so far."""
    rows = read_heartbeats(spark, root, run_id)
    newest = F.struct("batch_id", "beat", "stage", "at", *COUNTERS)
    last = rows.groupBy("run_id").agg(F.max(newest).alias("last"), F.count("*").alias("beats"))
    return last.select("run_id", "beats", "last.*")
