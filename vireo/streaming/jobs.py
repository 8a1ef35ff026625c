"""Long jobs in the background: one at a time by name, with progress and a stop that Spark carries out."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import SparkSession


class Job:
    """work() in a thread of its own. Its Spark jobs form a group, which stop() cancels and progress() counts.

    state: running, done, stopped or failed; result and error are set at the end. A stopped job leaves what it had written.
    """

    def __init__(self, spark: SparkSession, work: Callable[[], object]) -> None:
        self.spark, self.group, self.state = spark, f"vireo-{uuid.uuid4().hex}", "running"
        self.result: object = None
        self.error: str | None = None
        self._stop = threading.Event()
        self._thread = InheritableThread(target=self._run, args=(work,), session=spark)
        self._thread.start()

    def _run(self, work: Callable[[], object]) -> None:
        self.spark.sparkContext.setJobGroup(self.group, "background job", interruptOnCancel=False)
        try:
            self.result = work()
            self.state = "stopped" if self._stop.is_set() else "done"
        except Exception as e:  # the thread's end: whatever went wrong is told to who asks
            self.state = "stopped" if self._stop.is_set() else "failed"
            self.error = None if self._stop.is_set() else str(e)

    def should_stop(self) -> bool:
        """For work() to ask between steps that are no Spark jobs."""
        return self._stop.is_set()

    def stop(self) -> None:
        self._stop.set()
        self.spark.sparkContext.cancelJobGroup(self.group)

    def join(self, seconds: float | None = None) -> str:
        self._thread.join(seconds)
        return self.state

    def progress(self) -> dict:
        """state, and how many tasks of the stages under way are done, of how many."""
        tracker = self.spark.sparkContext.statusTracker()
        active = set(tracker.getActiveStageIds())
        jobs = [j for j in (tracker.getJobInfo(k) for k in tracker.getJobIdsForGroup(self.group)) if j]
        stages = [s for s in (tracker.getStageInfo(k) for j in jobs for k in j.stageIds if k in active) if s]
        return {"state": self.state, "jobs": len(jobs), "tasks_done": sum(s.numCompletedTasks for s in stages), "tasks": sum(s.numTasks for s in stages)}


class Jobs:
    """At most one job of a name at a time."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._held, self._lock = spark, {}, threading.Lock()

    def start(self, name: str, work: Callable[[], object]) -> Job | None:
        """The job, or None where one of that name is running."""
        with self._lock:
            if name in self._held and self._held[name].state == "running":
                return None
            self._held[name] = Job(self.spark, work)
            return self._held[name]

    def get(self, name: str) -> Job | None:
        return self._held.get(name)
