"""Jobs that can be cancelled: every Spark job of one carries its tag, and is interrupted by it.

What a job has written by then lies in folders that no manifest names (see versions.Store), or is a plan's items with their
claims (see fileops), so a cancelled job leaves the tables as they were and can be run again.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


class Cancelled(Exception):
    """The job was asked to stop."""


class Job:
    """One run of work(job), in a thread of its own. status: running, done, cancelled or failed."""

    def __init__(self, spark: SparkSession, name: str, work: Callable[[Job], object]):
        self.spark, self.tag, self.status, self.result, self.error = spark, f"{name}-{uuid.uuid4().hex[:12]}".replace(",", "_"), "running", None, None
        self._asked, self._lock = threading.Event(), threading.Lock()

        @inheritable_thread_target(spark)
        def run() -> None:
            spark.sparkContext.addJobTag(self.tag)
            spark.sparkContext.setInterruptOnCancel(True)
            try:
                self.result = work(self)
                self.status = "done"
            except BaseException as e:  # a cancelled Spark job raises what Spark makes of it
                self.error, self.status = e, "cancelled" if self._asked.is_set() else "failed"
            finally:
                spark.sparkContext.removeJobTag(self.tag)

        self._thread = threading.Thread(target=run, name=self.tag, daemon=True)
        self._thread.start()

    def step(self) -> None:
        """To be called between steps: stops here once the job has been cancelled."""
        if self._asked.is_set():
            raise Cancelled(self.tag)

    def cancel(self) -> None:
        """Ask it to stop and interrupt what runs for it; a job that has ended stays as it is."""
        self._asked.set()
        while self._thread.is_alive():
            self.spark.sparkContext.cancelJobsWithTag(self.tag)  # again, as the next step may just have begun
            self._thread.join(0.2)

    def wait(self, seconds: float | None = None) -> str:
        self._thread.join(seconds)
        return self.status
