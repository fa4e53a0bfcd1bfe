"""Cancelling a whole run from another thread.

A run's jobs carry a tag. Cancelling ends the jobs that run and those that the run starts
until it gives up, so that it ends wherever it is: in a job or between two. As results are
put in place last and as a whole, a cancelled run has written none.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

Result = TypeVar("Result")


class Cancelled(RuntimeError):
    """The run was cancelled before it ended."""


class Run:
    """run(f, ...) calls f in the caller's thread; cancel(), in any other, makes it raise Cancelled. A Run is used once."""

    def __init__(self, spark: SparkSession, again: float = 0.2) -> None:
        self.context, self.again = spark.sparkContext, again
        self.tag = f"run-{uuid.uuid4().hex}"
        self.cancelled, self.ended = threading.Event(), threading.Event()

    def __call__(self, f: Callable[..., Result], *args, **named) -> Result:  # noqa: ANN002, ANN003
        watch = threading.Thread(target=self._watch, daemon=True)
        watch.start()
        self.context.addJobTag(self.tag)
        try:
            if self.cancelled.is_set():
                raise Cancelled(self.tag)
            result = f(*args, **named)
        except Exception as e:
            if self.cancelled.is_set() and not isinstance(e, Cancelled):
                raise Cancelled(self.tag) from e
            raise
        finally:
            self.context.removeJobTag(self.tag)
            self.ended.set()
            self.cancelled.set()  # lets the watch end
            watch.join()
        return result

    def cancel(self) -> None:
        self.cancelled.set()

    def _watch(self) -> None:
        self.cancelled.wait()
        while not self.ended.is_set():
            self.context.cancelJobsWithTag(self.tag)
            self.ended.wait(self.again)
