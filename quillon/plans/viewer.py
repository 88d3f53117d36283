"""Loading of scenes for a viewer: the latest request wins, an earlier one is cancelled.

A load runs as Spark jobs under a tag of its own in a thread of its own; the next
load cancels the jobs of that tag.  What a cancelled load would have given is dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from threading import Lock, Thread

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from ..session import stage


@dataclass
class Backend:
    """What loads a format: its name, extensions without the dot, a test of content and path, and a scene as a table."""

    name: str
    extensions: tuple[str, ...]
    accepts: Callable[[bytes, str | None], bool]
    load: Callable[[SparkSession, bytes, str | None], DataFrame]


class Viewer:
    """``scene`` is the last scene that was loaded to its end, ``status`` and ``error`` what to show."""

    def __init__(self, spark: SparkSession, backends: list[Backend]):
        self.spark, self.backends = spark, backends
        self.scene: DataFrame | None = None
        self.status, self.error = "", None
        self._lock, self._tag, self._thread = Lock(), None, None  # the tag is that of the load under way

    def load(self, content: bytes, path: str | None = None) -> bool:
        """Begin to load; False where no backend takes the content."""
        backend = next((b for b in self.backends if b.accepts(content, path)), None)
        if backend is None:
            self.status = f"{path}: format not supported"
            return False
        self.cancel()
        tag = f"viewer-{uuid.uuid4().hex}"
        with self._lock:
            self._tag, self.status, self.error = tag, f"loading {path}", None
        self._thread = InheritableThread(target=self._run, args=(backend, content, path, tag), daemon=True)
        self._thread.start()
        return True

    def cancel(self) -> None:
        """Interrupt the load under way, if there is one; the scene on show stays."""
        with self._lock:
            tag, self._tag = self._tag, None
        if tag is not None:
            Thread(target=self._stop, args=(self._thread, tag), daemon=True).start()

    def _stop(self, thread: Thread, tag: str) -> None:
        """Cancel again until the load has ended: it may not have begun its first job, or go on to its next."""
        while thread.is_alive():
            self.spark.sparkContext.cancelJobsWithTag(tag)
            thread.join(0.5)

    def wait(self, seconds: float | None = None) -> bool:
        """Whether the latest load has ended within that time."""
        if self._thread is not None:
            self._thread.join(seconds)
        return self._thread is None or not self._thread.is_alive()

    def _run(self, backend: Backend, content: bytes, path: str | None, tag: str) -> None:
        self.spark.sparkContext.addJobTag(tag)
        self.spark.sparkContext.setInterruptOnCancel(True)  # else its tasks would keep their places
        try:
            scene, error = stage(backend.load(self.spark, content, path)), None
        except Exception as failed:
            scene, error = None, str(failed)
        finally:
            self.spark.sparkContext.removeJobTag(tag)
        with self._lock:
            if self._tag != tag:  # a later request has taken its place
                return
            self._tag = None
            if error is None:
                self.scene, self.status = scene, f"loaded by {backend.name}"
            else:
                self.error, self.status = error, "error"
