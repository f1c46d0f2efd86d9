"""Progress and cancelling of long scans."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

logger = logging.getLogger("simigraph")


@dataclass(frozen=True)
class Progress:
    kind: str
    done: int
    total: int
    item: str = ""


Listener = Callable[[Progress], None]


def log_to(path: str | None = None, level: int = logging.INFO) -> None:
    """Messages to the console, and to a file if one is named."""
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if path:
        handlers.append(logging.FileHandler(path, encoding="utf-8"))
    for h in handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        logger.addHandler(h)
    logger.setLevel(level)


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[Callable[[], None]]:
    """Jobs that the block starts can be cancelled, from any thread and while they run, by calling what this yields."""
    context = spark.sparkContext
    context.addJobTag(tag)
    try:
        yield lambda: context.cancelJobsWithTag(tag)
    finally:
        context.removeJobTag(tag)


def stages(spark: SparkSession) -> list[Progress]:
    """Tasks done of each active stage."""
    tracker = spark.sparkContext.statusTracker()
    out = []
    for stage in tracker.getActiveStageIds():
        info = tracker.getStageInfo(stage)
        if info:
            out.append(Progress("stage", info.numCompletedTasks, info.numTasks, info.name))
    return out


def observed(rows: DataFrame, item: str = "path") -> tuple[DataFrame, Callable[[], tuple[int, str]]]:
    """The rows, and what gives their number and the last of their items once they have been written; a job of its own isn't needed."""
    seen = Observation()
    watched = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.max(F.col(item).cast("string")).alias("last"))
    return watched, lambda: (seen.get["n"], seen.get["last"] or "")


@contextmanager
def watching(spark: SparkSession, listener: Listener, every: float = 1.0) -> Iterator[None]:
    """Tasks done of the stages that run meanwhile, as often as they change. A listener that raises ends the watching, not the work."""
    over, last = threading.Event(), {}

    def look() -> None:
        while not over.wait(every):
            for p in stages(spark):
                if last.get(p.item) != p.done:
                    last[p.item] = p.done
                    listener(p)

    thread = threading.Thread(target=look, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()


class StreamProgress(StreamingQueryListener):
    """Passes each batch of a stream on to a listener."""

    def __init__(self, listener: Listener):
        self.listener, self.rows = listener, 0

    def onQueryStarted(self, event) -> None:
        self.listener(Progress("started", 0, 0, str(event.id)))

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        self.listener(Progress("batch", self.rows, self.rows, str(event.progress.batchId)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.listener(Progress("ended", self.rows, self.rows, str(event.id)))
