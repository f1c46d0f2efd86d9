"""File versions as keyed state: only what is newer comes out, deletions leave tombstones, and these are forgotten in time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from simigraph import store

VERSION = "path string, size long, mtime double, deleted boolean"
STATE = "mtime double, size long, deleted boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Versions(StatefulProcessor):
    """The newest version of one path, by mtime (ties: a deletion, then the larger size)."""

    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rank = lambda v: (v[0], v[2], v[1])
        known = self.last.get() if self.last.exists() else None
        best, seen = None, 0
        for frame in rows:
            for mtime, size, deleted, ts in zip(frame["mtime"], frame["size"], frame["deleted"], frame["ts"], strict=True):
                now = (float(mtime), int(size), bool(deleted))
                seen = max(seen, int(pd.Timestamp(ts).timestamp() * 1000))
                if best is None or rank(now) > rank(best):
                    best = now
        if best is None or known is not None and rank(best) <= rank(tuple(known)):
            return
        self.last.update(best)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if best[2]:
            self.handle.registerTimer(max(seen, timerValues.getCurrentWatermarkInMs()) + self.forget_ms)
        yield pd.DataFrame({"path": [key[0]], "size": [best[1]], "mtime": [best[0]], "deleted": [best[2]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def changes(rows: DataFrame, late: str = "1 day", forget_ms: int = 30 * 86_400_000) -> DataFrame:
    """The stream of versions that are newer than all before, from (path, size, mtime, deleted, ts).

    The state is one row for each path that there is, and one for each tombstone
    until the watermark has passed it by ``forget_ms``: a version that comes later
    than that counts as new. ``ts`` is when a row was observed; rows older than
    the watermark, which lies ``late`` behind the latest, aren't looked at.
    """
    if not rows.isStreaming:
        raise ValueError("versions come as a stream")
    store.ship(rows.sparkSession)
    whole = rows.select("path", F.col("size").cast("long").alias("size"), F.col("mtime").cast("double").alias("mtime"), F.coalesce("deleted", F.lit(False)).alias("deleted"), "ts")
    known = whole.where("path is not null and size is not null and mtime is not null").withWatermark("ts", late)
    return known.groupBy("path").transformWithStateInPandas(Versions(forget_ms), VERSION, "Append", "EventTime")


class keyed_state:  # noqa: N801
    """Streams that start in the block keep their state in RocksDB, which versions need."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(PROVIDER, None)
        self.spark.conf.set(PROVIDER, ROCKS)

    def __exit__(self, *_) -> None:
        if self.before is None:
            self.spark.conf.unset(PROVIDER)
        else:
            self.spark.conf.set(PROVIDER, self.before)


def tombstones(catalog: DataFrame, listing: DataFrame, now: float) -> DataFrame:
    """Deletions of all catalogued files that a whole listing lacks, as rows for the stream."""
    gone = catalog.join(listing.select("path"), "path", "left_anti")
    return gone.select("path", F.lit(0).cast("long").alias("size"), F.lit(now).alias("mtime"), F.lit(True).alias("deleted"), F.timestamp_seconds(F.lit(now)).alias("ts"))
