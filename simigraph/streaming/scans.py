"""Streams of file versions into a catalog, and deduplication with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from simigraph import store
from simigraph.operators.incremental import latest


def file_stream(spark: SparkSession, path: str, schema: StructType | str, files_a_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def keep_catalog(versions: DataFrame, catalog: str, checkpoint: str, buckets: int = 16, keep: int = 2) -> StreamingQuery:
    """Upsert the latest version of each path into the catalog, batch by batch, until the stream is drained.

    The catalog is dealt to ``buckets`` by a hash of the path; a batch rewrites
    only those it touches and commits them as one version (``store.merge``), so
    readers see all of a batch or nothing. A writer that dies leaves the version
    before, and a batch that is run again gives the same catalog. Several streams
    may keep one catalog. The newest ``keep`` versions can be read. Rows may have a column ``deleted``: where the latest
    version of a path is a deletion, the catalog keeps it as a tombstone, which
    ``read_catalog`` leaves out.
    """

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = store.materialise(latest(batch).withColumn("_bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")), "batch")
        touched = [r["_bucket"] for r in fresh.select("_bucket").distinct().collect()]  # at most ``buckets`` rows

        def merged(k: int, old: DataFrame | None) -> DataFrame:
            rows = fresh.where(F.col("_bucket") == k).drop("_bucket")
            return rows if old is None else latest(old.select(*rows.columns).unionByName(rows))

        store.merge(spark, catalog, touched, merged, keep)
        store.discard(fresh)

    return versions.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_catalog(spark: SparkSession, catalog: str, schema: StructType | str, number: int | None = None) -> DataFrame:
    """What the catalog has now, or had as of a version; without tombstones."""
    found = store.read(spark, catalog, number)
    if found is None:
        return spark.createDataFrame([], schema)
    return found.where("not coalesce(deleted, false)").drop("deleted") if "deleted" in found.columns else found


def first_in_window(rows: DataFrame, keys: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Rows whose keys haven't come within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def drain(rows: DataFrame, tag: str) -> DataFrame:
    """Run an append stream over all there is, into a table of the shared folder."""
    spark = rows.sparkSession
    path = store.new_path(spark, tag)
    query = rows.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/out")


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by type and tumbling window."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type")
    return grouped.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
