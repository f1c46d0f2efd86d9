"""Scans that reuse what an earlier scan has stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from simigraph import store
from simigraph.progress import Listener, Progress, observed

MTIME_TOLERANCE = 0.01


def unchanged(mtime: Column, size: Column, old_mtime: Column, old_size: Column) -> Column:
    return (F.abs(mtime - old_mtime) < MTIME_TOLERANCE) & (size == old_size)


def classify(listing: DataFrame, catalog: DataFrame) -> DataFrame:
    """The listing (path, size, mtime) with its status: reused, changed or new."""
    old = catalog.select(F.col("path").alias("_path"), F.col("mtime").alias("_mtime"), F.col("size").alias("_size"))
    joined = listing.join(old, F.col("path") == F.col("_path"), "left")
    same = unchanged(F.col("mtime"), F.col("size"), F.col("_mtime"), F.col("_size"))
    status = F.when(F.col("_path").isNull(), F.lit("new")).when(same, F.lit("reused")).otherwise(F.lit("changed"))
    return joined.withColumn("status", status).drop("_path", "_mtime", "_size")


def stale(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """Catalog rows whose file is gone."""
    return catalog.join(listing.select("path"), "path", "left_anti")


def purge(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    return catalog.join(listing.select("path"), "path", "left_semi")


def upsert(catalog: DataFrame, fresh: DataFrame) -> DataFrame:
    """The catalog with rows replaced or added by path."""
    return catalog.join(fresh.select("path"), "path", "left_anti").unionByName(fresh.select(*catalog.columns))


def refresh(listing: DataFrame, catalog: DataFrame, process) -> DataFrame:
    """Reused rows as stored, ``process`` of the others, and nothing that is gone."""
    state = classify(listing, catalog)
    reused = catalog.join(state.where("status = 'reused'").select("path"), "path", "left_semi")
    made = process(state.where("status <> 'reused'").drop("status"))
    return reused.unionByName(made.select(*catalog.columns))


def latest(versions: DataFrame) -> DataFrame:
    """Of each path the version with the greatest mtime (ties: the larger size, then the other columns in order)."""
    rest = [c for c in versions.columns if c != "path"]
    last = versions.groupBy("path").agg(F.max(F.struct(F.struct("mtime", "size").alias("_at"), F.struct(*rest).alias("_v"))).alias("_m")).select("path", F.col("_m._v").alias("_v"))
    return last.select("path", *(F.col(f"_v.{c}").alias(c) for c in rest))


def cached_hashes(files: DataFrame, cache: DataFrame, by: str = "mtime") -> DataFrame:
    """Files with their cached hashes where path and stamp agree, null elsewhere."""
    stored = cache.select(F.col("path").alias("_p"), F.col(by).alias("_m"), "hashes")
    return files.join(stored, (F.col("path") == F.col("_p")) & (F.col(by) == F.col("_m")), "left").drop("_p", "_m")


def not_candidates(files: DataFrame, candidates: DataFrame) -> DataFrame:
    """Files that an early step has ruled out, as skipped."""
    return files.join(candidates.select("path").distinct(), "path", "left_anti").select("path", F.lit("skipped").alias("status"))


def resumable(work: DataFrame, cache: str, make: Callable[[DataFrame, int], DataFrame], schema: str, batches: int = 8, batch: Column | None = None, listener: Listener | None = None) -> DataFrame:
    """``make`` of the work (path, mtime, ...; no contents) batch by batch, each committed to the cache when it is done.

    A run that was stopped goes on where it ended: paths that the cache has with
    the same mtime aren't made again. The work is written once, dealt to batches by
    ``batch`` or a hash of the path; a batch reads its own part of the work and
    its own bucket of the cache, and ``make``, which gets what is missing and the
    batch's number, opens what these name. So everything is read once in all. A
    bucket is rewritten with its old rows and the new ones of the same paths
    replaced, so the cache stays as few files and can be kept by several runs at
    once (``store.merge``). ``schema`` is of what ``make`` returns, which has path
    and mtime. The listener hears how many files have been made and the last one's
    name, and how many batches are done.
    """
    spark = work.sparkSession
    number = F.pmod(F.xxhash64("path"), F.lit(batches)) if batch is None else batch
    dealt = store.new_path(spark, "work")
    work.withColumn("_batch", number.cast("int")).write.partitionBy("_batch").option("compression", "zstd").parquet(dealt)
    listed = spark.read.schema(StructType([*work.schema.fields]).add("_batch", "integer")).parquet(dealt)
    files = 0
    for k in range(batches):
        old = store.read(spark, cache, bucket=k)
        todo = listed.where(F.col("_batch") == k).drop("_batch")
        if old is not None:
            todo = todo.join(old.select("path", "mtime"), ["path", "mtime"], "left_anti")
        todo, counted = observed(todo)
        todo = store.materialise(todo, "todo")
        n, last = counted()
        if n:
            made = store.materialise(make(todo, k), "made")

            def merged(_: int, rows: DataFrame | None, made: DataFrame = made) -> DataFrame:
                return made if rows is None else upsert(rows, made)

            store.merge(spark, cache, [k], merged)
            store.discard(made)
        store.discard(todo)
        if listener:
            files += n
            listener(Progress("files", files, files, last))
            listener(Progress("batch", k + 1, batches, cache))
    found = store.read(spark, cache)
    found = spark.createDataFrame([], schema) if found is None else found
    return listed.select("path", "mtime").join(found, ["path", "mtime"])
