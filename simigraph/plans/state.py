"""Incremental scans, caches, streams."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simigraph import store
from simigraph.config import Config
from simigraph.functions import names
from simigraph.functions.digests import full_hash
from simigraph.operators import exact, incremental
from simigraph.plans.exact import CHUNK
from simigraph.plans.registry import ORACLE, query
from simigraph.progress import Progress
from simigraph.sources import caches, catalog, ranged
from simigraph.sources.catalog import DOCUMENT_FILES, document_files, table
from simigraph.streaming import scans, versions

# The stored catalog: every file but each seventh, each fifth with another time, and some that are gone.
OLD_SQL = f"WITH listing AS (SELECT path, size, mtime, CAST(regexp_extract(path, 'doc_([0-9]+)', 1) AS BIGINT) AS k FROM ({DOCUMENT_FILES})), old AS (SELECT path, size, CASE WHEN k % 5 = 0 THEN mtime - 10 ELSE mtime + 0.001 END AS mtime FROM listing WHERE k % 7 <> 0 UNION ALL SELECT '/gone' || path, size, mtime FROM listing WHERE k % 11 = 0) "


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_files(spark, sf_dir).select("path", "size", "mtime")


def old(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing(spark, sf_dir).withColumn("k", F.regexp_extract("path", r"doc_([0-9]+)", 1).cast("long"))
    kept = rows.where("k % 7 <> 0").select("path", "size", F.when(F.col("k") % 5 == 0, F.col("mtime") - 10).otherwise(F.col("mtime") + 0.001).alias("mtime"))
    return kept.unionByName(rows.where("k % 11 = 0").select(F.concat(F.lit("/gone"), "path").alias("path"), "size", "mtime"))


_STATUS = OLD_SQL + ", state AS (SELECT l.path, l.size, l.mtime, CASE WHEN o.path IS NULL THEN 'new' WHEN abs(l.mtime - o.mtime) < 0.01 AND l.size = o.size THEN 'reused' ELSE 'changed' END AS status FROM listing l LEFT JOIN old o ON l.path = o.path) "


@query("j07_cache_reuse", _STATUS + "SELECT path, status FROM state")
def j07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.classify(listing(spark, sf_dir), old(spark, sf_dir)).select("path", "status")


@query("j08_stale", OLD_SQL + "SELECT o.path FROM old o LEFT JOIN listing l ON o.path = l.path WHERE l.path IS NULL")
def j08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.stale(old(spark, sf_dir), listing(spark, sf_dir)).select("path")


@query("k05_purge", OLD_SQL + "SELECT o.path, o.size FROM old o JOIN listing l ON o.path = l.path")
def k05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.purge(old(spark, sf_dir), listing(spark, sf_dir)).select("path", "size")


@query("k04_upsert", _STATUS + "SELECT path, size, mtime FROM state WHERE status <> 'reused' UNION ALL SELECT path, size, mtime FROM old WHERE path NOT IN (SELECT path FROM state WHERE status <> 'reused')")
def k04(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = old(spark, sf_dir)
    fresh = incremental.classify(listing(spark, sf_dir), catalog).where("status <> 'reused'")
    return incremental.upsert(catalog.select("path", "size", "mtime"), fresh)


@query("s04_incremental_scan", _STATUS + "SELECT s.path, s.size, CASE WHEN s.status = 'reused' THEN o.mtime ELSE s.mtime END AS mtime FROM state s LEFT JOIN old o ON s.path = o.path")
def s04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored, read back with its columns, refreshed."""
    path = store.new_path(spark, "catalog")
    old(spark, sf_dir).withColumn("tokens", F.array("path")).transform(lambda d: caches.write_catalog(d, path) or d)
    catalog = caches.read_catalog(spark, path).select("path", "size", "mtime")
    return incremental.refresh(listing(spark, sf_dir), catalog, lambda d: d)


@query("s08_stored_matches", "SELECT '/o/' || CAST(l_orderkey AS VARCHAR) AS path_a, '/p/' || CAST(l_partkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) AS path_b, l_quantity * 2 AS confidence_score, '{\"exact_match\":' || CAST(l_quantity AS VARCHAR) || '}' AS scores FROM lineitem")
def s08(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("/o/"), text("l_orderkey")).alias("path_a"), F.concat(F.lit("/p/"), text("l_partkey"), F.lit("/"), text("l_linenumber")).alias("path_b"), (F.col("l_quantity") * 2).alias("confidence_score"), F.create_map(F.lit("exact_match"), F.col("l_quantity")).alias("scores"))
    path = store.new_path(spark, "matches")
    caches.write_matches(rows, path)
    return caches.read_matches(spark, path).withColumn("scores", F.to_json("scores"))


@query("f08_cached_hashes", "SELECT e.event_id AS path, CAST(CASE WHEN e.user_id % 3 = 0 THEN e.user_id END AS BIGINT) AS hash FROM events e")
def f08(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    files = e.select(F.col("event_id").alias("path"), F.col("ts").cast("string").alias("mtime"))
    cache = e.where("user_id % 3 = 0").select(F.col("event_id").alias("path"), F.col("ts").cast("string").alias("mtime"), F.array(F.col("user_id").cast("long")).alias("hashes"))
    return incremental.cached_hashes(files, cache).select("path", F.element_at("hashes", 1).alias("hash"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a stream; the pattern fits a file as well as a folder of files."""
    events = scans.file_stream(spark, f"{sf_dir}/events.parque[t]", table(spark, sf_dir, "events").schema)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


BUCKETS = 2


@query("r01_stream_catalog", "SELECT CAST(user_id AS VARCHAR) AS path, max(epoch_us(ts)) / 1000000.0::DOUBLE AS mtime FROM events GROUP BY user_id")
def r01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of a file for each user; the stream keeps the latest."""
    rows = event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("size"), (F.unix_micros("ts") / 1e6).alias("mtime"))
    path = store.new_path(spark, "stream")
    scans.keep_catalog(rows, f"{path}/catalog", f"{path}/log", BUCKETS).awaitTermination()
    return scans.read_catalog(spark, f"{path}/catalog", "path string, size long, mtime double").select("path", "mtime")


@query("r01_stream_versions", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type = 'error' DESC, event_id DESC) AS rn FROM events) SELECT CAST(user_id AS VARCHAR) AS path, event_id AS size, epoch_us(ts) / 1000000.0::DOUBLE AS mtime FROM r WHERE rn = 1 AND event_type <> 'error'")
def r01_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of a file for each user, of which some are deletions; keyed state passes on the newer ones, the catalog keeps them."""
    rows = event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("size"), (F.unix_micros("ts") / 1e6).alias("mtime"), (F.col("event_type") == "error").alias("deleted"), "ts")
    path = store.new_path(spark, "versions")
    with versions.keyed_state(spark):
        kept = scans.keep_catalog(versions.changes(rows, late="3650 days"), f"{path}/catalog", f"{path}/log", BUCKETS)
    kept.awaitTermination()
    return scans.read_catalog(spark, f"{path}/catalog", "path string, size long, mtime double")


@query("r01_stream_dedup", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1, 2")
def r01_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type; the watermark is longer than the data, so all later ones go."""
    first = scans.first_in_window(event_stream(spark, sf_dir), ["user_id", "event_type"], late="3650 days")
    return scans.drain(first, "dedup").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("k04_latest_version", "SELECT user_id AS path, max(ts) AS ts FROM events GROUP BY user_id")
def k04_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("ts").alias("mtime"), F.col("event_id").alias("size"))
    return incremental.latest(e).select("path", F.col("mtime").alias("ts"))


class Stopped(Exception):
    pass


def resumed(work: DataFrame, make: Callable[[DataFrame, int], DataFrame], made: str, batch: Column) -> DataFrame:
    """What two runs make of the work (path, mtime): the first is stopped after two of four batches. ``run`` is the one that made a row."""
    cache, schema = store.new_path(work.sparkSession, "resumed"), f"path string, mtime double, {made}, run int"

    def stop(p: Progress) -> None:
        if (p.kind, p.done) == ("batch", 2):
            raise Stopped

    with contextlib.suppress(Stopped):
        incremental.resumable(work, cache, lambda todo, k: make(todo, k).withColumn("run", F.lit(1)), schema, 4, batch, stop)
    return incremental.resumable(work, cache, lambda todo, k: make(todo, k).withColumn("run", F.lit(2)), schema, 4, batch)


def written_documents(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A file for each document below a new folder, and their listing with paths as ``document_files`` has them."""
    root = store.new_path(spark, "documents")
    ranged.write_files(document_files(spark, sf_dir), root)
    return ranged.local(root), ranged.ranged_files(spark, [root])


@query("s03_ranged_listing", f"SELECT path, size FROM ({DOCUMENT_FILES}) WHERE size >= 1000 AND path LIKE '/src1%'")
def s03_ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of some folders from a size up; the filters are the listing's own where the session lets them through."""
    root, files = written_documents(spark, sf_dir)
    some = files.where((F.col("size") >= 1000) & F.col("path").startswith(f"{root}/src1") & (F.col("extension") == ".txt"))
    return some.select(F.substr("path", F.lit(len(root) + 1)).alias("path"), "size")


@query("a02_ranged_groups", ORACLE["a02_quick_groups"])
def a02_ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of files of equal size, of which only the ends are read."""
    root, files = written_documents(spark, sf_dir)
    return exact.quick_groups_of_files(files, CHUNK).select(F.substr("path", F.lit(len(root) + 1)).alias("path"), "size", "quick")


@query("a03_ranged_groups", ORACLE["a03_exact_groups"])
def a03_ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, files = written_documents(spark, sf_dir)
    return exact.exact_groups_of_files(files, CHUNK).select("sha256", F.substr("path", F.lit(len(root) + 1)).alias("path"), "size")


@query("r03_resumed_hashing", "SELECT doc_id, sha256(text) AS sha256, CASE WHEN doc_id % 4 < 2 THEN 1 ELSE 2 END AS run FROM documents")
def r03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full hashes of files by batches, into a cache; the first run is stopped after two batches, the second makes the others."""
    _, files = written_documents(spark, sf_dir)
    key = F.regexp_extract("path", r"doc_([0-9]+)\.txt$", 1).cast("long")
    out = resumed(files.select("path", "size", "mtime"), lambda todo, _: ranged.digests(todo).drop("size", "bytes_read"), "sha256 string", key % 4)
    return out.select(key.alias("doc_id"), "sha256", "run")


@query("r05_progress", f"WITH c AS (SELECT k % 4 AS b, count(*) AS n, max(path) AS last FROM (SELECT path, CAST(regexp_extract(path, 'doc_([0-9]+)', 1) AS BIGINT) AS k FROM ({DOCUMENT_FILES})) GROUP BY 1) SELECT 'files' AS kind, CAST(sum(n) OVER (ORDER BY b) AS BIGINT) AS done, last AS item FROM c UNION ALL SELECT 'batch', CAST(b + 1 AS BIGINT), '' FROM c")
def r05_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listener hears of digests made in four batches: how many files there are so far and the last one's name, and which batches are done."""
    files, heard = document_files(spark, sf_dir), []
    key = F.regexp_extract("path", r"doc_([0-9]+)", 1).cast("long") % 4

    def make(todo: DataFrame, k: int) -> DataFrame:
        return todo.withColumn("key", F.md5("path"))

    incremental.resumable(files.select("path", "mtime"), store.new_path(spark, "progress"), make, "path string, mtime double, key string", 4, key, heard.append)
    return spark.createDataFrame([(p.kind, p.done, p.item if p.kind == "files" else "") for p in heard], "kind string, done long, item string")


@query("s10_digest_cache", f"SELECT lower(path) AS path_key, CAST(mtime AS BIGINT) AS ticks, size, sha256(content) AS sha256 FROM ({DOCUMENT_FILES})")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests written to their cache and read back."""
    path = store.new_path(spark, "digests")
    files = document_files(spark, sf_dir)
    caches.write_digests(files.select(F.upper("path").alias("path"), F.col("mtime").cast("long").alias("ticks"), "size", full_hash(F.col("content")).alias("sha256")), path)
    return caches.read_digests(spark, path, lines=True)


@query("s01_list_files", "SELECT 'n_regionkey=' || CAST(n_regionkey AS VARCHAR) AS folder, CAST(sum(strlen(n_name) + 1) AS BIGINT) AS bytes FROM nation GROUP BY 1")
def s01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files of the nations in a folder for each region, listed without reading them."""
    path = store.new_path(spark, "files")
    table(spark, sf_dir, "nation").select("n_name", "n_regionkey").write.partitionBy("n_regionkey").text(path)
    listed = catalog.without(catalog.list_files(spark, [path], extensions=[".TXT"]), [f"{path}/_SUCCESS"])
    return listed.groupBy(names.basename(names.parent(F.col("path"))).alias("folder")).agg(F.sum("size").alias("bytes"))


@query("f13_own_cache", f"SELECT path FROM ({DOCUMENT_FILES}) WHERE path NOT LIKE '%/doc_3.txt'")
def f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan that leaves out the engine's own file, however its name is written."""
    files = document_files(spark, sf_dir).select("path")
    own = [f"/SRC{k}\\{lang}\\DOC_3.TXT" for k in range(100) for lang in ("EN", "DE", "FR", "ES")]
    return catalog.without(files, own)


@query("s14_config", "SELECT n_name, c.strong, c.prefix, c.folders FROM nation, LATERAL (SELECT n_nationkey * 2.0::DOUBLE + 40 AS strong, CASE WHEN n_nationkey % 2 = 0 THEN 4 ELSE n_nationkey END AS prefix, CASE WHEN n_regionkey = 0 THEN '' ELSE '.git,region' || CAST(n_regionkey AS VARCHAR) END AS folders) c")
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of each nation: what its row sets is merged into the defaults, row by row in the tasks; unknown keys are passed over."""

    def merged(key: int, region: int) -> tuple[float, int, str]:
        changes = {"thresholds": {"highly_likely": key * 2.0 + 40}, "blocking": {"prefix_length": key} if key % 2 else None, "unknown": {"x": 1}}
        if region:
            changes["scan"] = {"exclude_folders": [".git", f"region{region}"]}
        c = Config().merged(changes)
        return c.thresholds.highly_likely, c.blocking.prefix_length, ",".join(c.scan.exclude_folders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [merged(k, r) for k, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.float64(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["n_name", "strong", "prefix", "folders"])

    store.ship(spark)
    n = table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").cast("int"), F.col("n_regionkey").cast("int"))
    return n.mapInArrow(run, "n_name string, strong double, prefix int, folders string")
