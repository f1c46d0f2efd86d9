"""Stored state: catalogs, matches, fingerprint and digest caches."""

from __future__ import annotations

import hashlib
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simigraph import store
from simigraph.config import Normalization

FINGERPRINTS = "path string, mtime string, hashes array<string>"
CATALOG = "path string, filename string, extension string, parent_folder string, size long, mtime double, normalized_name string, tokens string"
MATCHES = "path_a string, path_b string, file_a_size long, file_b_size long, confidence_score double, category string, scores string"
DIGESTS = "Path string, LastWriteTime long, Size long, SHA256 string"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Records with tokens stored as JSON text; none of a catalog that was never written."""
    found = store.read(spark, path)
    if found is None:
        return spark.createDataFrame([], CATALOG)
    return found.withColumn("tokens", F.from_json("tokens", "array<string>"))


def write_catalog(records: DataFrame, path: str) -> None:
    """Replace the catalog; readers see the old one until the new one is whole."""
    store.replace(records.withColumn("tokens", F.to_json("tokens")), path)


def catalog_path(path: str, options: Normalization) -> str:
    """Where the catalog of names normalised by these options lies; other options have another."""
    return f"{path.rstrip('/')}/{hashlib.md5(repr(options).encode()).hexdigest()[:12]}"


def fingerprint_path(path: str, frames_a_second: str) -> str:
    """Where the fingerprints of frames taken at this rate lie, as in 1/10."""
    return f"{path.rstrip('/')}/fps-{frames_a_second.replace('/', '-')}"


def cache_keys(catalog: DataFrame) -> DataFrame:
    return catalog.select("path", "mtime", "size")


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """Stored matches, best first; none of a table that was never written."""
    found = store.read(spark, path)
    if found is None:
        found = spark.createDataFrame([], MATCHES)
    return found.withColumn("scores", F.from_json("scores", "map<string,double>")).orderBy(F.desc("confidence_score"), "path_a", "path_b")


def write_matches(matches: DataFrame, path: str) -> None:
    """Replace the matches; readers see the old ones until the new are whole."""
    store.replace(matches.withColumn("scores", F.to_json("scores")), path)


def clear(spark: SparkSession, path: str) -> None:
    """An empty table of the same columns, as a new version."""
    found = store.read(spark, path)
    if found is not None:
        store.replace(found.limit(0), path)


def read_fingerprints(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """path, mtime, hashes; empty if the file can't be parsed or any entry has the old text hashes.

    The file is an array, or lines as ``write_fingerprints`` writes them.

    Unsigned hashes above the signed range come in as their two's complement.
    """
    raw = spark.read.schema(f"{FINGERPRINTS}, _broken string").option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    number = r"^-?[0-9]+$"
    bad = F.col("_broken").isNotNull() | F.exists("hashes", lambda h: ~h.rlike(number))
    usable = raw.agg(F.count_if(bad).alias("bad"))
    signed = F.transform("hashes", lambda h: F.when(h.cast("decimal(20,0)") >= F.lit(Decimal(2**63)), h.cast("decimal(20,0)") - F.lit(Decimal(2**64))).otherwise(h.cast("decimal(20,0)")).cast("long"))
    return raw.crossJoin(F.broadcast(usable)).where("bad = 0 and path is not null").select("path", "mtime", signed.alias("hashes"))


def read_digests(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Digest cache keyed by lower-cased path; an array, or lines as ``write_digests`` writes them."""
    raw = spark.read.schema(DIGESTS).option("multiLine", not lines).json(path)
    return raw.where("Path is not null").select(F.lower("Path").alias("path_key"), F.col("LastWriteTime").alias("ticks"), F.col("Size").alias("size"), F.lower("SHA256").alias("sha256"))


def write_fingerprints(prints: DataFrame, path: str, kept: DataFrame | None = None) -> None:
    """Lines of JSON with path, mtime and the hashes as unsigned decimal text; ``kept`` are entries to stay where the path isn't new."""
    unsigned = F.transform("hashes", lambda h: F.when(h < 0, h.cast("decimal(20,0)") + F.lit(Decimal(2**64))).otherwise(h.cast("decimal(20,0)")).cast("string"))
    rows = prints.select("path", F.col("mtime").cast("string").alias("mtime"), "hashes")
    if kept is not None:
        rows = rows.unionByName(kept.select("path", F.col("mtime").cast("string").alias("mtime"), "hashes").join(rows.select("path"), "path", "left_anti"))
    rows.withColumn("hashes", unsigned).write.mode("errorifexists").json(path)


def write_digests(digests: DataFrame, path: str) -> None:
    """Digest cache as lines of JSON, from path, ticks, size and sha256."""
    digests.select(F.col("path").alias("Path"), F.col("ticks").cast("long").alias("LastWriteTime"), F.col("size").cast("long").alias("Size"), F.upper("sha256").alias("SHA256")).write.mode("errorifexists").json(path)


def read_protocol(spark: SparkSession, path: str) -> DataFrame:
    """Groups from lines ``MATCH_GROUP_i:path,path``; paths must not have commas."""
    return parse_protocol(spark.read.text(path))


def parse_protocol(lines: DataFrame) -> DataFrame:
    parts = lines.where(F.col("value").startswith("MATCH_GROUP_"))
    number = F.regexp_extract("value", r"^MATCH_GROUP_(\d+):", 1).cast("long")
    paths = F.split(F.regexp_replace("value", r"^MATCH_GROUP_\d+:", ""), ",")
    return parts.select(number.alias("group_no"), F.posexplode(paths).alias("pos", "path"))


def parse_progress(lines: DataFrame) -> DataFrame:
    found = lines.where(F.col("value").rlike(r"\[\d+/\d+\]"))
    return found.select(F.regexp_extract("value", r"\[(\d+)/(\d+)\]", 1).cast("long").alias("done"), F.regexp_extract("value", r"\[(\d+)/(\d+)\]", 2).cast("long").alias("total"))
