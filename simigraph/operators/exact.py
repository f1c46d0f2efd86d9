"""Byte-identical files: size, then quick signature, then full hash.

A table of contents is read once: signatures and hashes are made in the scan that
reads them, and written as a narrow table, so no content is ever shuffled. Files
that lie in folders aren't read as wholes: ``sources.ranged`` opens the candidates
of each step alone. Counting a key is a partial aggregate before the shuffle; the
keys that repeat are joined back, which a hot key can't overload.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simigraph import store
from simigraph.functions.digests import CHUNK, full_hash, quick_signature
from simigraph.sources import ranged


def _repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are not null and occur more than once."""
    return df.select(*keys).na.drop().groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not null and occurs more than once."""
    return df.join(_repeated_keys(df, keys), list(keys), "left_semi")


def size_groups(files: DataFrame) -> DataFrame:
    """Files of equal size, with all their columns."""
    return files.join(_repeated_keys(files, ["size"]), "size", "left_semi")


def digests(files: DataFrame, chunk: int = CHUNK, full: bool = True) -> DataFrame:
    """path, size, mtime, quick signature and, if ``full``, SHA-256 of all files, as a table: the one scan of contents."""
    made = [quick_signature(F.col("content"), chunk).alias("quick"), *([full_hash(F.col("content")).alias("sha256")] if full else [])]
    return store.materialise(files.select("path", "size", "mtime", *made), "digests")


def quick_groups(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """path, size, mtime and quick of files of equal size and signature."""
    return repeated(digests(files, chunk, full=False), ["size", "quick"])


def exact_groups(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Files of the groups with equal SHA-256: path, size, mtime, sha256."""
    return repeated(repeated(digests(files, chunk), ["size", "quick"]), ["sha256"]).select("path", "size", "mtime", "sha256")


def quick_groups_of_files(listing: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The same of files that lie in folders, from (path, size, mtime): two chunks are read of each file whose size repeats."""
    found = ranged.signatures(store.materialise(size_groups(listing).select("path", "size", "mtime"), "sizes"), chunk)
    return repeated(store.materialise(found.drop("bytes_read"), "signed"), ["size", "quick"])


def exact_groups_of_files(listing: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The same of files that lie in folders: whole files are read only where size and signature repeat."""
    same = store.materialise(quick_groups_of_files(listing, chunk).select("path", "size", "mtime"), "candidates")
    return repeated(store.materialise(ranged.digests(same).drop("bytes_read"), "hashed"), ["sha256"]).select("path", "size", "mtime", "sha256")


def hash_groups(files: DataFrame) -> DataFrame:
    """The same groups by hashing every file."""
    hashed = files.select("path", "size", "mtime", full_hash(F.col("content")).alias("sha256"))
    return repeated(store.materialise(hashed, "hashed"), ["sha256"])


def star_pairs(groups: DataFrame, key: str = "sha256") -> DataFrame:
    """The first path of each group with each other one, at confidence 100."""
    first = groups.groupBy(key).agg(F.min_by(F.struct("path", "size"), "path").alias("first"))
    pairs = groups.join(first, key).where(F.col("path") != F.col("first.path"))
    return pairs.select(F.col("first.path").alias("path_a"), F.col("path").alias("path_b"), F.col("first.size").alias("file_a_size"), F.col("size").alias("file_b_size"), F.lit(100.0).alias("confidence_score"))


def funnel(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row: files scanned, candidates after each step, groups."""
    made = digests(files, chunk)
    quick = size_groups(made)
    same_quick = repeated(quick, ["size", "quick"])
    exact = repeated(same_quick, ["sha256"])
    count = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [count(made, "scanned"), count(quick, "same_size"), count(same_quick, "same_quick"), exact.agg(F.count("*").alias("exact_files"), F.count_distinct("sha256").alias("groups"))]
    out = parts[0]
    for p in parts[1:]:  # one row each
        out = out.crossJoin(p)
    return out


def wasted_in_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.coalesce(F.sum(F.least("file_a_size", "file_b_size")), F.lit(0)).alias("wasted_bytes"), F.count("*").alias("pairs"))


def wasted_in_groups(groups: DataFrame, key: str = "sha256") -> DataFrame:
    """Sizes of all but one of each group; members of a group have one size."""
    each = groups.groupBy(key).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.min_by("size", "path").alias("first"))
    return each.agg(F.coalesce(F.sum(F.col("bytes") - F.col("first")), F.lit(0)).alias("wasted_bytes"), F.count("*").alias("groups"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"))
