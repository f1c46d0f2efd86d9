"""What the corpus operators share: tables, names, words. Tables between steps are those of ``simigraph.store``."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simigraph.store import delete_path, discard, exists, materialise, new_path, shared_dir, ship

__all__ = ["SPACE", "WORD", "delete_path", "discard", "exists", "fresh_name", "lower_ascii", "materialise", "new_path", "shared_dir", "ship", "shuffle_partitions", "table", "text_or_empty"]

#: White space that separates words in every word rule of this package.
SPACE = r" \t\n\x0B\f\r"
WORD = r"[^ \t\n\x0B\f\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(taken: Iterable[str], name: str) -> str:
    """The name, with underscores before it until no column has it, whatever the case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, and no other letter."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
