"""Which member of a group stays, and which are selected to go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _orders() -> dict[str, list[Column]]:
    up, down = F.asc, F.desc
    return {
        "keep_largest": [down("size"), up("path")],
        "keep_smallest": [up("size"), up("path")],
        "keep_newest": [down("mtime"), up("path")],
        "keep_oldest": [up("mtime"), up("path")],
        "select_older": [down("mtime"), down("path")],
        "select_larger": [up("size"), up("path")],
        "select_smaller": [down("size"), down("path")],
        "all_but_one": [up("path")],
    }


STRATEGIES = ("keep_largest", "keep_smallest", "keep_newest", "keep_oldest", "select_older", "select_larger", "select_smaller", "all_but_one")


def mark(files: DataFrame, strategy: str, group: str = "group_id") -> DataFrame:
    """Adds ``selected``: false for the one file of each group that stays.

    The one that stays is an aggregate, summed up before shuffling; a group may
    be of any size.
    """
    # max_by over a struct of keys, each turned so that the first in order is the largest, can't turn text;
    # so ties are settled in a second step.
    columns = {"keep_largest": ("size", 1), "keep_smallest": ("size", -1), "keep_newest": ("mtime", 1), "keep_oldest": ("mtime", -1), "select_older": ("mtime", 1), "select_larger": ("size", -1), "select_smaller": ("size", 1)}
    last = strategy in ("select_older", "select_smaller")
    if strategy == "all_but_one":
        kept = files.groupBy(group).agg(F.min("path").alias("_kept"))
    else:
        column, sign = columns[strategy]
        best = files.groupBy(group).agg((F.max(column) if sign > 0 else F.min(column)).alias("_best"))
        tied = files.join(best, group).where(F.col(column) == F.col("_best"))
        kept = tied.groupBy(group).agg((F.max("path") if last else F.min("path")).alias("_kept"))
    return files.join(kept, group).withColumn("selected", F.col("path") != F.col("_kept")).drop("_kept")


def ranked(files: DataFrame, strategy: str, group: str = "group_id") -> DataFrame:
    """Adds the place of each file in its group's order, 1 for the one that stays."""
    return files.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*_orders()[strategy])))


def pair_members(pairs: DataFrame) -> DataFrame:
    """A group of two for each pair: pair_id, path, size."""
    side = lambda s: F.struct(F.col(f"path_{s}").alias("path"), F.col(f"file_{s}_size").alias("size"))
    rows = pairs.select(F.concat_ws("|", "path_a", "path_b").alias("group_id"), F.explode(F.array(side("a"), side("b"))).alias("f"))
    return rows.select("group_id", "f.path", "f.size")


def selection(files: DataFrame, strategy: str, group: str = "group_id") -> DataFrame:
    """Distinct selected paths over all groups."""
    return mark(files, strategy, group).where("selected").select("path").distinct()
