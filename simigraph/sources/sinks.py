"""Exports, reports and action plans. Nothing here deletes a catalogued file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simigraph.functions import names
from simigraph.sources import json_array

MATCH_COLUMNS = ("path_a", "path_b", "file_a_size", "file_b_size", "confidence_score", "category", "scores")


MATCHES = "path_a string, path_b string, file_a_size long, file_b_size long, confidence_score double, category string, scores map<string,double>"


def write_csv(matches: DataFrame, path: str, compression: str = "none") -> None:
    """A folder of files; with ``compression`` gzip about a tenth of the disk or less."""
    rows = matches.withColumn("scores", F.to_json("scores")).select(*MATCH_COLUMNS)
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("compression", compression).csv(path)


def write_json(matches: DataFrame, path: str, compression: str = "none") -> None:
    """One file with an array of all matches, in their order."""
    json_array.write(matches.select(*MATCH_COLUMNS), path, compression=compression)


def read_json(spark: SparkSession, path: str, compression: str = "none") -> DataFrame:
    return json_array.read(spark, path, MATCHES, compression)


def write_json_lines(matches: DataFrame, path: str) -> None:
    """A folder of files with a match a line."""
    matches.select(*MATCH_COLUMNS).write.mode("overwrite").json(path)


def write_columns(matches: DataFrame, path: str, format: str = "parquet") -> None:
    rows = matches.withColumn("scores_json", F.to_json("scores")).drop("scores")
    writer = rows.write.mode("overwrite")
    writer.option("header", True).option("escape", '"').csv(path) if format == "csv" else writer.format(format).save(path)


def group_lines(groups: DataFrame) -> DataFrame:
    """``MATCH_GROUP_i:path,path`` for (group_no, path)."""
    listed = groups.groupBy("group_no").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("paths"))
    return listed.select("group_no", F.concat(F.lit("MATCH_GROUP_"), F.col("group_no").cast("string"), F.lit(":"), "paths").alias("line"))


def match_table(matches: DataFrame) -> DataFrame:
    """Names and readable sizes of each pair."""
    name = lambda c: names.basename(F.col(c))
    return matches.select(name("path_a").alias("name_a"), names.human_size(F.col("file_a_size")).alias("size_a"), name("path_b").alias("name_b"), names.human_size(F.col("file_b_size")).alias("size_b"), "confidence_score", "category")


def number_by_score(matches: DataFrame) -> DataFrame:
    """Adds group_no, by falling confidence and then the paths.

    Numbers come from ranges of the order, counted apart, so that no task has
    to see all pairs.
    """
    order = [F.desc("confidence_score"), F.asc("path_a"), F.asc("path_b")]
    return global_number(matches, order, "group_no")


def global_number(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    from simigraph import store

    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = store.materialise(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    # As many rows as partitions.
    counts = ranged.groupBy("_part").count().orderBy("_part").collect()
    base, starts = 0, []
    for r in counts:
        starts.append((r["_part"], base))
        base += r["count"]
    offsets = F.broadcast(spark.createDataFrame(starts, "_part int, _base long"))
    numbered = ranged.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return numbered.join(offsets, "_part").withColumn(name, F.col("_row") + F.col("_base")).drop("_part", "_row", "_base")


def grid(matches: DataFrame) -> DataFrame:
    """Two rows for each numbered pair."""
    side = lambda s: F.struct(F.col(f"path_{s}").alias("path"), F.col(f"file_{s}_size").alias("size"), F.lit(s).alias("side"))
    rows = matches.select("group_no", "confidence_score", F.explode(F.array(side("a"), side("b"))).alias("f"))
    return rows.select("group_no", "f.side", names.basename(F.col("f.path")).alias("name"), names.human_size(F.col("f.size")).alias("size_text"), "confidence_score", F.col("f.path").alias("full_path"))


def action_plan(selected: DataFrame, action: str = "dry_run", backup_dir: str | None = None) -> DataFrame:
    """What would be done with each selected path, once for each; names that collide in the backup folder are marked.

    ``action`` is dry_run, recycle, permanent or move.
    """
    if action not in ("dry_run", "recycle", "permanent", "move"):
        raise ValueError(f"unknown action {action}")
    if action == "move" and not backup_dir:
        raise ValueError("moving needs a folder")
    once = selected.select("path").distinct()
    target = F.concat(F.lit((backup_dir or "").rstrip("/") + "/"), names.basename(F.col("path"))) if action == "move" else F.lit(None).cast("string")
    plan = once.select("path", F.lit(action).alias("action"), target.alias("target"))
    if action != "move":
        return plan.withColumn("collides", F.lit(False))
    twice = plan.groupBy("target").agg(F.count("*").alias("_n")).where("_n > 1").withColumn("collides", F.lit(True)).drop("_n")
    return plan.join(twice, "target", "left").select("path", "action", "target", F.coalesce("collides", F.lit(False)).alias("collides"))
