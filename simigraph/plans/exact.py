"""Byte-identical files, survivors, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simigraph import store
from simigraph.operators import exact, survivors
from simigraph.plans.registry import query
from simigraph.sources import sinks
from simigraph.sources.catalog import DOCUMENT_FILES, document_files

FILES = f"WITH files AS ({DOCUMENT_FILES}), sized AS (SELECT *, count(*) OVER (PARTITION BY size) AS k FROM files), hashed AS (SELECT path, size, mtime, sha256(content) AS sha256, count(*) OVER (PARTITION BY sha256(content)) AS n FROM files), groups AS (SELECT path, size, mtime, sha256 FROM hashed WHERE n > 1) "
CHUNK = 1024
_QUICK = f"md5(CASE WHEN size > {CHUNK} THEN c[1:{CHUNK}] || c[size - {CHUNK - 1}:size] ELSE c || c END)"
BYTES = f"SELECT path, size, encode(content) AS c FROM ({DOCUMENT_FILES})"


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(document_files(spark, sf_dir))


@query("a01_size_groups", FILES + "SELECT path, size FROM sized WHERE k > 1")
def a01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.size_groups(document_files(spark, sf_dir)).select("path", "size")


@query("a02_quick_groups", f"WITH f AS ({BYTES}), q AS (SELECT path, size, {_QUICK} AS quick FROM f), g AS (SELECT *, count(*) OVER (PARTITION BY size, quick) AS k FROM q) SELECT path, size, quick FROM g WHERE k > 1")
def a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.quick_groups(document_files(spark, sf_dir), CHUNK).select("path", "size", "quick")


@query("x08_quick_signature", f"WITH f AS ({BYTES}) SELECT path, {_QUICK} AS quick FROM f")
def x08(spark: SparkSession, sf_dir: str) -> DataFrame:
    from simigraph.functions.digests import quick_signature

    return document_files(spark, sf_dir).select("path", quick_signature(F.col("content"), CHUNK).alias("quick"))


@query("x09_full_hash", f"WITH files AS ({DOCUMENT_FILES}) SELECT path, sha256(content) AS sha256 FROM files")
def x09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_files(spark, sf_dir).select("path", F.sha2("content", 256).alias("sha256"))


@query("a03_exact_groups", FILES + "SELECT sha256, path, size FROM groups")
def a03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark, sf_dir).select("sha256", "path", "size")


@query("a04_hash_groups", FILES + "SELECT sha256, count(*) AS files, min(path) AS first FROM groups GROUP BY sha256")
def a04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.hash_groups(document_files(spark, sf_dir)).groupBy("sha256").agg(F.count("*").alias("files"), F.min("path").alias("first"))


STARS = FILES + ", firsts AS (SELECT *, first_value(path) OVER (PARTITION BY sha256 ORDER BY path) AS p, first_value(size) OVER (PARTITION BY sha256 ORDER BY path) AS s FROM groups), stars AS (SELECT p AS path_a, path AS path_b, s AS file_a_size, size AS file_b_size, 100.0::DOUBLE AS confidence_score FROM firsts WHERE path <> p) "


@query("a07_star_pairs", STARS + "SELECT * FROM stars")
def a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.star_pairs(groups(spark, sf_dir))


@query("a09_wasted_pairs", STARS + "SELECT CAST(coalesce(sum(least(file_a_size, file_b_size)), 0) AS BIGINT) AS wasted_bytes, count(*) AS pairs FROM stars")
def a09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.wasted_in_pairs(exact.star_pairs(groups(spark, sf_dir)))


@query("a10_wasted_groups", FILES + ", r AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY path) AS rn FROM groups) SELECT CAST(coalesce(sum(CASE WHEN rn > 1 THEN size END), 0) AS BIGINT) AS wasted_bytes, count(DISTINCT sha256) AS groups, count(*) AS files FROM r")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.wasted_in_groups(groups(spark, sf_dir))


@query("a11_funnel", f"WITH f AS ({BYTES}), a AS (SELECT *, {_QUICK} AS quick, sha256(c) AS sha, count(*) OVER (PARTITION BY size) AS k FROM f), b AS (SELECT *, count(*) OVER (PARTITION BY size, quick) AS q, count(*) OVER (PARTITION BY sha) AS n FROM a) SELECT count(*) AS scanned, count(*) FILTER (WHERE k > 1) AS same_size, count(*) FILTER (WHERE q > 1) AS same_quick, count(*) FILTER (WHERE n > 1) AS exact_files, count(DISTINCT CASE WHEN n > 1 THEN sha END) AS groups FROM b")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.funnel(document_files(spark, sf_dir), CHUNK)


@query("f05_repeated_keys", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(*) > 1")
def f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey")
    return exact.repeated(rows, ["l_partkey"]).groupBy("l_partkey").agg(F.count("*").alias("n"))


# Survivors, over the orders of a customer as groups of files.

ORDER_FILES = "SELECT o_custkey AS group_id, '/o/' || CAST(o_orderkey AS VARCHAR) AS path, CAST(round(o_totalprice / 1000) AS BIGINT) AS size, CAST(o_orderkey % 97 AS DOUBLE) AS mtime FROM orders"


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_custkey").alias("group_id"), F.concat(F.lit("/o/"), F.col("o_orderkey").cast("string")).alias("path"), F.round(F.col("o_totalprice") / 1000).cast("long").alias("size"), (F.col("o_orderkey") % 97).cast("double").alias("mtime"))


_SQL_ORDER = {
    "keep_largest": "size DESC, path", "keep_smallest": "size, path", "keep_newest": "mtime DESC, path", "keep_oldest": "mtime, path",
    "select_older": "mtime DESC, path DESC", "select_larger": "size, path", "select_smaller": "size DESC, path DESC", "all_but_one": "path",
}


def _survivor(number: int, strategy: str) -> None:
    sql = f"WITH f AS ({ORDER_FILES}), r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY {_SQL_ORDER[strategy]}) AS rn FROM f) SELECT group_id, path, rn > 1 AS selected FROM r"

    @query(f"w0{number}_{strategy}", sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return survivors.mark(order_files(spark, sf_dir), strategy).select("group_id", "path", "selected")


for _i, _s in enumerate(survivors.STRATEGIES, 1):
    _survivor(_i, _s)


@query("t05_ranked_in_group", f"WITH f AS ({ORDER_FILES}) SELECT group_id, path, CAST(row_number() OVER (PARTITION BY group_id ORDER BY size DESC, path) AS INTEGER) AS place FROM f")
def t05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.ranked(order_files(spark, sf_dir), "keep_largest").select("group_id", "path", "place")


@query("w09_pair_selection", STARS + ", m AS (SELECT path_a || '|' || path_b AS g, path_a AS path, file_a_size AS size FROM stars UNION ALL SELECT path_a || '|' || path_b, path_b, file_b_size FROM stars), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY size DESC, path DESC) AS rn FROM m) SELECT DISTINCT path FROM r WHERE rn > 1")
def w09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.selection(survivors.pair_members(exact.star_pairs(groups(spark, sf_dir))), "select_smaller")


NUMBERED = STARS + ", numbered AS (SELECT *, row_number() OVER (ORDER BY confidence_score DESC, path_a, path_b) AS group_no FROM stars) "


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.number_by_score(store.materialise(exact.star_pairs(groups(spark, sf_dir)), "stars"))


@query("w10_group_no", NUMBERED + "SELECT group_no, path_a, path_b FROM numbered")
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(spark, sf_dir).select("group_no", "path_a", "path_b")


GROUP_NO = FILES + ", firsts AS (SELECT sha256, min(path) AS first FROM groups GROUP BY sha256), nos AS (SELECT sha256, row_number() OVER (ORDER BY first) AS group_no FROM firsts) "


@query("k10_group_lines", GROUP_NO + "SELECT group_no, 'MATCH_GROUP_' || CAST(group_no AS VARCHAR) || ':' || string_agg(path, ',' ORDER BY path) AS line FROM groups JOIN nos USING (sha256) GROUP BY group_no")
def k10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = store.materialise(groups(spark, sf_dir), "groups")
    firsts = found.groupBy("sha256").agg(F.min("path").alias("first"))
    nos = sinks.global_number(firsts, [F.asc("first")], "group_no").select("sha256", "group_no")
    return sinks.group_lines(found.join(nos, "sha256"))


@query("k09_group_report", FILES + "SELECT sha256, count(*) AS files, string_agg(path, chr(10) ORDER BY path) AS paths FROM groups GROUP BY sha256")
def k09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark, sf_dir).groupBy("sha256").agg(F.count("*").alias("files"), F.array_join(F.array_sort(F.collect_list("path")), "\n").alias("paths"))


@query("k12_result_grid", NUMBERED + "SELECT group_no, 'a' AS side, regexp_extract(path_a, '([^/]*)$', 1) AS name, path_a AS full_path FROM numbered UNION ALL SELECT group_no, 'b', regexp_extract(path_b, '([^/]*)$', 1), path_b FROM numbered")
def k12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.grid(numbered(spark, sf_dir)).select("group_no", "side", "name", "full_path")


@query("k14_action_plan", STARS + ", p AS (SELECT DISTINCT path_b AS path FROM stars), t AS (SELECT path, '/backup/' || regexp_extract(path, '([^/]*)$', 1) AS target FROM p) SELECT path, 'move' AS action, target, count(*) OVER (PARTITION BY target) > 1 AS collides FROM t")
def k14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.action_plan(exact.star_pairs(groups(spark, sf_dir)).select(F.col("path_b").alias("path")), "move", "/backup/")


@query("k13_delete_plan", STARS + "SELECT DISTINCT path_b AS path, 'recycle' AS action FROM stars")
def k13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.action_plan(exact.star_pairs(groups(spark, sf_dir)).select(F.col("path_b").alias("path")), "recycle").select("path", "action")


@query("j13_skipped", f"WITH files AS ({DOCUMENT_FILES}), sized AS (SELECT *, count(*) OVER (PARTITION BY size) AS k FROM files) SELECT path, 'skipped' AS status FROM sized WHERE k = 1")
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from simigraph.operators.incremental import not_candidates

    files = document_files(spark, sf_dir)
    return not_candidates(files, exact.size_groups(files))


@query("s16_parse_protocol", GROUP_NO + ", l AS (SELECT group_no, path, row_number() OVER (PARTITION BY group_no ORDER BY path) - 1 AS pos FROM groups JOIN nos USING (sha256)) SELECT group_no, CAST(pos AS INTEGER) AS pos, path FROM l")
def s16(spark: SparkSession, sf_dir: str) -> DataFrame:
    from simigraph.sources.caches import parse_protocol

    return parse_protocol(k10(spark, sf_dir).select(F.col("line").alias("value")))
