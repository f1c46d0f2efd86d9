"""From documents to packed sequences: quality rules, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet and reads again for the next. Null texts fail the quality
rules; repeated rows, null ids, very long texts and empty tables become what the
docstrings of the stages' operators say. Further columns pass through, whatever
their names. This file belongs to the subpackage ``llm`` and goes with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simigraph.llm import common, line_dedup, line_rules, packing, shingle_join, simhash
from simigraph.llm.queries import words_and_end


def _columns(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*like.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that fail."""
    name = common.fresh_name(docs.columns, "rules")
    judged = line_rules.judge(docs, out=name).where(F.col(name)["kept"])
    return _columns(judged.withColumn("text", F.col(name)["text"]), docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of lines; those left without a word go."""
    name = common.fresh_name(docs.columns, "n_deleted")
    out = line_dedup.dedup_lines(docs, count_col=name)
    return _columns(out.where((F.col(name) == 0) | F.col("text").rlike(common.WORD)), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id.

    Pairs come from SimHash fingerprints, and from an index by shingles for those that differ
    in more bits; both are verified (five-word shingles, Jaccard 0.8 or more).
    """
    return simhash.keep_one(docs, found=shingle_join.near_duplicates(docs)).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return packing.pack_documents(docs, words_and_end())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Fingerprints and packing are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
        if before is not None:
            common.discard(before)
        before = docs
    return docs
