"""Operator 7: token counts through a cache of content digests.

The cache is a table of (content digest, tokenizer digest, count). The content
digest is the SHA-256 of the normalised text (a null text is the empty one;
the counts of any two different texts may differ, so nothing more is
normalised away). The tokenizer digest covers the model file, so counts of
another version are never used. Documents are joined with the cache on both
digests; of the texts that miss, one each is encoded, and the new counts are
appended. Every document then gets its count by a join with the cache.

To find one text of each missing digest without gathering copies, the digest
is first reduced to its smallest document id; only documents that are such
representatives pass on their text. Representatives that repeat as whole rows
are reduced after counting, and the cache is reduced on reading, so writers
that raced do no harm. Null document ids are one more id. Very long texts are
counted whole, by their units. An empty table appends nothing. Only the two
named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simigraph.llm import common
from simigraph.llm.tokens import encoder, file_digest

CACHE = "digest binary, tokenizer string, n_tokens long"


def read_cache(spark: SparkSession, path: str, tokenizer_digest: str) -> DataFrame:
    """digest and count; each digest once."""
    table = spark.read.schema(CACHE).parquet(path) if common.exists(spark, path) else spark.createDataFrame([], CACHE)
    return table.where(F.col("tokenizer") == tokenizer_digest).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def _count(texts: DataFrame, model: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = encoder("piece", model)
        for b in batches:
            n = [counter.count(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return texts.mapInArrow(run, "digest binary, n_tokens long")


def count_tokens(docs: DataFrame, cache: str, model: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; appends to the cache what it didn't have."""
    spark = docs.sparkSession
    common.ship(spark)
    version = file_digest(model)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    keyed = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    digests = common.materialise(keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    missing = digests.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(read_cache(spark, cache, version), "digest", "left_anti")
    same = keyed.doc_id.eqNullSafe(missing.doc_id) & (keyed.digest == missing.digest)
    texts = keyed.join(missing.hint("shuffle_hash"), same, "left_semi").select("digest", "text")
    new = _count(texts, model).withColumn("tokenizer", F.lit(version))
    new.select("digest", "tokenizer", "n_tokens").write.mode("append").option("compression", "zstd").parquet(cache)
    # Each digest once, as a table: copies of one text are then split between tasks, which an aggregate beside them forbids.
    known = common.materialise(read_cache(spark, cache, version), "counts")
    counted = digests.join(known, "digest")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
