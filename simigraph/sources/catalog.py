"""File catalogs: from folders, from tables, and enriched for matching."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simigraph import store
from simigraph.config import Config, Normalization, Scan
from simigraph.functions import names

RECORD = T.StructType(
    [
        T.StructField("path", T.StringType()), T.StructField("filename", T.StringType()), T.StructField("extension", T.StringType()),
        T.StructField("size", T.LongType()), T.StructField("mtime", T.DoubleType()), T.StructField("parent_folder", T.StringType()),
        T.StructField("normalized_name", T.StringType()), T.StructField("tokens", T.ArrayType(T.StringType())),
    ]
)


def list_files(spark: SparkSession, roots: Sequence[str], recurse: bool = True, extensions: Sequence[str] | None = None, content: bool = False) -> DataFrame:
    """Files under all roots: path, size, mtime and, if asked for, content, which is otherwise never read."""
    reader = spark.read.format("binaryFile").option("ignoreMissingFiles", "true")
    if recurse:
        reader = reader.option("recursiveFileLookup", "true")
    files = reader.load(list(roots))
    plain = F.regexp_replace("path", r"^file:/+", "/")
    out = files.select(plain.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), *(["content"] if content else []))
    if extensions:
        out = out.where(names.suffix(names.basename(F.col("path"))).isin(*[e.lower() for e in extensions]))
    return out


def scan(files: DataFrame, options: Scan, root: str = "") -> DataFrame:
    """Without files of excluded folders below the root or of other than the included extensions."""
    below = F.substr("path", F.lit(len(root.rstrip("/")) + 1)) if root else F.col("path")
    folders = F.transform(F.split(names.parent(below), "/"), F.lower)
    kept = files
    if options.exclude_folders:
        kept = kept.where(~F.arrays_overlap(folders, F.array(*[F.lit(x.lower()) for x in options.exclude_folders])))
    if options.include_extensions:
        kept = kept.where(names.suffix(names.basename(F.col("path"))).isin(*[e.lower() for e in options.include_extensions]))
    return kept


def without(files: DataFrame, own: Sequence[str]) -> DataFrame:
    """Without the engine's own files, such as a cache in a scanned folder."""
    return files.where(~names.norm_case(F.col("path")).isin(*[p.replace("\\", "/").lower() for p in own]))


def records(files: DataFrame, options: Normalization) -> DataFrame:
    """File records from path, size and mtime; other columns are dropped."""
    name = names.basename(F.col("path"))
    named = files.select("path", name.alias("filename"), names.suffix(name).alias("extension"), "size", "mtime", names.parent(F.col("path")).alias("parent_folder"), names.normalize(name, options).alias("cleaned"))
    split = named.withColumn("tokens", names.tokens(F.col("cleaned"), options))
    joined = F.when(F.size("tokens") > 0, F.array_join("tokens", " ")).otherwise(F.col("cleaned"))
    return split.select("path", "filename", "extension", "size", "mtime", "parent_folder", joined.alias("normalized_name"), "tokens")


def features(records_: DataFrame, category: Callable[[Column], Column] = names.category) -> DataFrame:
    """All that blocking and matching need of one file, computed once for each file; ``category`` is of the extension."""
    n, f = F.col("normalized_name"), F.col("filename")
    return records_.select(
        "*",
        names.token_signature(F.col("tokens")).alias("token_signature"),
        names.length_bucket(n).alias("length_bucket"),
        category(F.col("extension")).alias("extension_category"),
        F.array_distinct("tokens").alias("token_set"),
        names.ngrams(n, 2).alias("bigrams"),
        names.ngrams(n, 3).alias("trigrams"),
        names.char_counts(n).alias("chars"),
        names.episodes(f).alias("episodes"),
        F.array_union(names.years(f), names.years(n)).alias("years"),
        F.array_except(names.numbers(n), F.array_union(names.years(f), names.years(n))).alias("numbers"),
        names.clean_folder(F.col("path")).alias("folder"),
    )


def named_features(files: DataFrame, options: Normalization) -> DataFrame:
    """Records with their features from path, size and mtime; what a name gives is made once for each name."""
    files = files.withColumn("filename", names.basename(F.col("path")))
    made = features(records(store.spread(files.select("filename").distinct()).select(F.col("filename").alias("path"), F.lit(0).cast("long").alias("size"), F.lit(0.0).alias("mtime")), options))
    order = made.columns
    own = files.withColumns({"parent_folder": names.parent(F.col("path")), "folder": names.clean_folder(F.col("path"))})
    return own.join(made.drop("path", "size", "mtime", "parent_folder", "folder"), "filename").select(*order)


# The tables of the test data as catalogs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mtime(key: Column) -> Column:
    return F.lit(1.6e9) + F.pmod(key * 7919, F.lit(100_000)).cast("double")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, size, mtime and content of a text file for each document."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(path.alias("path"), F.octet_length("text").cast("long").alias("size"), _mtime(F.col("doc_id")).alias("mtime"), F.col("text").cast("binary").alias("content"))


DOCUMENT_FILES = """SELECT '/' || source || '/' || lang || '/doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS path, CAST(strlen(text) AS BIGINT) AS size,
  1.6e9::DOUBLE + CAST((doc_id * 7919) % 100000 AS DOUBLE) AS mtime, text AS content FROM documents"""

# Endings of invented file names, by key.
TAGS = ("1080p", "720p", "x264", "s01e02", "final")
EXTENSIONS = (".mkv", ".mp4", ".avi", ".jpg", ".png", ".pdf")


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, size and mtime of a media file for each part."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    tag = F.element_at(F.array(*map(F.lit, TAGS)), (key % len(TAGS)).cast("int") + 1)
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (key % len(EXTENSIONS)).cast("int") + 1)
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("."), (1990 + F.col("p_size") % 30).cast("string"), F.lit("."), tag, ext)
    path = F.concat(F.lit("/lib/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("/"), F.lower("p_type"), F.lit("/"), key.cast("string"), F.lit("/"), name)
    return p.select(path.alias("path"), F.round(F.col("p_retailprice") * 1000).cast("long").alias("size"), _mtime(key).alias("mtime"))


PART_FILES = f"""SELECT '/lib/' || lower(replace(p_brand, '#', '_')) || '/' || lower(p_type) || '/' || CAST(p_partkey AS VARCHAR) || '/' ||
  replace(p_name, ' ', '.') || '.' || CAST(1990 + p_size % 30 AS VARCHAR) || '.' || (list_value({", ".join(f"'{t}'" for t in TAGS)}))[CAST(p_partkey % {len(TAGS)} AS INTEGER) + 1] ||
  (list_value({", ".join(f"'{e}'" for e in EXTENSIONS)}))[CAST(p_partkey % {len(EXTENSIONS)} AS INTEGER) + 1] AS path,
  CAST(round(p_retailprice * 1000) AS BIGINT) AS size, 1.6e9::DOUBLE + CAST((p_partkey * 7919) % 100000 AS DOUBLE) AS mtime FROM part"""


def part_records(spark: SparkSession, sf_dir: str, config: Config | None = None) -> DataFrame:
    return named_features(store.spread(part_files(spark, sf_dir)), (config or Config()).normalization)


#: How far a frame of the test data is moved towards the mean of its shot.
BLEND = 0.9


def embedding_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as an 8x8 frame of the shot that its label names; frames of a shot resemble each other, so they lie near its mean."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.col("label").cast("long").alias("video"), F.col("embedding").cast("array<double>").alias("e"))
    cells = e.select("video", F.posexplode("e").alias("i", "v")).groupBy("video", "i").agg(F.avg("v").alias("m"))
    means = cells.groupBy("video").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda c: c["m"]).alias("mean"))  # 64 cells of a shot
    return e.join(means, "video").select("frame", "video", F.zip_with("e", "mean", lambda v, m: v * (1 - BLEND) + m * BLEND).alias("pixels"))


def event_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), F.col("value").alias("duration"))
