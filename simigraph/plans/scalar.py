"""Catalogs, paths, names, sizes and numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simigraph.config import Config, Scan
from simigraph.functions import names
from simigraph.plans.registry import query
from simigraph.sources import caches, catalog
from simigraph.sources.catalog import DOCUMENT_FILES, PART_FILES, document_files, part_files

OPTIONS = Config().normalization
PARTS = f"WITH files AS ({PART_FILES}) "
DOCS = f"WITH files AS ({DOCUMENT_FILES}) "

NAME = "regexp_extract(path, '([^/]*)$', 1)"
EXT = f"lower(regexp_extract({NAME}, '.(\\.[^.]+)$', 1))"
PARENT = "regexp_extract(path, '^(.*)/[^/]*$', 1)"


def _in(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


# Fixed values, apart from those in names.
CATEGORY = """CASE WHEN {x} IN ('.mp4', '.mkv', '.avi', '.mov', '.wmv', '.flv', '.webm', '.mpeg', '.mpg', '.m4v', '.ts', '.m2ts') THEN 'video'
  WHEN {x} IN ('.mp3', '.flac', '.wav', '.aac', '.m4a', '.wma', '.ogg', '.ape', '.opus') THEN 'audio'
  WHEN {x} IN ('.jpg', '.jpeg', '.png', '.gif', '.bmp', '.webp', '.tiff', '.heic') THEN 'image'
  WHEN {x} IN ('.txt', '.pdf', '.doc', '.docx', '.xls', '.xlsx', '.ppt', '.pptx', '.md', '.json', '.yaml', '.yml') THEN 'document' ELSE 'other' END"""
PRESETS = {
    "videos": "'.mp4', '.mkv', '.avi', '.mov', '.wmv', '.flv', '.webm', '.mpeg', '.mpg', '.m4v', '.ts', '.f4v', '.3gp', '.vob'",
    "images": "'.jpg', '.jpeg', '.png', '.gif', '.bmp', '.webp', '.tiff'",
    "documents": "'.pdf', '.doc', '.docx', '.txt', '.rtf', '.xls', '.xlsx', '.csv'",
    "audio": "'.mp3', '.wav', '.flac', '.aac', '.ogg', '.m4a'",
}


def _normalized_sql(stem: str, own: tuple[str, ...] = ()) -> str:
    s = f"regexp_replace(lower({stem}), '{names.SEPARATORS}', ' ', 'g')"
    for p in (names.HASHES, names.GROUPS, *names.TAG_PATTERNS, *own):
        s = f"regexp_replace({s}, '{p}', ' ', 'gi')"
    s = f"regexp_replace({s}, '[^\\w\\s]', ' ', 'g')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


STEM = f"left({NAME}, length({NAME}) - length(regexp_extract({NAME}, '.(\\.[^.]+)$', 1)))"
#: CTEs: files, then named (path, filename, extension, size, mtime, parent_folder, cleaned), then records.
_NAMED = f"""named AS (SELECT path, {NAME} AS filename, {EXT} AS extension, size, mtime, {PARENT} AS parent_folder, {_normalized_sql(STEM)} AS cleaned FROM files),
words AS (SELECT *, list_filter(string_split(cleaned, ' '), lambda t: t <> '' AND t NOT IN ({_in(names.STOP_WORDS)}) AND (length(t) > 1 OR regexp_matches(t, '^[0-9]$'))) AS tokens FROM named),
records AS (SELECT path, filename, extension, size, mtime, parent_folder, CASE WHEN len(tokens) > 0 THEN array_to_string(tokens, ' ') ELSE cleaned END AS normalized_name, tokens FROM words)"""
RECORDS = f"WITH files AS ({PART_FILES}), {_NAMED}"


def record_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.records(part_files(spark, sf_dir), OPTIONS)


@query("s02_scan_filter", DOCS + "SELECT path, size FROM files WHERE NOT list_contains(string_split(regexp_extract(path, '^(.*)/[^/]*$', 1), '/'), 'src0') AND path LIKE '%.txt'")
def s02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.scan(document_files(spark, sf_dir).select("path", "size"), Scan(include_extensions=(".txt",), exclude_folders=("SRC0",)))


@query("s03_file_records", RECORDS + " SELECT path, filename, extension, size, mtime, parent_folder, normalized_name, array_to_string(tokens, '|') AS tokens FROM records")
def s03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_rows(spark, sf_dir).withColumn("tokens", F.array_join("tokens", "|"))


@query("s05_multi_root", f"WITH d AS ({DOCUMENT_FILES}), p AS ({PART_FILES}) SELECT path, size FROM d UNION ALL SELECT path, size FROM p")
def s05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_files(spark, sf_dir).select("path", "size").unionByName(part_files(spark, sf_dir).select("path", "size"))


@query("s07_cache_keys", PARTS + "SELECT path, mtime, size FROM files")
def s07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caches.cache_keys(part_files(spark, sf_dir))


@query("s15_preview", DOCS + "SELECT path, size FROM files ORDER BY path LIMIT 30")
def s15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 30 in order: a preview."""
    return document_files(spark, sf_dir).select("path", "size").orderBy("path").limit(30)


@query("a12_total_size", DOCS + "SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_files(spark, sf_dir).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("f01_extension_filter", PARTS + f"SELECT path, {EXT} AS extension FROM files WHERE {EXT} IN ('.mkv', '.pdf')")
def f01(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_files(spark, sf_dir).select("path", names.suffix(names.basename(F.col("path"))).alias("extension"))
    return rows.where(F.col("extension").isin(".mkv", ".pdf"))


# Every extension of any list, and some of none, by the part's key.
_ANY = ".mp4 .mkv .avi .mov .wmv .flv .webm .mpeg .mpg .m4v .ts .m2ts .f4v .3gp .vob .jpg .jpeg .png .gif .bmp .webp .tiff .heic .pdf .doc .docx .txt .rtf .xls .xlsx .csv .ppt .pptx .md .json .yaml .yml .mp3 .wav .flac .aac .ogg .m4a .wma .ape .opus .exe .MKV".split()
_ANY_SQL = f"SELECT p_partkey, lower(([{', '.join(repr(e) for e in _ANY)}])[CAST(p_partkey % {len(_ANY)} AS INTEGER) + 1]) AS ext FROM part"


def any_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.element_at(F.array(*map(F.lit, _ANY)), (F.col("p_partkey") % len(_ANY)).cast("int") + 1)
    return catalog.table(spark, sf_dir, "part").select("p_partkey", names.suffix(F.concat(F.lit("a"), e)).alias("ext"))


@query("f02_type_preset", f"WITH f AS ({_ANY_SQL}) SELECT preset, ext, count(*) AS files FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS preset, ext FROM f WHERE ext IN ({v})" for k, v in PRESETS.items()) + " UNION ALL SELECT 'all', ext FROM f) GROUP BY preset, ext")
def f02(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.when(names.in_preset(F.col("ext"), p), F.lit(p)) for p in (*names.PRESETS, "all")])
    return any_extension(spark, sf_dir).select(F.explode(F.array_compact(kinds)).alias("preset"), "ext").groupBy("preset", "ext").agg(F.count("*").alias("files"))


@query("f03_folder_scope", PARTS + "SELECT path FROM files WHERE starts_with(path, '/lib/brand_1') OR starts_with(path, '/lib/brand_25')")
def f03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_files(spark, sf_dir).where(names.in_folders(F.col("path"), ["/lib/brand_1", "/lib/brand_25"])).select("path")


@query("f06_known_only", "SELECT user_id, count(*) AS files FROM (SELECT user_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS duration FROM events) WHERE duration IS NOT NULL GROUP BY user_id")
def f06(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = catalog.table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") != "error", F.col("value")).alias("duration"))
    return e.where("duration is not null").groupBy("user_id").agg(F.count("*").alias("files"))


@query("p01_display_path", PARTS + "SELECT path, substr(path, 2) AS shown FROM files")
def p01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_files(spark, sf_dir).select("path", names.display_path(F.col("path"), "/lib/").alias("shown"))


@query("x01_normalize", RECORDS + " SELECT filename, min(normalized_name) AS normalized_name, min(array_to_string(tokens, '|')) AS tokens FROM records GROUP BY filename")
def x01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_rows(spark, sf_dir).groupBy("filename").agg(F.min("normalized_name").alias("normalized_name"), F.min(F.array_join("tokens", "|")).alias("tokens"))


@query("x02_clean_spaces", r"SELECT doc_id, md5(trim(regexp_replace(text || chr(8195) || 'x' || chr(160) || chr(133), '[\s\x0B\x{85}\p{Z}]+', ' ', 'g'))) AS cleaned FROM documents")
def x02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, with white space beyond ASCII at the end."""
    text = F.concat("text", F.lit("\u2003x\u00a0\u0085"))
    return catalog.table(spark, sf_dir, "documents").select("doc_id", F.md5(names.clean_spaces(text)).alias("cleaned"))


@query("x04_token_signature", RECORDS + " SELECT path, CASE WHEN len(tokens) = 0 THEN '' ELSE left(md5(array_to_string(list_sort(tokens), '|')), 12) END AS signature FROM records")
def x04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_rows(spark, sf_dir).select("path", names.token_signature(F.col("tokens")).alias("signature"))


@query("x05_length_bucket", RECORDS + " SELECT CAST(length(normalized_name) // 5 AS INTEGER) AS length_bucket, count(*) AS files FROM records GROUP BY 1")
def x05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_rows(spark, sf_dir).groupBy(names.length_bucket(F.col("normalized_name")).alias("length_bucket")).agg(F.count("*").alias("files"))


@query("x06_ext_category", f"WITH f AS ({_ANY_SQL}) SELECT ext AS extension, {CATEGORY.format(x='ext')} AS category, count(*) AS files FROM f GROUP BY 1, 2")
def x06(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = any_extension(spark, sf_dir).withColumnRenamed("ext", "extension")
    return rows.groupBy("extension", names.category(F.col("extension")).alias("category")).agg(F.count("*").alias("files"))


_SIZES = "SELECT o_orderkey, CAST(o_totalprice * o_totalprice AS BIGINT) AS size FROM orders"
_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


@query("x14_format_size", f"WITH s AS ({_SIZES}) SELECT o_orderkey, CASE " + " ".join(f"WHEN size < {1024.0 ** (k + 1):.1f} THEN printf('%.2f {u}', size / {1024.0**k:.1f})" for k, u in enumerate(_UNITS[:-1])) + " ELSE printf('%.2f PB', size / 1125899906842624.0) END AS shown FROM s")
def x14(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.round(F.col("o_totalprice") * F.col("o_totalprice")).cast("long")
    return catalog.table(spark, sf_dir, "orders").select("o_orderkey", names.human_size(size).alias("shown"))


@query("x16_path_parts", PARTS + f"SELECT path, {NAME} AS basename, {STEM} AS stem, {EXT} AS suffix, {PARENT} AS parent, regexp_extract({PARENT}, '([^/]*)$', 1) AS parent_name FROM files")
def x16(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    name = names.basename(path)
    return part_files(spark, sf_dir).select("path", name.alias("basename"), names.stem(name).alias("stem"), names.suffix(name).alias("suffix"), names.parent(path).alias("parent"), names.basename(names.parent(path)).alias("parent_name"))


@query("x17_json_tokens", RECORDS + " SELECT path, len(tokens) AS n, '[' || array_to_string(list_transform(tokens, lambda t: '\"' || t || '\"'), ',') || ']' AS tokens FROM records")
def x17(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = record_rows(spark, sf_dir).select("path", F.to_json("tokens").alias("tokens"))
    return stored.select("path", F.size(F.from_json("tokens", "array<string>")).cast("long").alias("n"), "tokens")


@query("x18_norm_case", "SELECT p_partkey, lower(replace('C:\\Lib\\' || p_brand || '\\' || p_name, '\\', '/')) AS path_key FROM part")
def x18(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = catalog.table(spark, sf_dir, "part")
    return p.select("p_partkey", names.norm_case(F.concat(F.lit("C:\\Lib\\"), "p_brand", F.lit("\\"), "p_name")).alias("path_key"))


def _sorted(c) -> F.Column:
    return F.array_join(F.array_sort(c), ",")


_LISTS = "array_to_string(list_sort(list_distinct({x})), ',')"


@query("x19_years", RECORDS + " SELECT path, " + _LISTS.format(x="regexp_extract_all(normalized_name, '\\b(19\\d{2}|20\\d{2})\\b')") + " AS years FROM records")
def x19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_rows(spark, sf_dir).select("path", _sorted(names.years(F.col("normalized_name"))).alias("years"))


@query("x20_episodes", PARTS + f"SELECT path, " + _LISTS.format(x=f"list_transform(regexp_extract_all(lower({NAME}), 's\\d+e\\d+'), lambda m: 's' || CAST(CAST(regexp_extract(m, 's(\\d+)e', 1) AS BIGINT) AS VARCHAR) || 'e' || CAST(CAST(regexp_extract(m, 'e(\\d+)', 1) AS BIGINT) AS VARCHAR))") + " AS episodes FROM files")
def x20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_files(spark, sf_dir).select("path", _sorted(names.episodes(names.basename(F.col("path")))).alias("episodes"))


@query("x21_numbers", RECORDS + " SELECT path, " + _LISTS.format(x="regexp_extract_all(normalized_name, '\\b(\\d+)\\b')") + " AS numbers FROM records")
def x21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_rows(spark, sf_dir).select("path", _sorted(names.numbers(F.col("normalized_name"))).alias("numbers"))


@query("x22_ngrams", "SELECT p_partkey, array_to_string(list_sort(list_distinct(CASE WHEN length(p_name) < 3 THEN [p_name] ELSE list_transform(generate_series(1, length(p_name) - 2), lambda i: substr(p_name, i, 3)) END)), '|') AS grams FROM part")
def x22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(names.ngrams(F.col("p_name"), 3)), "|").alias("grams"))


@query("a14_char_counts", "SELECT p_name, string_agg(c || ':' || CAST(n AS VARCHAR), ',' ORDER BY c) AS chars FROM (SELECT p_name, c, count(*) AS n FROM (SELECT p_name, unnest(string_split(p_name, '')) AS c FROM (SELECT DISTINCT p_name FROM part)) WHERE regexp_matches(c, '^[A-Za-z0-9]$') GROUP BY p_name, c) GROUP BY p_name")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = F.transform(names.char_counts(F.col("p_name")), lambda e: F.concat(e["c"], F.lit(":"), e["n"].cast("string")))
    return catalog.table(spark, sf_dir, "part").select("p_name").distinct().select("p_name", F.array_join(counted, ",").alias("chars"))


@query("v03_own_pattern", f"WITH files AS ({PART_FILES}), " + _NAMED.replace(_normalized_sql(STEM), _normalized_sql(STEM, ("\\bfinal\\b", "gr[ae]y"))) + " SELECT path, normalized_name FROM records")
def v03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without patterns of the caller's own; one that doesn't compile is passed over."""
    options = Config().merged({"normalization": {"remove_patterns": [r"\bfinal\b", "gr[ae]y", "("]}}).normalization
    return catalog.records(part_files(spark, sf_dir), options).select("path", "normalized_name")
