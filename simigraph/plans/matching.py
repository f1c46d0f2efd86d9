"""Names that probably denote the same thing: blocks, matchers, scores, groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simigraph import store
from simigraph.config import Algorithms, Blocking, Config
from simigraph.functions import matchers, names
from simigraph.operators import blocking, groups, scoring, vectors
from simigraph.plans.registry import query
from simigraph.plans.scalar import _NAMED, CATEGORY
from simigraph.sources import caches, sinks
from simigraph.sources.catalog import PART_FILES, features, part_files, part_records, records, table

OPTIONS = Blocking()
FEATURES = f"""WITH files AS ({PART_FILES}), {_NAMED},
feats AS (SELECT *, CASE WHEN len(tokens) = 0 THEN '' ELSE left(md5(array_to_string(list_sort(tokens), '|')), 12) END AS token_signature,
  CAST(length(normalized_name) // 5 AS INTEGER) AS length_bucket, {CATEGORY.format(x="extension")} AS extension_category FROM records)"""
_SQL_KEYS = {
    "name": "SELECT 'name' AS kind, normalized_name AS key, path FROM feats WHERE normalized_name <> ''",
    "token": "SELECT 'token', t, path FROM (SELECT path, unnest(tokens) AS t FROM feats) WHERE length(t) >= 3",
    "prefix": "SELECT 'prefix', left(normalized_name, 4), path FROM feats WHERE length(normalized_name) >= 4",
    "signature": "SELECT 'signature', token_signature, path FROM feats WHERE token_signature <> ''",
    "category": "SELECT 'category', extension_category, path FROM feats",
    "length": "SELECT 'length', CAST(length_bucket AS VARCHAR), path FROM feats",
}


def _blocks(kinds: tuple[str, ...]) -> str:
    keys = " UNION ALL ".join(_SQL_KEYS[k].replace("SELECT '" + k + "', ", "SELECT '" + k + "' AS kind, ", 1) for k in kinds)
    first = keys if "name" in kinds else keys.replace(", path FROM", " AS key, path FROM", 1)
    return FEATURES + f", keys AS ({first}), sized AS (SELECT kind, key, count(*) AS entries FROM keys GROUP BY kind, key HAVING count(*) BETWEEN 2 AND 500)"


def _pairs(kinds: tuple[str, ...]) -> str:
    return _blocks(kinds) + ", kept AS (SELECT DISTINCT kind, key, path FROM keys JOIN sized USING (kind, key)), pairs AS (SELECT DISTINCT a.path AS path_a, b.path AS path_b FROM kept a JOIN kept b ON a.kind = b.kind AND a.key = b.key AND a.path < b.path) "


def _block_query(number: int, kind: str) -> None:
    @query(f"j0{number}_block_{kind}", _pairs((kind,)) + "SELECT path_a, path_b FROM pairs")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return blocking.candidate_pairs(part_records(spark, sf_dir), OPTIONS, [kind])


for _i, _k in enumerate(blocking.KINDS[:5], 1):
    _block_query(_i, _k)

SUPPLIER_FILES = "SELECT '/sup/' || CAST(s_nationkey AS VARCHAR) || '/' || s_name || '_' || repeat('x', CAST(s_suppkey % 17 AS INTEGER)) || '.txt' AS path, s_suppkey AS size, 0.0::DOUBLE AS mtime FROM supplier"


@query("j06_block_length", _pairs(("length",)).replace(PART_FILES, SUPPLIER_FILES) + "SELECT path_a, path_b FROM pairs")
def j06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of suppliers, whose names have lengths enough for blocks within the limit."""
    name = F.concat(F.lit("/sup/"), F.col("s_nationkey").cast("string"), F.lit("/"), "s_name", F.lit("_"), F.repeat(F.lit("x"), (F.col("s_suppkey") % 17).cast("int")), F.lit(".txt"))
    files = table(spark, sf_dir, "supplier").select(name.alias("path"), F.col("s_suppkey").cast("long").alias("size"), F.lit(0.0).alias("mtime"))
    return blocking.candidate_pairs(features(records(files, Config().normalization)), OPTIONS, ["length"])


@query("j_all_candidates", _pairs(blocking.KINDS) + "SELECT path_a, path_b FROM pairs")
def j_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.candidate_pairs(part_records(spark, sf_dir), OPTIONS)


@query("f15_block_guard", _blocks(blocking.KINDS) + " SELECT kind, key, entries FROM sized")
def f15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.usable_blocks(blocking.block_keys(part_records(spark, sf_dir), OPTIONS), OPTIONS)


@query("f14_block_keys", _blocks(blocking.KINDS) + " SELECT kind, count(*) AS entries, count(DISTINCT key) AS keys FROM keys GROUP BY kind")
def f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = blocking.block_keys(part_records(spark, sf_dir), OPTIONS)
    return keys.groupBy("kind").agg(F.count("*").alias("entries"), F.count_distinct("key").alias("keys"))


# Matchers, over all candidate pairs

def two_places(x: str) -> str:
    """As ``names.two_places``."""
    n = "CAST(trunc((v - floor(v)) * 4503599627370496) AS BIGINT) * 100"
    return f"list_transform([CAST({x} AS DOUBLE)], lambda v: (floor(v) * 100 + (({n}) // 4503599627370496) + CASE WHEN ({n}) % 4503599627370496 > 2251799813685248 OR (({n}) % 4503599627370496 = 2251799813685248 AND (({n}) // 4503599627370496) % 2 = 1) THEN 1 ELSE 0 END) / 100.0)[1]"


_ARRAYS = r"""list_distinct(regexp_extract_all(normalized_name, '\b(\d+)\b'))"""
_FULL = (
    _pairs(blocking.KINDS)
    + r""", e AS (SELECT *, list_distinct(list_transform(regexp_extract_all(lower(filename), 's\d+e\d+'), lambda m: 's' || CAST(CAST(regexp_extract(m, 's(\d+)e', 1) AS BIGINT) AS VARCHAR) || 'e' || CAST(CAST(regexp_extract(m, 'e(\d+)', 1) AS BIGINT) AS VARCHAR))) AS episodes,
  list_distinct(list_concat(regexp_extract_all(filename, '\b(19\d{2}|20\d{2})\b'), regexp_extract_all(normalized_name, '\b(19\d{2}|20\d{2})\b'))) AS years FROM feats),
full_ AS (SELECT *, list_filter("""
    + _ARRAYS
    + r""", lambda n: NOT list_contains(years, n)) AS numbers, list_distinct(tokens) AS token_set,
  trim(regexp_replace(regexp_replace(lower(regexp_extract(parent_folder, '([^/]*)$', 1)), '[._\-\[\](){}]', ' ', 'g'), '\s+', ' ', 'g')) AS folder,
  list_distinct(CASE WHEN length(normalized_name) < 2 THEN [normalized_name] ELSE list_transform(generate_series(1, length(normalized_name) - 1), lambda i: substr(normalized_name, i, 2)) END) AS bigrams,
  list_distinct(CASE WHEN length(normalized_name) < 3 THEN [normalized_name] ELSE list_transform(generate_series(1, length(normalized_name) - 2), lambda i: substr(normalized_name, i, 3)) END) AS trigrams,
  list_transform(string_split('abcdefghijklmnopqrstuvwxyz0123456789', ''), lambda c: CAST(length(normalized_name) - length(replace(normalized_name, c, '')) AS DOUBLE)) AS chars FROM e)
"""
)


def features_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files' features, which are read several times."""
    return store.materialise(part_records(spark, sf_dir), "features")


def attached(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Pairs with the columns of both files that a matcher reads."""
    return blocking.attached_pairs(features_table(spark, sf_dir), OPTIONS, columns)


_BOTH = " FROM pairs p JOIN full_ a ON a.path = p.path_a JOIN full_ b ON b.path = p.path_b"
_INTER = "len(list_intersect(a.{c}, b.{c}))::DOUBLE"
_UNION = "len(list_distinct(list_concat(a.{c}, b.{c})))"
_SORTED_EQUAL = "list_sort(a.{c}) = list_sort(b.{c})"
_MATCHERS = {
    "m01_exact": ("exact_match", "CASE WHEN a.normalized_name = b.normalized_name AND a.normalized_name <> '' THEN 100.0 WHEN lower(a.filename) = lower(b.filename) THEN 95.0 ELSE 0.0 END"),
    "m02_token": ("token_similarity", "CASE WHEN len(a.token_set) = 0 AND len(b.token_set) = 0 THEN CASE WHEN a.normalized_name = b.normalized_name THEN 100.0 ELSE 0.0 END WHEN len(a.token_set) = 0 OR len(b.token_set) = 0 THEN 0.0 ELSE ({i} / {u} + 2.0 * {i} / (len(a.token_set) + len(b.token_set))) / 2 * 100 END".format(i=_INTER.format(c="token_set"), u=_UNION.format(c="token_set"))),
    "m04_ngram": ("ngram_similarity", "CASE WHEN a.normalized_name = '' OR b.normalized_name = '' THEN CASE WHEN a.normalized_name = b.normalized_name THEN 100.0 ELSE 0.0 END ELSE ({} / {} + {} / {}) / 2 * 100 END".format(_INTER.format(c="bigrams"), _UNION.format(c="bigrams"), _INTER.format(c="trigrams"), _UNION.format(c="trigrams"))),
    "m06_size": ("size_similarity", "CASE WHEN a.size = b.size THEN 100.0 WHEN abs(a.size - b.size)::DOUBLE / greatest(a.size, b.size) <= 0.02 THEN 90.0 WHEN abs(a.size - b.size)::DOUBLE / greatest(a.size, b.size) <= 0.05 THEN 75.0 WHEN abs(a.size - b.size)::DOUBLE / greatest(a.size, b.size) <= 0.10 THEN 50.0 WHEN abs(a.size - b.size)::DOUBLE / greatest(a.size, b.size) <= 0.25 THEN 25.0 ELSE 0.0 END"),
    "m07_numeric": ("numeric_validation", " ".join(["CASE"] + [f"WHEN len(a.{c}) > 0 AND len(b.{c}) > 0 THEN CASE WHEN {_SORTED_EQUAL.format(c=c)} THEN 100.0 ELSE -100.0 END" for c in ("episodes", "years", "numbers")] + ["WHEN (len(a.episodes) + len(a.years) + len(a.numbers) > 0) <> (len(b.episodes) + len(b.years) + len(b.numbers) > 0) THEN 30.0 ELSE 100.0 END"])),
    "m08_extension": ("extension_intelligence", "CASE WHEN a.extension = b.extension THEN 100.0 WHEN a.extension_category = b.extension_category THEN CASE WHEN a.extension_category = 'other' THEN 50.0 ELSE 90.0 END ELSE 0.0 END"),
    "m09_folder": ("folder_context", "CASE WHEN a.parent_folder = b.parent_folder THEN 100.0 WHEN a.folder = b.folder AND a.folder <> '' THEN 90.0 WHEN a.folder <> '' AND b.folder <> '' AND (contains(a.folder, b.folder) OR contains(b.folder, a.folder)) THEN 80.0 ELSE 50.0 END"),
}


_CHARS = "sqrt(list_inner_product({c}, {c}))"
_MATCHERS["m05_charfreq"] = ("char_frequency", "CASE WHEN list_sum(a.chars) = 0 AND list_sum(b.chars) = 0 THEN 100.0 WHEN list_sum(a.chars) = 0 OR list_sum(b.chars) = 0 THEN 0.0 ELSE list_inner_product(a.chars, b.chars) / ({} * {}) * 100 END".format(_CHARS.format(c="a.chars"), _CHARS.format(c="b.chars")))
_ROUNDED = ("token_similarity", "ngram_similarity", "char_frequency")
_MATCHERS = {k: (m, two_places(s) if m in _ROUNDED else s) for k, (m, s) in _MATCHERS.items()}
#: Columns that each matcher reads.
_READS = {
    "exact_match": ("normalized_name", "filename"), "token_similarity": ("normalized_name", "token_set"), "ngram_similarity": ("normalized_name", "bigrams", "trigrams"),
    "char_frequency": ("chars",), "size_similarity": ("size",), "numeric_validation": ("episodes", "years", "numbers"), "extension_intelligence": ("extension", "extension_category"),
    "folder_context": ("parent_folder", "folder"),
}


def _matcher_query(name: str, matcher: str, sql: str) -> None:
    @query(name, _FULL + f"SELECT path_a, path_b, CAST({sql} AS DOUBLE) AS score{_BOTH}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        score = matchers.registry()[matcher]().cast("double").alias("score")
        pairs = blocking.grouped_pairs(features_table(spark, sf_dir), OPTIONS, _READS[matcher])
        if matcher in scoring.BY_NAME:  # once for two groups
            return blocking.expanded(pairs.select("a_files", "b_files", score)).select("path_a", "path_b", "score")
        return blocking.expanded(pairs).select("path_a", "path_b", score)


for _n, (_m, _sql) in _MATCHERS.items():
    _matcher_query(_n, _m, _sql)


@query("m03_fuzzy")
def m03(spark: SparkSession, sf_dir: str) -> DataFrame:
    store.ship(spark)
    pairs = blocking.name_pairs(features_table(spark, sf_dir), OPTIONS)
    return pairs.select("a_normalized_name", "b_normalized_name", F.round(matchers.fuzzy(), 6).alias("score"))


@query("m03b_sequence")
def m03b(spark: SparkSession, sf_dir: str) -> DataFrame:
    from simigraph.functions.fuzzy import sequence_score

    store.ship(spark)
    pairs = blocking.name_pairs(features_table(spark, sf_dir), OPTIONS)
    return pairs.select("*", F.round(sequence_score(F.col("a_normalized_name"), F.col("b_normalized_name")), 6).alias("score"))


# Scores. Without the fuzzy matcher SQL can express them all.

NO_FUZZY = Config(algorithms=Algorithms(fuzzy_similarity=False))
_SCORE = {k: s for k, s in _MATCHERS.values()}
_WEIGHTS = {"exact_match": 40, "token_similarity": 20, "ngram_similarity": 10, "char_frequency": 5, "size_similarity": 5, "numeric_validation": 5}
def _scored(weights: dict[str, int], extra: str = "", joins: str = "") -> str:
    """Matches under these weights; ``extra`` are more scores of a pair, ``joins`` the tables that they need."""
    scores = ", ".join(f"CAST({x} AS DOUBLE) AS {k}" for k, x in _SCORE.items()) + extra
    mean = " + ".join(f"{k} * {w}" for k, w in weights.items())
    return (
        f"{_FULL}, parts AS (SELECT path_a, path_b, a.size AS file_a_size, b.size AS file_b_size, {scores}{_BOTH}{joins}), "
        f"mean AS (SELECT *, ({mean}) / {sum(weights.values())}.0 AS m FROM parts WHERE extension_intelligence <> 0 AND numeric_validation <> -100), "
        "bonus AS (SELECT *, least(100.0, m + CASE WHEN folder_context = 100 THEN 5.0 WHEN folder_context >= 90 THEN 3.0 ELSE 0.0 END) AS s FROM mean), "
        f"final AS (SELECT path_a, path_b, file_a_size, file_b_size, exact_match, {two_places('CASE WHEN extension_intelligence = 90 THEN greatest(0.0, s - 2) ELSE s END')} AS confidence_score FROM bonus), "
        "matches AS (SELECT *, CASE WHEN confidence_score >= 95 THEN 'almost certain duplicate' WHEN confidence_score >= 80 THEN 'highly likely' WHEN confidence_score >= 60 THEN 'potential duplicate' WHEN confidence_score >= 40 THEN 'weak similarity' ELSE 'ignore' END AS category FROM final WHERE confidence_score >= 40) "
    )


_SCORED = _scored(_WEIGHTS)


def native_matches(spark: SparkSession, sf_dir: str, threshold: float | None = None) -> DataFrame:
    return scoring.matches_of(features_table(spark, sf_dir), NO_FUZZY, threshold)


@query("m11_score_native", _SCORED + "SELECT path_a, path_b, file_a_size, file_b_size, confidence_score, category FROM matches")
def m11n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native_matches(spark, sf_dir).drop("scores")


@query("m11_score")
def m11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.matches_of(features_table(spark, sf_dir), Config()).withColumn("scores", F.to_json("scores"))


@query("m12_match_files")
def m12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.match_files(part_records(spark, sf_dir), Config(), 60.0).withColumn("scores", F.to_json("scores"))


@query("m12_match_native", _SCORED + "SELECT path_a, path_b, confidence_score, category FROM matches WHERE confidence_score >= 60 ORDER BY confidence_score DESC, path_a, path_b")
def m12n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From files to matches, without the matcher that SQL can't express."""
    return scoring.match_files(part_records(spark, sf_dir), NO_FUZZY, 60.0).select("path_a", "path_b", "confidence_score", "category")


_COSINE = "CASE WHEN u.embedding IS NULL OR v.embedding IS NULL THEN 0.0 ELSE " + two_places("greatest(0, least(100, list_cosine_similarity(u.embedding::DOUBLE[], v.embedding::DOUBLE[]) * 100))") + " END AS semantic_similarity"
_VECTOR = " LEFT JOIN embeddings {v} ON CAST({v}.vec_id AS VARCHAR) = split_part({f}.path, '/', 5)"


@query("m11_semantic", _scored(_WEIGHTS | {"semantic_similarity": 10}, ", " + _COSINE, _VECTOR.format(v="u", f="a") + _VECTOR.format(v="v", f="b")) + "SELECT path_a, path_b, confidence_score, category FROM matches")
def m11_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with vectors at their weight of 10; a part's is the one with its key, if there is one."""
    files = part_records(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("_key"), F.col("embedding").alias("vector"))
    files = files.join(vectors, F.element_at(F.split("path", "/"), 5) == F.col("_key"), "left").drop("_key")
    config = Config(algorithms=Algorithms(fuzzy_similarity=False, semantic_similarity=True))
    # In no order, so matches are neither kept nor sorted.
    return scoring.matches_of(store.materialise(files, "features"), config).select("path_a", "path_b", "confidence_score", "category")


@query("f11_threshold", _SCORED + "SELECT path_a, path_b, confidence_score FROM matches WHERE confidence_score >= 80")
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native_matches(spark, sf_dir, 80.0).select("path_a", "path_b", "confidence_score")


@query("f09_rejects", _FULL + f"SELECT CASE WHEN {_SCORE['extension_intelligence']} = 0 THEN 'extension' WHEN {_SCORE['numeric_validation']} = -100 THEN 'numeric' ELSE 'kept' END AS outcome, count(*) AS pairs{_BOTH} GROUP BY 1")
def f09(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matchers.registry()
    outcome = F.when(m["extension_intelligence"]() == 0, "extension").when(m["numeric_validation"]() == matchers.REJECT, "numeric").otherwise("kept")
    return attached(spark, sf_dir, "extension", "extension_category", "episodes", "years", "numbers").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("pairs"))


@query("a08_category_counts", _SCORED + "SELECT category, count(*) AS matches FROM matches GROUP BY category")
def a08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.category_counts(native_matches(spark, sf_dir))


@query("t01_ranked_matches", _SCORED + "SELECT row_number() OVER (ORDER BY confidence_score DESC, path_a, path_b) AS group_no, path_a, path_b, confidence_score FROM matches")
def t01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.number_by_score(native_matches(spark, sf_dir)).select("group_no", "path_a", "path_b", "confidence_score")


@query("f04_pair_scope", _SCORED + "SELECT path_a, path_b FROM matches WHERE starts_with(path_a, '/lib/brand_11') OR starts_with(path_b, '/lib/brand_11') OR starts_with(path_a, '/lib/brand_2') OR starts_with(path_b, '/lib/brand_2')")
def f04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.in_scope(native_matches(spark, sf_dir), "/lib/brand_11", "/lib/brand_2").select("path_a", "path_b")


@query("k11_match_table", _SCORED + "SELECT regexp_extract(path_a, '([^/]*)$', 1) AS name_a, printf('%.2f KB', file_a_size / 1024.0) AS size_a, regexp_extract(path_b, '([^/]*)$', 1) AS name_b, printf('%.2f KB', file_b_size / 1024.0) AS size_b, confidence_score, category FROM matches")
def k11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.match_table(native_matches(spark, sf_dir))


@query("x15_category", "SELECT o_orderkey, CASE WHEN s >= 95 THEN 'almost certain duplicate' WHEN s >= 80 THEN 'highly likely' WHEN s >= 60 THEN 'potential duplicate' WHEN s >= 40 THEN 'weak similarity' ELSE 'ignore' END AS category FROM (SELECT o_orderkey, CAST(o_orderkey % 101 AS DOUBLE) AS s FROM orders)")
def x15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", scoring.category((F.col("o_orderkey") % 101).cast("double")).alias("category"))


@query("j15_grid_lookup", _SCORED + "SELECT lower(path_b) AS path_key, count(*) AS matches, min(f.size) AS size FROM matches JOIN feats f ON lower(f.path) = lower(path_b) GROUP BY 1")
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides are counted by path before they are joined."""
    files = part_records(spark, sf_dir).groupBy(names.norm_case(F.col("path")).alias("path_key")).agg(F.count("*").alias("files"), F.min("size").alias("size"))
    found = native_matches(spark, sf_dir).groupBy(names.norm_case(F.col("path_b")).alias("path_key")).agg(F.count("*").alias("found"))
    return found.join(files, "path_key").select("path_key", (F.col("found") * F.col("files")).alias("matches"), "size")


@query("a06_components", _SCORED.replace("WITH files", "WITH RECURSIVE files", 1) + ", strong AS (SELECT path_a AS a, path_b AS b FROM matches WHERE confidence_score >= 90), both_ AS (SELECT a, b FROM strong UNION SELECT b, a FROM strong), r AS (SELECT a AS node, a AS seen FROM both_ UNION SELECT r.node, both_.b FROM r JOIN both_ ON r.seen = both_.a) SELECT node, min(seen) AS component FROM r GROUP BY node")
def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of matches from 90 up."""
    return groups.components(groups.forest(native_matches(spark, sf_dir, 90.0)))


@query("a06_order_components", "WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey - c_custkey % 7 AS b FROM customer), both_ AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b), r AS (SELECT a AS node, a AS seen FROM both_ UNION SELECT r.node, both_.b FROM r JOIN both_ ON r.seen = both_.a) SELECT node, min(seen) AS component FROM r GROUP BY node")
def a06_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") - F.col("c_custkey") % 7).alias("b"))
    return groups.components(c, "a", "b")


_NEAREST = "WITH v AS (SELECT vec_id, embedding FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, " + two_places("greatest(0, least(100, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) * 100))") + " AS score FROM q JOIN v ON v.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s) SELECT query_id, vec_id, score FROM r WHERE rn <= 10"


@query("m10_cosine", _NEAREST)
def m10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 50: a top-k report, block by block."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors.nearest(v, v.where("id % 50 = 0"), 10).select(F.col("query_id"), F.col("id").alias("vec_id"), "score")


@query("m10_index", _NEAREST)
def m10_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the index of lists, all of them probed, which is its exact way."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    index = vectors.build_index(v)
    return vectors.search(index, v.where("id % 50 = 0"), 10, probes=len(index.centroids)).select("query_id", F.col("id").alias("vec_id"), "score")


# The same blocks with more than files of parts


@query("v06_own_category", FEATURES + ", k AS (SELECT CASE WHEN extension IN ('.jpg', '.png') THEN 'picture' ELSE 'rest' END AS key FROM feats) SELECT key, count(*) AS files FROM k GROUP BY key")
def v06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by a category function of the caller's own."""
    own = lambda e: F.when(e.isin(".jpg", ".png"), "picture").otherwise("rest")
    files = features(records(part_files(spark, sf_dir), Config().normalization), own)
    return blocking.block_keys(files, OPTIONS, ["category"]).groupBy("key").agg(F.count("*").alias("files"))


@query("v01_own_matcher", _pairs(blocking.KINDS) + "SELECT path_a, path_b, 100.0::DOUBLE AS score FROM pairs p JOIN feats a ON a.path = path_a JOIN feats b ON b.path = path_b WHERE a.size % 1000 = b.size % 1000")
def v01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matcher of the caller's own, as the only one."""

    @matchers.matcher("same_rest")
    def same_rest() -> Column:
        return F.when(F.col("a_size") % 1000 == F.col("b_size") % 1000, 100.0).otherwise(0.0)

    try:
        found = attached(spark, sf_dir, "size").select("path_a", "path_b", matchers.registry()["same_rest"]().alias("score"))
    finally:
        matchers.unregister("same_rest")
    return found.where("score > 0")


# Exports, read back


def _export(number: int, kind: str, back: Callable[[SparkSession, str], DataFrame], write: Callable[[DataFrame, str], None]) -> None:
    @query(f"k0{number}_export_{kind}", _SCORED + "SELECT path_a, path_b, file_a_size, file_b_size, confidence_score, category, exact_match FROM matches WHERE confidence_score >= 80")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = store.new_path(spark, kind)
        write(native_matches(spark, sf_dir, 80.0), path)
        return back(spark, path).select("path_a", "path_b", F.col("file_a_size").cast("long"), F.col("file_b_size").cast("long"), F.col("confidence_score").cast("double"), "category", F.col("exact_match").cast("double"))


_from_text = lambda d, c: d.withColumn("exact_match", F.get_json_object(c, "$.exact_match"))
_export(1, "csv", lambda spark, p: _from_text(spark.read.option("header", True).option("escape", '"').csv(p), "scores"), lambda m, p: sinks.write_csv(m, p, "gzip"))
_export(2, "json", lambda spark, p: sinks.read_json(spark, p, "gzip").withColumn("exact_match", F.col("scores.exact_match")), lambda m, p: sinks.write_json(m, p, "gzip"))
_export(3, "columns", lambda spark, p: _from_text(spark.read.parquet(p), "scores_json"), sinks.write_columns)


@query("k07_clear", _SCORED + "SELECT count(*) AS before, 0::BIGINT AS after FROM matches WHERE confidence_score >= 80")
def k07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored matches before and after the table is emptied."""
    path = store.new_path(spark, "matches")
    caches.write_matches(native_matches(spark, sf_dir, 80.0), path)
    before = caches.read_matches(spark, path).agg(F.count("*").alias("before"))
    caches.clear(spark, path)
    return before.crossJoin(caches.read_matches(spark, path).agg(F.count("*").alias("after")))  # one row each
