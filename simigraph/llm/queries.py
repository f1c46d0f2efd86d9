"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simigraph.llm import bpe_chunks, common, filter_audit, language_id, lattice_lm, line_dedup, line_rules, lz_fingerprint, packing, simhash, token_cache, token_files, url_tree, whitening
from simigraph.llm.common import SPACE, WORD, table

WORD_BPE, BYTE_BPE, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
END_ID, TOKEN_LIMIT = 1, 4096


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, WORD_BPE, END_ID)
    return token_files.read_token_files(spark, path, digest_only=True)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, sized in words and an end, and their places in sequences."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), words_and_end())


def words_and_end(text_col: str = "text") -> Column:
    return F.regexp_count(common.text_or_empty(text_col), F.lit(WORD)) + 1


def op3_url_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return url_tree.judge_urls(table(spark, sf_dir, "pages"), labels)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document: lines, lines deleted, and a digest of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split(common.text_or_empty(), "\n")).cast("long").alias("n_lines"))
    out = line_dedup.dedup_lines(docs, count_col="n_deleted")
    return out.select("doc_id", "n_lines", "n_deleted", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op6_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    return lattice_lm.score_documents(table(spark, sf_dir, "documents"), PIECES, held_out)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, so that every run counts all texts."""
    return token_cache.count_tokens(table(spark, sf_dir, "documents"), common.new_path(spark, "token-cache"), PIECES, TOKEN_LIMIT)


def op8_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.chain(table(spark, sf_dir, "documents"))


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *(f"rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def op10_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.encode_decode(table(spark, sf_dir, "documents"), BYTE_BPE, digests=True)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return language_id.identify(table(spark, sf_dir, "documents"), held_out)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector and component."""
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    each = out.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("k", "whitened"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("k")).alias("explained"), "identity_error")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_files, op2_best_fit_packing, op3_url_tree, op4_line_dedup, op5_simhash, op6_lattice_lm, op7_token_counts, op8_lz_fingerprints, op9_line_rules, op10_bpe_chunks, op11_filter_audit, op12_language_id, op13_whitening, pipeline)
}

# Runs of equal lines along the diagonals of any two documents, or one document and itself.
_LINES = r"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
counted AS (SELECT doc_id, line, s, len(regexp_extract_all(s, '[^ \t\n\x0B\f\r]+')) AS words FROM raw),
lines AS (SELECT doc_id, line, md5(s) AS s, words, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS no FROM counted WHERE words > 0),
twice AS (SELECT s FROM lines GROUP BY s HAVING count(*) > 1),
shared AS (SELECT * FROM lines SEMI JOIN twice USING (s)),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, y.no - x.no AS shift, y.no, y.line, y.words FROM shared x JOIN shared y ON x.s = y.s WHERE x.doc_id < y.doc_id OR x.doc_id = y.doc_id AND x.no < y.no),
runs AS (SELECT *, no - row_number() OVER (PARTITION BY a, b, shift ORDER BY no) AS run FROM met),
gone AS (SELECT DISTINCT b AS doc_id, line FROM (SELECT b, line, sum(words) OVER (PARTITION BY a, b, shift, run) AS n FROM runs) WHERE n >= 50),
marked AS (SELECT c.doc_id, c.line, c.s, c.words, CASE WHEN words > 0 THEN CASE WHEN g.line IS NULL THEN 0 ELSE 1 END END AS out FROM counted c LEFT JOIN gone g ON c.doc_id = g.doc_id AND c.line = g.line),
around AS (SELECT *, coalesce(last_value(out IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS above,
  coalesce(first_value(out IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS below FROM marked),
kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE above = 1 AND below = 1) AS n_deleted, coalesce(string_agg(s, chr(10) ORDER BY line) FILTER (WHERE above = 0 OR below = 0), '') AS text FROM around GROUP BY doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_deleted AS BIGINT) AS n_deleted, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS text_sha256 FROM kept
"""

_R = line_rules


def _count(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, '{pattern.replace(chr(39), chr(39) * 2)}'))"


def _line_fails() -> str:
    words, letters = _count("s", WORD), _count("s", r"\p{L}")
    many = " OR ".join(f"{_count('s', p)} * {_R.WORDS_A_SYMBOL} > {words}" for p in (_R.SYMBOLS, _R.MARKS, _R.SEPARATORS))
    end, phrases = _R.END_MARK.replace("'", "''"), "|".join(_R.BOILERPLATE)
    short = f"{words} <= {_R.SHORT_LINE} AND NOT regexp_matches(s, '{end}')"
    capitals = f"{letters} >= 20 AND {_count('s', r'\p{Lu}')} * 2 > {letters}"
    return f"{words} > 0 AND ({many} OR ({short}) OR ({capitals}) OR ({words} <= {_R.BOILERPLATE_LINE} AND regexp_matches(s, '(?i){phrases}')))"


_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM d),
judged AS (SELECT doc_id, s, {_count("s", WORD)} AS words, {_line_fails()} AS fails FROM lines),
by_line AS (SELECT doc_id, sum(words) AS n_words, sum(CASE WHEN fails THEN 0 ELSE words END) AS n_left, count(*) FILTER (WHERE words > 0) - count(DISTINCT CASE WHEN words > 0 THEN s END) AS n_dup_lines FROM judged GROUP BY doc_id),
lists AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS ws FROM d),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM lists),
grams AS (SELECT doc_id, i, w || chr(10) || lead(w) OVER a || chr(10) || lead(w, 2) OVER a AS g FROM words WINDOW a AS (PARTITION BY doc_id ORDER BY i)),
counted AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams WHERE g IS NOT NULL),
again AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM counted, (VALUES (0), (1), (2)) v(k) WHERE c > 1 GROUP BY doc_id),
base AS (SELECT d.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(length(text) - {_count("text", f"[{SPACE}]")} AS BIGINT) AS word_chars, CAST({_count("text", _R.SYMBOLS)} AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words, n_left FROM d JOIN by_line b ON b.doc_id = d.doc_id LEFT JOIN again ON again.doc_id = d.doc_id),
failed AS (SELECT *, n_words < {_R.LEAST_WORDS} OR n_repeat_words * 100 > n_words * {_R.MOST_REPEATED_PERCENT} AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_left * 100 >= n_words * {_R.KEEP_PERCENT} AS kept FROM failed
"""

_AUDIT = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '{WORD}') AS ws, min(doc_id) OVER (PARTITION BY t) < doc_id AS copy FROM d),
f AS (SELECT doc_id, part, CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN copy THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY part, mask),
k AS (SELECT chr(65 + i) AS letter, 1 << i AS bit FROM (SELECT unnest(range(0, 5))::INTEGER AS i)),
o AS (SELECT p.letter || q.letter || r.letter || s.letter || t.letter AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits FROM k p, k q, k r, k s, k t WHERE p.bit | q.bit | r.bit | s.bit | t.bit = 31),
steps AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM o)),
r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & before = 0), 0) AS removed,
  coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & before > 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
  coalesce(sum(good) FILTER (WHERE mask & bit > 0 AND mask & before = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & bit > 0 AND mask & before = 0), 0) AS toxic_lost FROM c, steps GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""

ORACLE: dict[str, str] = {"op4_line_dedup": _LINES, "op9_line_rules": _RULES, "op11_filter_audit": _AUDIT}
