"""Operator 4: line deduplication by winnowing.

The units are lines with at least one word. A window is a shortest run of lines
with RUN_WORDS words or more that begins at a line. Of each window the line with
the least hash is selected (the first of equal ones); neighbouring windows mostly
select the same line, so fingerprints are far fewer than lines. Two places that
share a run of RUN_WORDS words share the window at its beginning, and so a
selected line.

Positions of fingerprints are joined with the fingerprints that occur at more
than one place. Only around those positions are texts compared: matches are
extended both ways by the windows that begin, and those that end, at each line
near them, compared by 128 bits of the SHA-256 of their lines. A line of a repeated run
lies in the window that begins there or in the one that ends there, within the
run, and each of these holds a selected line of the run. So the windows that
come again cover exactly the lines of all repeated runs, even where the rest of
a run has another first copy than its beginning, which extending against one
partner would miss; and a passage in a third of all documents gives as many
matches as it has copies. Each place is compared with the first one, in the
order of (document id, text hash, line). Lines of later copies are deleted; the
first copy stays.

Lines without words go where the nearest lines with words on both sides go.
Texts without words, and nulls, are left as they are. Null ids come first. Rows
with the same id and text are one document: all of them keep or lose the same
lines, and each is read by itself, so that no task gathers them. Of a very long
text the lines, not the text, are sorted, by a task that can spill. An empty
table gives an empty result. All columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simigraph.llm import common
from simigraph.llm.common import WORD

RUN_WORDS = 50
DOC = ("doc", "hash", "row")


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, hash, row, line, no (among lines with words), start and stop (in words), h and digest of lines with words."""
    text = F.col(text_col).cast("string")
    # Rows get their number before they are cut into lines.
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    rows = rows.select(*DOC, F.posexplode(F.split("text", "\n")).alias("line", "s"))
    rows = rows.select(*DOC, "line", F.regexp_count("s", F.lit(WORD)).alias("words"), F.xxhash64("s").alias("h"), F.unhex(F.left(F.sha2("s", 256), F.lit(32))).alias("digest")).where("words > 0")
    so_far = Window.partitionBy(*DOC).orderBy("line")
    rows = rows.withColumn("stop", F.sum("words").over(so_far)).withColumn("no", F.row_number().over(so_far))
    return rows.select(*DOC, "line", "no", (F.col("stop") - F.col("words")).alias("start"), "stop", "h", "digest")


def ahead(run_words: int) -> Window:
    """The shortest run of so many words that begins at a line."""
    return Window.partitionBy(*DOC).orderBy("start").rangeBetween(0, run_words - 1)


def behind(run_words: int) -> Window:
    """The shortest run of so many words that ends at a line."""
    return Window.partitionBy(*DOC).orderBy("stop").rangeBetween(1 - run_words, 0)


def words_in(w: Window) -> Column:
    return F.max("stop").over(w) - F.min("start").over(w)


def winnowed(lines: DataFrame, run_words: int) -> DataFrame:
    """The lines; ``pick`` is the line that the window beginning there selects, where the window before it has another."""
    w = ahead(run_words)
    least = F.when(words_in(w) >= run_words, F.min(F.struct("h", "no", "line", "start", "stop")).over(w))
    # Windows move on, and so do the lines they select: equal choices are neighbours.
    chosen = lines.withColumn("least", least).withColumn("last", F.lag("least").over(Window.partitionBy(*DOC).orderBy("start"))["no"])
    return chosen.select(*DOC, "line", "no", "start", "stop", "digest", F.when(~F.col("least.no").eqNullSafe(F.col("last")), F.col("least")).alias("pick"))


def near_repeats(lines: DataFrame, run_words: int) -> DataFrame:
    """The lines around the places of fingerprints that occur at more than one place."""
    picked = lines.where("pick is not null").select(*DOC, "pick.*")
    place = F.struct("doc", "hash", "line")
    twice = picked.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("z")).where("a <> z").select("h")
    hits = picked.join(common.materialise(twice, "fingerprints"), "h").select(*DOC, "start", "stop", F.lit(True).alias("hit"))
    all_ = lines.select(*DOC, "line", "no", "start", "stop", "digest").unionByName(hits, allowMissingColumns=True)
    reach = lambda at: F.max("hit").over(Window.partitionBy(*DOC).orderBy(at).rangeBetween(1 - run_words, run_words - 1))
    return all_.withColumn("near", F.coalesce(reach("start"), reach("stop"))).where("near and hit is null").drop("near", "hit")


def windows(near: DataFrame, run_words: int) -> DataFrame:
    """doc, hash, the window's numbers (begin, end) and lines (from, to), and a digest, of complete windows both ways."""

    def window(w: Window) -> Column:
        whole = (words_in(w) >= run_words) & (F.max("no").over(w) - F.min("no").over(w) + 1 == F.count("*").over(w))
        return F.when(whole, F.struct(F.min("no").over(w).alias("begin"), F.max("no").over(w).alias("end"), F.min("line").over(w).alias("from"), F.max("line").over(w).alias("to"), F.collect_list("digest").over(w).alias("digests")))

    both = near.select("doc", "hash", F.array(window(ahead(run_words)), window(behind(run_words))).alias("both"))
    found = both.select("doc", "hash", F.explode(F.array_distinct(F.filter("both", lambda w: w.isNotNull()))).alias("w"))
    digest = F.unhex(F.left(F.sha2(F.array_join(F.transform("w.digests", F.hex), ""), 256), F.lit(32)))
    return found.select("doc", "hash", "w.begin", "w.end", "w.from", "w.to", digest.alias("key"))


def repeated_ranges(docs: DataFrame, run_words: int = RUN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, hash and the disjoint ranges of line numbers that repeat what came before."""
    lines = common.materialise(winnowed(lines_of(docs, id_col, text_col), run_words), "lines")
    found = common.materialise(windows(near_repeats(lines, run_words), run_words), "windows")
    place = F.struct("doc", "hash", "begin")
    first = found.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last")
    first = common.materialise(first, "first")
    # Windows of rows that repeat a document are the same, and count once.
    later = found.join(first, "key").where(~place.eqNullSafe(F.col("first"))).select("doc", "hash", "begin", "end", "from", "to").distinct()
    of = Window.partitionBy("doc", "hash").orderBy("begin", "end")
    reach = F.max("end").over(of.rowsBetween(Window.unboundedPreceding, -1))
    opened = later.withColumn("opens", F.coalesce(F.col("begin") > reach + 1, F.lit(True)).cast("int"))
    ranged = opened.withColumn("range", F.sum("opens").over(of.rowsBetween(Window.unboundedPreceding, 0)))
    merged = ranged.groupBy("doc", "hash", "range").agg(F.min("from").alias("begin"), F.max("to").alias("end"))
    return merged.groupBy("doc", "hash").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("ranges"))


def dedup_lines(docs: DataFrame, run_words: int = RUN_WORDS, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The documents without their later repeated runs; ``count_col`` gets the number of lines deleted."""
    ranges = common.materialise(repeated_ranges(docs, run_words, id_col, text_col), "ranges")
    # The input's columns lie in a struct while others are beside them, so no names clash.
    text = F.col("row").getField(text_col).cast("string")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("key"))
    joined = rows.join(ranges.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("doc")) & (F.col("key") == F.col("hash")), "left")
    joined = joined.select("row", "ranges", F.when(F.col("ranges").isNotNull(), F.split(text, "\n")).alias("lines"))
    gone = lambda x, i: F.exists("ranges", lambda r: (i >= r["begin"]) & (i <= r["end"]))
    left = joined.withColumn("left", F.filter("lines", lambda x, i: ~gone(x, i)))
    field = F.col("row").getField
    cols = [F.when(F.col("left").isNull(), field(c)).otherwise(F.array_join("left", "\n")).alias(c) if c == text_col else field(c).alias(c) for c in docs.columns]
    lost = F.coalesce(F.size("lines") - F.size("left"), F.lit(0)).cast("long")
    lost = F.when(F.col("left").isNull(), F.lit(0).cast("long")).otherwise(lost)
    return left.select(*cols, *([lost.alias(count_col)] if count_col else []))
