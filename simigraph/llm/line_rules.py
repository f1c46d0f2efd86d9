"""Operator 9: quality rules that clean lines first.

Lines are judged one by one: by punctuation (symbols or doubled exclamation
marks for too many of the words), by navigation (separators between the words,
or a few words without an end mark), and as boilerplate (phrases of cookie
banners, sign-in boxes and the like in a short line, or mostly capitals). Lines
that fail are removed; a document that loses too much of its text with them is
rejected. Documents that fail the base rules (too few words, or too many words
in three-word windows that come again) are rejected anyway.

All of it is column expressions within a row: no shuffle, no Python. Rules that
few lines can break are asked behind a test that is cheap and passes all lines
that break them. Null texts are empty and fail. Very long texts are judged whole,
as arrays of their words and lines. Repeated rows and null ids need no rule; an
empty table gives an empty result. ``judge`` keeps all columns of its input,
whatever their names, and adds one struct under the name asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simigraph.llm import common
from simigraph.llm.common import SPACE, WORD

LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: A line fails with more than one symbol, mark or separator for so many words.
WORDS_A_SYMBOL = 4
#: Shorter lines without an end mark are navigation.
SHORT_LINE = 3
#: Boilerplate is looked for in lines of up to so many words.
BOILERPLATE_LINE = 30
#: Least share of the words that have to stay, in per cent.
KEEP_PERCENT = 50

SYMBOLS, MARKS, SEPARATORS = "[#*$%&|<>]", "[!?]{2,}", "[|»›·•]"
#: A line with none of these breaks no rule of punctuation or separators; one with fewer capitals has too few of them.
ANY_MARK, CAPITALS = "[#*$%&|<>»›·•]|[!?]{2}", r"\A(?:[^\p{Lu}]*+\p{Lu}){11}"
END_MARK = r"[.!?…:;,\"'”»)\]][" + SPACE + "]*$"
# Fixed phrases of web boilerplate.
BOILERPLATE = (
    "accept all cookies", "all rights reserved", "click here to", "enable javascript", "javascript is disabled", "lorem ipsum",
    "privacy policy", "sign in to", "skip to content", "subscribe to our", "terms of service", "terms of use", "this site uses cookies",
)


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def line_fails(line: Column, words: Column, phrases: Column) -> Column:
    """True for a line with words that a rule removes; without ``phrases`` the text has none of the boilerplate."""
    marked = line.rlike(ANY_MARK) & ((count(line, SYMBOLS) * WORDS_A_SYMBOL > words) | (count(line, MARKS) * WORDS_A_SYMBOL > words) | (count(line, SEPARATORS) * WORDS_A_SYMBOL > words))
    navigation = (words <= SHORT_LINE) & ~line.rlike(END_MARK)
    letters = count(line, r"\p{L}")
    capitals = line.rlike(CAPITALS) & (letters >= 20) & (count(line, r"\p{Lu}") * 2 > letters)
    boilerplate = phrases & (words <= BOILERPLATE_LINE) & line.rlike("(?i)" + "|".join(BOILERPLATE))
    return (words > 0) & (marked | navigation | capitals | boilerplate)


def repeat_words(words: str) -> Column:
    """Words in windows of three that come twice or more; ``words`` is a column of the row's words."""
    w = F.col(words)
    hashes = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) >= 3, F.slice(hashes, 1, F.size(w) - 2)).otherwise(F.array().cast("array<bigint>"))


def judge(docs: DataFrame, text_col: str = "text", out: str = "rules") -> DataFrame:
    """Adds a struct: the counts, base_failed, kept and the cleaned text."""
    own = docs.columns
    name = lambda s: common.fresh_name(own, f"_{out}_{s}")
    text, words, grams, lines, order, covered, phrases, low = (F.col(name(s)) for s in ("text", "words", "grams", "lines", "order", "covered", "phrases", "low"))
    docs = docs.select("*", F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(name("text")))
    docs = docs.select("*", F.array_remove(F.split(text, f"[{SPACE}]+"), "").alias(name("words")), F.lower(text).alias(name("low")))
    some = F.lit(False)
    for p in BOILERPLATE:
        some = some | low.contains(p)
    counted = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("s"), count(x, WORD).alias("w")))
    docs = docs.select("*", some.alias(name("phrases")), counted.alias(name("lines")), repeat_words(name("words")).alias(name("grams")))
    repeats = F.size(F.array_distinct(grams)) < F.size(grams)
    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    docs = docs.select("*", F.when(repeats, pairs).alias(name("order")), F.filter(lines, lambda x: ~line_fails(x["s"], x["w"], phrases)).alias(name("left")))
    again = F.filter(F.transform(order, lambda x, k: F.when((x["h"] == F.get(order, k - 1)["h"]) | (x["h"] == F.get(order, k + 1)["h"]), x["i"])), lambda i: i.isNotNull())
    docs = docs.select("*", F.array_distinct(F.flatten(F.transform(again, lambda i: F.array(i, i + 1, i + 2)))).alias(name("covered")), F.filter(lines, lambda x: x["w"] > 0)["s"].alias(name("full")))
    full, left = F.col(name("full")), F.col(name("left"))
    n_repeat = F.when(order.isNull(), F.lit(0).cast("long")).otherwise(F.size(covered).cast("long"))
    docs = docs.select(
        *own,
        F.size(words).cast("long").alias(name("n")),
        F.length(F.array_join(words, "")).cast("long").alias(name("chars")),
        count(text, SYMBOLS).cast("long").alias(name("symbols")),
        (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias(name("dups")),
        n_repeat.alias(name("repeats")),
        F.array_join(left["s"], "\n").alias(name("clean")),
        F.aggregate(left["w"], F.lit(0).cast("long"), lambda a, w: a + w).alias(name("kept")),
    )
    n, rep = F.col(name("n")), F.col(name("repeats"))
    failed = (n < LEAST_WORDS) | (rep * 100 > n * MOST_REPEATED_PERCENT)
    enough = F.col(name("kept")) * 100 >= n * KEEP_PERCENT
    verdict = F.struct(
        n.alias("n_words"), F.col(name("chars")).alias("word_chars"), F.col(name("symbols")).alias("n_symbols"), F.col(name("dups")).alias("n_dup_lines"),
        rep.alias("n_repeat_words"), failed.alias("base_failed"), (~failed & enough).alias("kept"), F.col(name("clean")).alias("text"),
    )
    # A generator keeps a filter on the verdict from being pushed into the array expressions above, which it would repeat for every element.
    return docs.select(*own, F.explode(F.array(verdict)).alias(out))
