"""Likeness of two files, 0 to 100, from columns that begin with ``a_`` and ``b_``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from simigraph.functions.fuzzy import fuzzy_score
from simigraph.functions.names import two_places

REJECT = -100.0
# Shares by which sizes may differ, with their scores; bonuses for folders, and the loss for another extension.
SIZE_STEPS = ((0.02, 90.0), (0.05, 75.0), (0.10, 50.0), (0.25, 25.0))
FOLDER_BONUS, NEAR_FOLDER_BONUS, OTHER_EXTENSION = 5.0, 3.0, 2.0
Matcher = Callable[[], Column]
_registry: dict[str, Matcher] = {}


def matcher(name: str) -> Callable[[Matcher], Matcher]:
    """Register a function that gives the score's column; a later one of the same name replaces it."""

    def put(f: Matcher) -> Matcher:
        _registry[name] = f
        return f

    return put


def unregister(name: str) -> None:
    _registry.pop(name)


def registry() -> dict[str, Matcher]:
    return dict(_registry)


def _ab(name: str) -> tuple[Column, Column]:
    return F.col(f"a_{name}"), F.col(f"b_{name}")


def _share(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def _unless_empty(a: Column, b: Column, empty_a: Column, empty_b: Column, score: Column) -> Column:
    """Equal or nothing where a side is empty."""
    return F.when(empty_a | empty_b, F.when(a == b, 100.0).otherwise(0.0)).otherwise(score)


@matcher("exact_match")
def exact() -> Column:
    (a, b), (f, g) = _ab("normalized_name"), _ab("filename")
    return F.when((a == b) & (a != ""), 100.0).when(F.lower(f) == F.lower(g), 95.0).otherwise(0.0)


@matcher("token_similarity")
def token() -> Column:
    (a, b), (x, y) = _ab("normalized_name"), _ab("token_set")
    both = F.size(F.array_intersect(x, y))
    score = (both / F.size(F.array_union(x, y)) + 2.0 * both / (F.size(x) + F.size(y))) / 2 * 100
    no_x, no_y = F.size(x) == 0, F.size(y) == 0
    return F.when(no_x & no_y, F.when(a == b, 100.0).otherwise(0.0)).when(no_x | no_y, 0.0).otherwise(two_places(score))


@matcher("fuzzy_similarity")
def fuzzy() -> Column:
    """Equal names don't reach the Python part."""
    a, b = _ab("normalized_name")
    return F.when(a == b, 100.0).otherwise(fuzzy_score(F.when(a != b, a), F.when(a != b, b)))


@matcher("ngram_similarity")
def ngram() -> Column:
    a, b = _ab("normalized_name")
    return _unless_empty(a, b, a == "", b == "", two_places((_share(*_ab("bigrams")) + _share(*_ab("trigrams"))) / 2 * 100))


@matcher("char_frequency")
def char_frequency() -> Column:
    """Cosine of the counts of letters and digits; equal ones aren't multiplied."""
    x, y = _ab("chars")
    square = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, e: s + e["n"] * e["n"])
    count_in = lambda c, k: F.aggregate(c, F.lit(0).cast("long"), lambda s, e: s + F.when(e["c"] == k, e["n"]).otherwise(0))
    dot = F.aggregate(x, F.lit(0).cast("long"), lambda s, e: s + e["n"] * count_in(y, e["c"]))
    cosine = dot / (F.sqrt(square(x).cast("double")) * F.sqrt(square(y).cast("double"))) * 100
    no_x, no_y = F.size(x) == 0, F.size(y) == 0
    return F.when(x == y, 100.0).when(no_x | no_y, 0.0).otherwise(two_places(cosine))


@matcher("size_similarity")
def size() -> Column:
    a, b = _ab("size")
    off = F.abs(a - b) / F.greatest(a, b)
    out = F.when(a == b, 100.0)
    for share, score in SIZE_STEPS:
        out = out.when(off <= share, score)
    return out.otherwise(0.0)


@matcher("numeric_validation")
def numeric() -> Column:
    """Episodes, else years, else numbers decide where both sides have them; -100 if they differ."""
    some = lambda c: F.size(c) > 0
    out, any_a, any_b = None, F.lit(False), F.lit(False)
    chain = []
    for kind in ("episodes", "years", "numbers"):
        a, b = _ab(kind)
        same = F.array_sort(a) == F.array_sort(b)
        chain.append((some(a) & some(b), F.when(same, 100.0).otherwise(REJECT)))
        any_a, any_b = any_a | some(a), any_b | some(b)
    out = F.when(*chain[0])
    for condition, value in chain[1:]:
        out = out.when(condition, value)
    return out.when(any_a != any_b, 30.0).otherwise(100.0)


@matcher("extension_intelligence")
def extension() -> Column:
    (a, b), (x, y) = _ab("extension"), _ab("extension_category")
    return F.when(a == b, 100.0).when(x == y, F.when(x == "other", 50.0).otherwise(90.0)).otherwise(0.0)


@matcher("folder_context")
def folder() -> Column:
    (a, b), (x, y) = _ab("parent_folder"), _ab("folder")
    named = (x != "") & (y != "")
    return F.when(a == b, 100.0).when((x == y) & (x != ""), 90.0).when(named & (x.contains(y) | y.contains(x)), 80.0).otherwise(50.0)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, v: s + v))


def cosine_score(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Of two vectors, 0 to 100; nothing where one is missing or has no length. Norms that are known aren't made again."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    lengths = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    cosine = dot / F.nullif(lengths, F.lit(0.0))
    # Nulls must not reach least and greatest, which pass them over.
    return F.when(cosine.isNull(), 0.0).otherwise(two_places(F.greatest(F.lit(0.0), F.least(F.lit(100.0), cosine * 100))))


@matcher("semantic_similarity")
def semantic() -> Column:
    """From vectors in the column ``vector``."""
    a, b = _ab("normalized_name")
    return _unless_empty(a, b, a == "", b == "", cosine_score(*_ab("vector")))
