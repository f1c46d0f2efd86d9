"""Weighted scores of candidate pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simigraph import store
from simigraph.config import Config, Thresholds
from simigraph.functions import matchers, names
from simigraph.operators.blocking import expanded, grouped_pairs

#: The weighted matchers, in the order of the scores.
WEIGHTED = ("exact_match", "token_similarity", "fuzzy_similarity", "ngram_similarity", "char_frequency", "size_similarity", "numeric_validation", "extension_intelligence", "semantic_similarity")


def category(score: Column, t: Thresholds | None = None) -> Column:
    t = t or Thresholds()
    steps = ((t.almost_certain, "almost certain duplicate"), (t.highly_likely, "highly likely"), (t.potential, "potential duplicate"), (t.weak, "weak similarity"))
    out = F.lit("ignore")
    for least, name in reversed(steps):
        out = F.when(score >= least, F.lit(name)).otherwise(out)
    return out


def attach(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """Both files' columns, under a_ and b_."""
    side = lambda s: files.select(*(F.col(c).alias(f"{s}_{c}") for c in files.columns))
    return pairs.join(side("a"), F.col("path_a") == F.col("a_path")).join(side("b"), F.col("path_b") == F.col("b_path"))


#: Matchers that are made of few bytes; what they leave below the least score isn't given to the dearer ones.
CHEAP = ("exact_match", "token_similarity", "size_similarity", "numeric_validation")
#: Matchers that read nothing but what a name gives, so that they are made once for two groups of files.
BY_NAME = ("exact_match", "token_similarity", "fuzzy_similarity", "ngram_similarity", "char_frequency", "numeric_validation", "extension_intelligence")


@dataclass(frozen=True)
class _Weighing:
    """Which matchers count, with their weights, in the order in which scores are shown."""

    weights: dict[str, float]
    shown: list[str]
    folder: bool
    folder_bonus: bool
    least: float

    def total(self, of: Callable[[str], Column]) -> Column:
        return sum((of(m) * w for m, w in self.weights.items()), F.lit(0.0)) / sum(self.weights.values()) if self.weights else F.lit(0.0)

    @property
    def bonus(self) -> Column:
        if not self.folder_bonus:
            return F.lit(0.0)
        return F.when(F.col("_folder_context") == 100, matchers.FOLDER_BONUS).when(F.col("_folder_context") >= 90, matchers.NEAR_FOLDER_BONUS).otherwise(0.0)

    def within_reach(self, pairs: DataFrame, known: Sequence[str]) -> DataFrame:
        """Pairs that reach the least score if all matchers but the known ones give 100."""
        bonus = self.bonus if "folder_context" in known else F.lit(matchers.FOLDER_BONUS if self.folder_bonus else 0.0)
        most = self.total(lambda m: F.col(f"_{m}") if m in known else F.lit(100.0)) + bonus
        return pairs.where(most >= self.least - 0.01)


def _weighing(config: Config, threshold: float | None, vectors: bool) -> _Weighing:
    on, weights, known = config.algorithms, config.weights, matchers.registry()
    enabled = lambda m: getattr(on, m, True)
    used = [m for m in [*WEIGHTED, *(k for k in known if k not in (*WEIGHTED, "folder_context"))] if enabled(m) and getattr(weights, m, 0.0) > 0]
    if not vectors and "semantic_similarity" in used:
        used.remove("semantic_similarity")
    weigh = {m: getattr(weights, m) for m in used}
    shown = (["numeric_validation"] if enabled("numeric_validation") else []) + [m for m in used if m != "numeric_validation"]
    folder = enabled("folder_context")
    if folder and weights.folder_context > 0:
        weigh["folder_context"] = weights.folder_context
        shown.append("folder_context")
    return _Weighing(weigh, shown, folder, folder and weights.folder_context <= 0, max(config.thresholds.weak, threshold or 0.0))


def _with(pairs: DataFrame, names_: Sequence[str]) -> DataFrame:
    known = matchers.registry()
    for m in names_:
        pairs = pairs.withColumn(f"_{m}", known[m]())
    return pairs


def score_pairs(pairs: DataFrame, config: Config, threshold: float | None = None) -> DataFrame:
    """Matches of attached pairs, or of grouped ones: sizes, scores, confidence and category.

    What rejects a pair outright comes first, then the cheap matchers, then those
    of n-grams, characters and vectors, and the Python one at last; before each
    step, pairs go that can't reach the threshold any more. Of grouped pairs, what
    names give is scored for both groups at once, the rest for each pair of files.
    """
    store.ship(pairs.sparkSession)
    w, on, grouped = _weighing(config, threshold, "a_vector" in pairs.columns or _has_vectors(pairs)), config.algorithms, "a_files" in pairs.columns
    folder = ["folder_context"] if w.folder else []
    own = [m for m in w.weights if m not in BY_NAME and m != "folder_context"] if grouped else []
    pairs = pairs.withColumn("_extension", matchers.registry()["extension_intelligence"]() if on.extension_intelligence else F.lit(100.0)).where("_extension <> 0")
    if on.numeric_validation:
        pairs = _with(pairs, ["numeric_validation"]).where(F.col("_numeric_validation") != matchers.REJECT)
    done = [m for m in CHEAP if m in w.weights and m not in own]
    early = [m for m in done if m != "numeric_validation"] + ([] if grouped else folder)
    pairs, done = _with(pairs, early), done + ([] if grouped else folder)
    pairs = w.within_reach(pairs, done)
    dear = [m for m in w.weights if m not in (*done, *own, "fuzzy_similarity", "folder_context")]
    pairs, done = _with(pairs, dear), done + dear
    if "fuzzy_similarity" in w.weights:
        pairs, done = _with(w.within_reach(pairs, done), ["fuzzy_similarity"]), [*done, "fuzzy_similarity"]
    if grouped:
        pairs = _with(expanded(w.within_reach(pairs, done)), [*folder, *own])
    score = F.least(F.lit(100.0), w.total(lambda m: F.col(f"_{m}")) + w.bonus)
    score = F.when(F.col("_extension") == 90, F.greatest(F.lit(0.0), score - matchers.OTHER_EXTENSION)).otherwise(score)
    scores = F.map_from_arrays(F.array(*map(F.lit, w.shown)), F.array(*(F.col(f"_{m}") for m in w.shown))) if w.shown else F.create_map().cast("map<string,double>")
    found = pairs.select("path_a", "path_b", F.col("a_size").alias("file_a_size"), F.col("b_size").alias("file_b_size"), scores.alias("scores"), names.two_places(score).alias("confidence_score"))
    return found.where(F.col("confidence_score") >= w.least).withColumn("category", category(F.col("confidence_score"), config.thresholds))


def _has_vectors(pairs: DataFrame) -> bool:
    return "a_files" in pairs.columns and "vector" in pairs.schema["a_files"].dataType.elementType.names


def match_files(files: DataFrame, config: Config | None = None, threshold: float | None = None) -> DataFrame:
    """From file features to matches, best first."""
    config = config or Config()
    found = matches_of(store.materialise(files, "features"), config, threshold)  # read several times; made once
    # Sorting looks at its input twice.
    return store.materialise(found, "matches").orderBy(F.desc("confidence_score"), "path_a", "path_b")


def matches_of(files: DataFrame, config: Config, threshold: float | None = None) -> DataFrame:
    """Matches of all candidate pairs; files are read several times."""
    return score_pairs(grouped_pairs(files, config.blocking, files.columns), config, threshold)


def category_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("category").agg(F.count("*").alias("matches")).orderBy(F.desc("matches"), "category")


def in_scope(matches: DataFrame, *folders: str, strict: bool = False) -> DataFrame:
    """Pairs with either side in one of the folders."""
    return matches.where(names.in_folders(F.col("path_a"), folders, strict) | names.in_folders(F.col("path_b"), folders, strict))
