import random

import pytest
from pyspark.sql import functions as F

from simigraph.config import Config, Normalization, Thresholds
from simigraph.functions import fuzzy as batches
from simigraph.functions import matchers, names
from simigraph.functions.fuzzy import fuzzy, partial_ratio, ratio, token_set_ratio, token_sort_ratio
from simigraph.operators.scoring import attach, category, score_pairs
from simigraph.sources import catalog

OPTIONS = Normalization()


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("name", "cleaned", "tokens"),
    [
        ("The.Dark.Knight.2008.1080p.BluRay.x264-YIFY.mkv", "dark knight 2008", ["dark", "knight", "2008"]),
        ("The.And.txt", "the and", []),
        ("Audio.mp3", "", []),
        ("backup 20240115.pdf", "backup", ["backup"]),
        ("h.264.mp4", "264", ["264"]),
    ],
)
def test_normalised_names(spark, name, cleaned, tokens):
    files = spark.createDataFrame([(f"/a/{name}", 1, 0.0)], "path string, size long, mtime double")
    r = catalog.records(files, OPTIONS).first()
    assert (r.normalized_name, r.tokens) == (cleaned, tokens)


def test_signature_and_bucket(spark):
    r = spark.createDataFrame([(["b", "a", "b"], "abcdefghijk")], "t array<string>, n string")
    assert r.select(names.token_signature(F.col("t")), names.length_bucket(F.col("n"))).first()[:] == ("bc2113d71a4e", 2)


@pytest.mark.parametrize(("name", "suffix"), [("a.MKV", ".mkv"), ("Movie.2008", ".2008"), (".bashrc", ""), ("plain", ""), ("a.", ""), (".a.b", ".b")])
def test_suffix(spark, name, suffix):
    assert one(spark, names.suffix(F.col("n")), n=name) == suffix


@pytest.mark.parametrize(
    ("text", "found"),
    [("Show.S01E02.mkv", {"s1e2"}), ("1920x1080 a", {"s1920e1080"}), ("step 5", {"ep5"}), ("episode 06", set()), ("a s00e00", {"s0e0"})],
)
def test_episodes(spark, text, found):
    assert set(one(spark, names.episodes(F.col("t")), t=text)) == found


def test_numbers_keep_their_zeros(spark):
    assert set(one(spark, names.numbers(F.col("t")), t="1 01 a2")) == {"1", "01"}


@pytest.mark.parametrize(("size", "shown"), [(0, "0.00 B"), (1023, "1023.00 B"), (1024, "1.00 KB"), (5 * 1024**3, "5.00 GB"), (3 * 1024**6, "3072.00 PB"), (976000, "953.12 KB"), (1047, "1.02 KB")])
def test_human_size(spark, size, shown):
    assert one(spark, names.human_size(F.col("s")), s=size) == shown


@pytest.mark.parametrize(("size", "shown"), [(5, "5 B"), (1536, "1.5 KB"), (2 * 1024**2, "2 MB"), (10 * 1024**4, "10240 GB")])
def test_short_size(spark, size, shown):
    assert one(spark, names.short_size(F.col("s")), s=size) == shown


def test_fuzzy_definitions():
    assert ratio("kitten", "sitting") == pytest.approx(61.538461, abs=1e-5)
    assert partial_ratio("dark knight", "dark knight 2008") == 100
    assert token_sort_ratio("b a", "a b") == 100
    assert token_set_ratio("dark knight", "dark knight 2008") == 100
    assert token_set_ratio("", "a") == 0
    assert fuzzy("", "") == 100 and fuzzy("", "a") == 0
    assert fuzzy("dark knight 2008", "dark knight") == pytest.approx(90.74, abs=0.01)


def pair(spark, a, b, config=None):
    """(path, size) of both sides to their match or None."""
    rows = spark.createDataFrame([(*a, 0.0), (*b, 0.0)], "path string, size long, mtime double")
    files = catalog.features(catalog.records(rows, OPTIONS))
    pairs = spark.createDataFrame([(a[0], b[0])], "path_a string, path_b string")
    found = score_pairs(attach(pairs, files), config or Config())
    return found.withColumn("json", F.to_json("scores")).first()


def test_scores_of_known_pairs(spark):
    m = pair(spark, ("/x/dark knight 2008.mkv", 1000), ("/y/dark knight.mkv", 990))
    assert m.scores["token_similarity"] == pytest.approx(73.33, abs=0.01)
    assert m.scores["ngram_similarity"] == pytest.approx(65.48, abs=0.01)
    assert m.scores["char_frequency"] == pytest.approx(81.65, abs=0.01)
    assert m.scores["numeric_validation"] == 30 and m.scores["size_similarity"] == 90
    assert m.confidence_score == pytest.approx(44.91, abs=0.01) and m.category == "weak similarity"
    m = pair(spark, ("/x/dark knight 2008.mkv", 1000), ("/x/dark knight.mkv", 990))
    assert m.confidence_score == pytest.approx(49.91, abs=0.01)
    m = pair(spark, ("/x/dark knight 2008.mkv", 1000), ("/x/dark knight.mp4", 990))
    assert m.confidence_score == pytest.approx(47.91, abs=0.01)


def test_known_match_of_two_images(spark):
    m = pair(spark, ("/s/holiday photo.png", 2914781), ("/s/sub/holiday photo.jpg", 2914521))
    assert (m.confidence_score, m.category) == (97.5, "almost certain duplicate")
    assert m.json.startswith('{"numeric_validation"')


@pytest.mark.parametrize(("a", "b"), [("/x/Show.S01E01.mkv", "/x/Show.S01E02.mkv"), ("/x/a.mp4", "/x/a.mp3"), ("/x/1920x1080 a.mkv", "/x/1280x720 a.mkv")])
def test_rejected_pairs(spark, a, b):
    assert pair(spark, (a, 10), (b, 10)) is None


@pytest.mark.parametrize(("a", "b", "score"), [(0, 0, 100), (100, 98, 90), (100, 95, 75), (100, 90, 50), (100, 75, 25), (100, 74, 0)])
def test_size_steps(spark, a, b, score):
    assert one(spark, matchers.size(), a_size=a, b_size=b) == score


@pytest.mark.parametrize(("score", "name"), [(95.0, "almost certain duplicate"), (94.99, "highly likely"), (80.0, "highly likely"), (60.0, "potential duplicate"), (40.0, "weak similarity"), (39.99, "ignore")])
def test_categories(spark, score, name):
    assert one(spark, category(F.col("s"), Thresholds()), s=score) == name


def test_own_matcher(spark):
    @matchers.matcher("always")
    def always():
        return F.lit(100.0)

    assert matchers.registry()["always"] is always
    matchers._registry.pop("always")


def test_config_merges_and_replaces_lists():
    c = Config().merged({"scan": {"exclude_folders": [".git"]}, "weights": {"exact_match": 1.0}, "unknown": 1})
    assert c.scan.exclude_folders == (".git",) and c.weights.exact_match == 1.0 and c.weights.token_similarity == 20.0


def test_batches_equal_pairs_one_by_one():
    rnd = random.Random(11)
    words = ["red", "house", "sea", "a", "ünï", "漢字", "x264", "s01e02", "holiday", "b"]
    names_ = ["", " ", "  ", "x" * 64, "x" * 63 + "y", "y" * 65, "ab" * 40, "a" * 200] + [" ".join(rnd.choices(words, k=rnd.randint(1, 9))) for _ in range(60)]
    names_ += ["".join(rnd.choice("abc 漢🙂") for _ in range(rnd.randint(1, 70))) for _ in range(40)]
    pairs = [(rnd.choice(names_), rnd.choice(names_)) for _ in range(1500)]
    got = batches.fuzzy_many(*zip(*pairs, strict=True))
    assert got == [batches.fuzzy(*p) for p in pairs]
    assert batches.fuzzy_many([], []) == []
    some = [p for p in pairs if p[0] and p[1] and min(map(len, p)) <= batches.WORD]
    assert batches.lcs_many(*zip(*some, strict=True)).tolist() == [batches.lcs(batches.positions(a), len(a), b) for a, b in some]
    assert batches.partial_many(*zip(*some, strict=True)).tolist() == [batches.partial_ratio(*p) for p in some]
