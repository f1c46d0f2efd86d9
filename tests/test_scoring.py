"""Scores with default weights against plain Python over all candidate pairs; vectors, patterns and the JSON array."""

import collections
import datetime
import gzip
import json
import math
import os
import random
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from simigraph.config import Algorithms, Config
from simigraph.functions import matchers, names
from simigraph.operators import blocking, scoring, vectors
from simigraph.plans.matching import OPTIONS
from simigraph.sources import json_array
from simigraph.sources.catalog import features, named_features, part_records, records

SF = "/root/testdata/sf0.001"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a, b):
    return 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial(a, b):
    if len(a) > len(b):
        a, b = b, a
    slide = lambda s, t: max(ratio(s, t[max(0, e - len(s)) : min(e, len(t))]) for e in range(1, len(t) + len(s)))
    return max(slide(a, b), slide(b, a)) if len(a) == len(b) else slide(a, b)


def fuzzy(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0
    x, y = set(a.split()), set(b.split())
    shared, da, db = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if x & y and (not x - y or not y - x):
        token_set = 100.0
    else:
        one, two = (f"{shared} {d}".strip() if shared else d for d in (da, db))
        token_set = max([200 * (len(shared) + bool(shared) + lcs(da, db)) / (len(one) + len(two)), *([ratio(shared, one), ratio(shared, two)] if shared else [])])
    return 0.25 * ratio(a, b) + 0.2 * partial(a, b) + 0.25 * ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))) + 0.3 * token_set


def share(x, y):
    return len(x & y) / len(x | y)


def scores(a, b):
    """All weighted scores of two records, or nothing if they are rejected."""
    na, nb = a["normalized_name"], b["normalized_name"]
    if a["extension"] != b["extension"] and (a["extension_category"] != b["extension_category"]):
        return None
    extension = 100 if a["extension"] == b["extension"] else 50 if a["extension_category"] == "other" else 90
    for kind in ("episodes", "years", "numbers"):
        if a[kind] and b[kind]:
            numeric = 100.0 if set(a[kind]) == set(b[kind]) else None
            break
    else:
        some = [any(f[k] for k in ("episodes", "years", "numbers")) for f in (a, b)]
        numeric = 30.0 if some[0] != some[1] else 100.0
    if numeric is None:
        return None
    ta, tb = set(a["tokens"]), set(b["tokens"])
    token = (100.0 if na == nb else 0.0) if not ta and not tb else 0.0 if not ta or not tb else (share(ta, tb) + 2 * len(ta & tb) / (len(ta) + len(tb))) / 2 * 100
    grams = lambda s, n: {s[i : i + n] for i in range(max(1, len(s) - n + 1))}
    ngram = (100.0 if na == nb else 0.0) if not na or not nb else (share(grams(na, 2), grams(nb, 2)) + share(grams(na, 3), grams(nb, 3))) / 2 * 100
    ca, cb = (collections.Counter(c for c in n if c.isalnum()) for n in (na, nb))
    length = lambda c: math.sqrt(sum(v * v for v in c.values()))
    chars = 100.0 if not ca and not cb else 0.0 if not ca or not cb else sum(v * cb[k] for k, v in ca.items()) / (length(ca) * length(cb)) * 100
    off = 0 if a["size"] == b["size"] else abs(a["size"] - b["size"]) / max(a["size"], b["size"])
    size = 100.0 if off == 0 else next((s for most, s in ((0.02, 90.0), (0.05, 75.0), (0.1, 50.0), (0.25, 25.0)) if off <= most), 0.0)
    exact = 100.0 if na == nb and na else 95.0 if a["filename"].lower() == b["filename"].lower() else 0.0
    out = {"exact_match": exact, "token_similarity": round(token, 2), "fuzzy_similarity": round(fuzzy(na, nb), 2), "ngram_similarity": round(ngram, 2), "char_frequency": round(chars, 2), "size_similarity": size, "numeric_validation": numeric}
    weights = {"exact_match": 40, "token_similarity": 20, "fuzzy_similarity": 15, "ngram_similarity": 10, "char_frequency": 5, "size_similarity": 5, "numeric_validation": 5}
    total = sum(out[k] * w for k, w in weights.items()) / 100
    fa, fb = a["folder"], b["folder"]
    folder = 100 if a["parent_folder"] == b["parent_folder"] else 90 if fa == fb and fa else 50
    total = min(100.0, total + {100: 5, 90: 3}.get(folder, 0))
    return out, round(max(0.0, total - 2) if extension == 90 else total, 2)


def label(s):
    return next(n for least, n in ((95, "almost certain duplicate"), (80, "highly likely"), (60, "potential duplicate"), (40, "weak similarity")) if s >= least)


def similar_files(spark):
    """Names that are near each other in many ways, in few folders."""
    rnd = random.Random(3)
    stems = ["the red house", "red house", "house of red", "Red_House.2001", "red.house.2001", "blue sea s01e02", "Blue-Sea.S1E2", "sea blue s01e03", "holiday 17", "holiday 18", "Holiday (copy)", "x", "ünïted", "a b c d e f", "f e d c b a"]
    rows = [(f"/{rnd.choice(['a', 'b', 'Red House'])}/{i}/{rnd.choice(stems)}{rnd.choice(['', ' final', ' v2', '.x'])}{rnd.choice(['.mkv', '.mp4', '.jpg', '.zzz', '.yyy', ''])}", rnd.choice([100, 101, 104, 109, 120, 500]), 0.0) for i in range(90)]
    return features(records(spark.createDataFrame(rows, "path string, size long, mtime double"), Config().normalization))


@pytest.mark.parametrize("which", ["parts", "near"])
def test_default_weights_equal_plain_python(spark, which):
    if which == "parts" and not os.path.isdir(SF):
        pytest.skip("the test data isn't here")
    files = part_records(spark, SF) if which == "parts" else similar_files(spark)
    pairs = [(r.path_a, r.path_b) for r in blocking.candidate_pairs(files, OPTIONS).collect()]
    by = {r.path: r.asDict() for r in files.collect()}
    want = {p: found for p in pairs if (found := scores(by[p[0]], by[p[1]]))}
    near = {p: f for p, f in want.items() if f[1] >= 40}
    assert len(near) > (5 if which == "parts" else 100)
    found = {(r.path_a, r.path_b): r for r in scoring.match_files(files, Config().merged({"blocking": OPTIONS.__dict__})).collect()}
    assert all(abs(want[p][1] - 40) < 0.011 for p in set(found) ^ set(near))
    for p, r in found.items():
        assert set(r.scores) == set(want[p][0])
        assert r.confidence_score == pytest.approx(want[p][1], abs=0.0101), p
        assert all(r.scores[k] == pytest.approx(v, abs=0.0101) for k, v in want[p][0].items()), (p, r.scores, want[p][0])
        if abs(r.confidence_score - round(r.confidence_score)) > 0.02:
            assert r.category == label(want[p][1])
    # A threshold only leaves out what is below it.
    some = {(r.path_a, r.path_b) for r in scoring.match_files(files, Config().merged({"blocking": OPTIONS.__dict__}), 70.0).collect()}
    assert some == {p for p, r in found.items() if r.confidence_score >= 70}


def test_semantic_scores(spark):
    rows = [("/a/x one.mkv", 1, 0.0, [1.0, 0.0]), ("/b/x two.mkv", 1, 0.0, [0.6, 0.8]), ("/c/x three.mkv", 1, 0.0, None), ("/d/x zero.mkv", 1, 0.0, [0.0, 0.0])]
    files = spark.createDataFrame(rows, "path string, size long, mtime double, vector array<double>")
    whole = features(records(files, Config().normalization)).join(files.select("path", "vector"), "path")
    pairs = scoring.attach(spark.createDataFrame([(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :]], "path_a string, path_b string"), whole)
    got = {(r.a_path[1], r.b_path[1]): r.s for r in pairs.select("a_path", "b_path", matchers.semantic().alias("s")).collect()}
    assert got == {("a", "b"): 60.0, ("a", "c"): 0.0, ("a", "d"): 0.0, ("b", "c"): 0.0, ("b", "d"): 0.0, ("c", "d"): 0.0}
    config = Config(algorithms=Algorithms(semantic_similarity=True)).merged({"thresholds": {"weak": 0.0}})
    shown = {len(r.scores) for r in scoring.score_pairs(pairs, config).collect()}
    assert shown == {8}


def test_index_of_vectors(spark):
    rnd = random.Random(4)
    centres = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(25)]
    rows = [(i, [c + rnd.gauss(0, 0.4) for c in rnd.choice(centres)]) for i in range(1500)] + [(2000 + i, centres[0]) for i in range(700)] + [(9000, None), (9001, [0.0] * 16)]
    table = spark.createDataFrame(rows, "id long, vector array<float>")
    queries = table.where("id % 50 = 0 and vector is not null")
    exact = vectors.nearest(table.where("vector is not null"), queries, 10)
    index = vectors.build_index(table)
    assert index.rows.count() == 2201 and len(index.centroids) == 47
    assert vectors.recall(vectors.search(index, queries, 10, probes=8), exact) >= 0.9
    every = {tuple(r) for r in vectors.search(index, queries, 10, probes=len(index.centroids)).collect()}
    assert every == {tuple(r) for r in exact.collect()}
    assert vectors.search(vectors.build_index(table.limit(0)), queries, 3).count() == 0


def test_patterns_that_only_one_engine_knows(spark):
    row = spark.createDataFrame([("ax by",)], "n string")
    text = row.select(names.strip_patterns(F.col("n"), ("(?P<x>a)", "(", "B")).alias("n")).first().n
    assert text == "ax  y" and names.compiles("(?<x>a)") and not names.compiles("(?P<x>a)")


def test_json_array(spark, tmp_path):
    rows = [(f"/{i}", f'"é\n{i}', i, i / 4, {"s": float(i)} if i % 3 else None) for i in range(300)]
    frame = spark.createDataFrame(rows, "path_a string, path_b string, size long, score double, scores map<string,double>").orderBy("size")
    target = tmp_path / "out" / "matches.json"
    json_array.write(frame.repartitionByRange(5, "size").sortWithinPartitions("size"), f"file://{target}")
    got = json.loads(target.read_text())
    assert [tuple(r.values()) for r in got] == rows and list(got[0]) == ["path_a", "path_b", "size", "score", "scores"]
    assert [p.name for p in target.parent.iterdir()] == ["matches.json"]
    with pytest.raises(Exception, match="FileExists"):
        json_array.write(frame, str(target), overwrite=False)
    assert json.loads(target.read_text()) == got and len(list(target.parent.iterdir())) == 1
    json_array.write(frame.limit(0), str(target))
    assert json.loads(target.read_text()) == []


def test_nearest_in_blocks_equals_scores_pair_by_pair(spark):
    """Copies, opposite, empty, short and missing vectors, and entries that are null."""
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)] + [(60 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(15)]
    rows += [(80, [0.0] * 5), (81, None), (82, [1.0, 2.0]), (83, [1.0, None, 3.0, 4.0, 5.0]), (84, [-1.0, -2.0, -3.0, -4.0, -5.0]), (85, [])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    q = df.where("id % 10 < 6")
    pairs = q.select(F.col("id").alias("query_id"), F.col("vector").alias("w")).join(df, F.col("query_id") != F.col("id"))
    scored = pairs.select("query_id", "id", matchers.cosine_score(F.col("w"), F.col("vector")).alias("score"))
    want = sorted(map(tuple, vectors._ranked(scored, 4).collect()))
    plan = vectors.nearest(df, q, 4)
    assert "FlatMapCoGroups" in plan._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, plan.collect())) == want


def test_groups_of_alike_names_give_what_pairs_give(spark):
    """Matches of grouped pairs are those of attached pairs, to the last digit, with and without vectors."""
    files = similar_files(spark).withColumn("vector", F.when(F.col("size") > 101, F.array(F.col("size").cast("double"), F.lit(100.0))))
    for config in (Config(), Config(algorithms=Algorithms(semantic_similarity=True, folder_context=False))):
        plain = scoring.score_pairs(blocking.attached_pairs(files, OPTIONS, files.columns), config)
        rows = lambda df: sorted(map(tuple, df.withColumn("scores", F.to_json("scores")).collect()))
        want = rows(plain)
        assert len(want) > 100 and rows(scoring.matches_of(files, config)) == want


def test_copies_of_a_name_meet_as_one(spark):
    """Sixty files of three names are three groups; a name beyond the limit gives none."""
    paths = [f"/{i}/red house {2001 + i % 3}.mkv" for i in range(60)] + [f"/x{i}/y.jpg" for i in range(40)]
    raw = spark.createDataFrame([(p, i, 0.0) for i, p in enumerate(paths)], "path string, size long, mtime double")
    files = named_features(raw, Config().normalization)
    assert sorted(map(str, files.collect())) == sorted(map(str, features(records(raw, Config().normalization)).collect()))
    o = OPTIONS.__class__(max_block_size=30)
    assert blocking.groups_of(files, o, ("bigrams",)).count() == 3
    met = blocking.grouped_pairs(files, o, ("bigrams", "size"))
    assert met.count() == 3 and set(met.schema["a_files"].dataType.elementType.names) == {"path", "size"}
    found = {(r.path_a, r.path_b, r.a_size, r.b_size) for r in blocking.expanded(met).collect()}
    assert found == {(a, b, paths.index(a), paths.index(b)) for a in paths[:60] for b in paths[:60] if a < b and a[-8:] == b[-8:]}


def test_json_array_is_read_in_splits(spark, tmp_path):
    """Texts that look like the end of a row, nested and empty values; many splits; no rows."""
    rows = [(f"/{i}\n}},\n", '}\n]\n' if i % 2 else "é", i, {"s": float(i)} if i % 3 else {}) for i in range(400)]
    schema = "path_a string, path_b string, size long, scores map<string,double>"
    target = str(tmp_path / "m.json")
    json_array.write(spark.createDataFrame(rows, schema).repartition(4), target)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        back = json_array.read(spark, target, schema)
        assert back.rdd.getNumPartitions() > 20 and sorted(map(tuple, back.collect()), key=lambda r: r[2]) == rows
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    json_array.write(spark.createDataFrame(rows[:1], schema), target)
    assert [tuple(r) for r in json_array.read(spark, target, schema).collect()] == rows[:1]
    json_array.write(spark.createDataFrame([], schema), target)
    assert json_array.read(spark, target, schema).count() == 0


def test_json_array_in_gzip(spark, tmp_path):
    """One gzip file whose text is the plain one's, read back by several tasks from many members, some of them of one task's rows."""
    rows = [(f"/{i}\n}},\n", None if i % 5 == 0 else '}\n]\n"é' + "x" * 200_000 * (i < 200), i, -0.0 if i % 2 else 0.0, ["[", None] * (i % 3), {"s,]": -0.0 if i % 2 else 0.0, "t": None} if i % 3 else None) for i in range(400)]
    schema = 'path_a string, `b%s"` string, size long, score double, list array<string>, scores map<string,double>'
    frame = spark.createDataFrame(rows, schema).repartitionByRange(8, "size").sortWithinPartitions("size")
    packed, plain = tmp_path / "m.json.gz", tmp_path / "m.json"
    json_array.write(frame, str(plain))
    json_array.write(frame, str(packed), compression="gzip")
    whole = gzip.decompress(packed.read_bytes()).decode()
    assert whole == plain.read_text() and [tuple(r.values()) for r in json.loads(whole)] == rows
    assert packed.stat().st_size * 20 < plain.stat().st_size
    assert len(list(json_array._members(str(packed)))) > 17  # eight parts and what is around them
    back = json_array.read(spark, str(packed), schema, "gzip")
    assert back.rdd.getNumPartitions() > 1 and sorted(map(tuple, back.collect()), key=lambda r: r[2]) == rows
    json_array.write(frame.limit(0), str(packed), compression="gzip")
    assert json.loads(gzip.decompress(packed.read_bytes())) == [] and json_array.read(spark, str(packed), schema, "gzip").count() == 0
    packed.write_bytes(gzip.compress(b"[\n\n]\n"))
    with pytest.raises(Exception, match="packed by members"):
        json_array.read(spark, str(packed), schema, "gzip").count()
    with pytest.raises(Exception, match="unknown compression"):
        json_array.write(frame, str(packed), compression="xz")


def test_json_texts_are_those_of_dumps():
    """Nulls, signed zeros, numbers that aren't finite, times, nested values, and a slice, whose maps begin later."""
    day = datetime.date(2020, 1, 2)
    rows = [{"a": f'"é\n{i}' if i % 4 else None, "b": i if i % 3 else None, "c": (-0.0, 0.0, math.inf, 1e300)[i % 4], "d": day, "e": [i, None], "f": {"x": "y\n", "z": None}, "g": [("k", -0.0 if i % 2 else 0.0), ("l", None)] if i % 3 else None, "h": i % 2 == 0, "i": i} for i in range(40)]
    kinds = pa.schema({"a": pa.string(), "b": pa.int64(), "c": pa.float64(), "d": pa.date32(), "e": pa.list_(pa.int64()), "f": pa.struct({"x": pa.string(), "z": pa.string()}), "g": pa.map_(pa.string(), pa.float64()), "h": pa.bool_(), "i": pa.int32()}.items())
    batch = pa.RecordBatch.from_pylist(rows, kinds)
    for b, some in ((batch, rows), (batch.slice(7, 20), rows[7:27])):
        whole = [r | {"g": dict(r["g"]) if r["g"] else None} for r in some]
        want = [tuple(json.dumps(v, ensure_ascii=False, indent=2, default=str).replace("\n", "\n  ") for v in r.values()) for r in whole]
        assert list(zip(*map(json_array._texts, b.columns), strict=True)) == want


def test_exported_array_is_compressed(spark):
    """The query's file is gzip, whose text is the array."""
    from simigraph import store
    from simigraph.plans.all import QUERIES

    QUERIES["k02_export_json"](spark, SF)
    folder = Path(store.shared_dir(spark).removeprefix("file:")) / "simigraph"
    last = max(folder.glob("json-*"), key=lambda p: p.stat().st_mtime)
    text = gzip.decompress(last.read_bytes())
    assert json.loads(text)  # of few rows here


def test_semantic_matches_are_not_sorted(spark):
    from simigraph.plans.all import QUERIES

    plan = QUERIES["m11_semantic"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "confidence_score" in plan and "Sort [" not in plan


def test_blocks_keep_their_tasks(spark):
    """Few bytes may be many pairs, so adaptive execution doesn't join the tasks in which groups meet."""
    paths = [f"/{i}/{w} house {2001 + i % 3}.mkv" for i in range(4) for w in ("red", "blue", "green", "white", "black", "brown")]
    files = features(records(spark.createDataFrame([(p, 1, 0.0) for p in paths], "path string, size long, mtime double"), Config().normalization))
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = blocking.grouped_pairs(files, OPTIONS)
        assert met.count() > 0 and met.rdd.getNumPartitions() == 7
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
