import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from simigraph.config import Blocking, Config, Scan
from simigraph.functions.digests import average_hash, frame_match_percent, frames_of, visual_signature
from simigraph.operators import blocking, exact, groups, incremental, survivors, visual
from simigraph.sources import caches, catalog, sinks


def files(spark, contents):
    rows = [(p, len(c), 0.0, bytearray(c)) for p, c in contents.items()]
    return spark.createDataFrame(rows, "path string, size long, mtime double, content binary")


def test_exact_groups_equal_direct_hashing(spark):
    rnd = random.Random(3)
    data = {f"/f{i}": bytes(rnd.choice(b"ab") for _ in range(rnd.choice([0, 0, 3, 9]))) for i in range(200)}
    f = files(spark, data)
    assert {r.path for r in exact.exact_groups(f, 4).collect()} == {r.path for r in exact.hash_groups(f).collect()}
    by = {}
    for p, c in data.items():
        by.setdefault(hashlib.sha256(c).hexdigest(), []).append(p)
    assert {r.path for r in exact.hash_groups(f).collect()} == {p for g in by.values() if len(g) > 1 for p in g}


def test_empty_files_match(spark):
    assert exact.exact_groups(files(spark, {"/a": b"", "/b": b"", "/c": b""})).count() == 3


def test_star_pairs_and_waste(spark):
    g = exact.exact_groups(files(spark, {"/a": b"xy", "/b": b"xy", "/c": b"xy", "/d": b"zz"}))
    assert {(r.path_a, r.path_b) for r in exact.star_pairs(g).collect()} == {("/a", "/b"), ("/a", "/c")}
    assert exact.wasted_in_groups(g).first().wasted_bytes == 4


@pytest.mark.parametrize("strategy", survivors.STRATEGIES)
def test_one_survivor_a_group(spark, strategy):
    rnd = random.Random(5)
    rows = [(i % 7, f"/{i}", rnd.randint(1, 3), float(rnd.randint(1, 3))) for i in range(60)]
    f = spark.createDataFrame(rows, "group_id int, path string, size long, mtime double")
    kept = {r.group_id: r.path for r in survivors.mark(f, strategy).where("not selected").collect()}
    first = {r.group_id: r.path for r in survivors.ranked(f, strategy).where("place = 1").collect()}
    assert kept == first and len(kept) == 7


def test_components(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("x", "x")], "path_a string, path_b string")
    assert {(r.node, r.component) for r in groups.components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")}
    assert groups.components(e.limit(0)).count() == 0


def test_components_of_a_chain_and_random_edges(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(1000 + rnd.randint(0, 80), 1000 + rnd.randint(0, 80)) for _ in range(50)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    found = {r.node: r.component for r in groups.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {x: root(x) for x in list(parent)}


def frame(spark, pixels):
    return spark.createDataFrame([(pixels,)], "p array<int>").select(average_hash(F.col("p")).alias("h")).first().h


def test_average_hash(spark):
    assert frame(spark, [1, 0] * 32) == -6148914691236517206
    assert frame(spark, [7] * 64) == -1
    raw = bytearray([1, 0] * 32 + [7] * 64 + [9])
    out = spark.createDataFrame([(raw,)], "r binary").select(F.transform(frames_of(F.col("r")), average_hash).alias("h")).first().h
    assert out == [-6148914691236517206, -1]


def test_frame_percent_is_asymmetric(spark):
    r = spark.createDataFrame([([5, 5, 5], [5])], "a array<long>, b array<long>")
    assert r.select(frame_match_percent(F.col("a"), F.col("b"))).first()[0] == 300
    assert r.select(frame_match_percent(F.col("b"), F.col("a"))).first()[0] == 100


def test_visual_signature(spark):
    r = spark.createDataFrame([([1, 2, 3, 4],), ([1, 2],), ([],)], "h array<long>")
    assert [x.s for x in r.select(visual_signature(F.col("h")).alias("s")).collect()] == [[1, 3, 4], [1, 2], None]


def test_near_hashes_equal_all_pairs(spark):
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(20)]
    values = [b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 8))) & (1 << 64) - 1 for b in base for _ in range(6)]
    signed = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)]
    got = {(r.id_a, r.id_b) for r in visual.near_hashes(spark.createDataFrame(signed, "id long, hash long"), 10).collect()}
    assert got == {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= 10}


def test_duration_groups(spark):
    f = spark.createDataFrame([("1", 0.0), ("2", 4.0), ("3", 8.0), ("4", None)], "path string, duration double")
    assert {r.path for r in visual.duration_groups(f).collect()} == {"1", "2"}
    rnd = random.Random(4)
    rows = [(f"{i:03}", float(rnd.randint(0, 120))) for i in range(80)]
    leaders, of = [], {}
    for p, d in rows:
        lead = next((x for x in leaders if abs(d - x) <= 5), None)
        if lead is None:
            leaders.append(d)
            lead = d
        of[p] = lead
    big = {p: x for p, x in of.items() if list(of.values()).count(x) > 1}
    assert {r.path: r.leader for r in visual.duration_groups(spark.createDataFrame(rows, "path string, duration double")).collect()} == big


def test_block_guard_counts_repeated_tokens(spark):
    rows = [(f"/{i}", "red", ["red", "red"], "s", "other", 0) for i in range(3)]
    f = spark.createDataFrame(rows, "path string, normalized_name string, tokens array<string>, token_signature string, extension_category string, length_bucket int")
    assert blocking.candidate_pairs(f, Blocking(max_block_size=5), ["token"]).count() == 0
    assert blocking.candidate_pairs(f, Blocking(max_block_size=6), ["token"]).count() == 3


def _named(spark, names):
    from simigraph.sources.catalog import features, records

    rows = [(f"/{i % 3}/{i}/{n}", i, 0.0) for i, n in enumerate(names)]
    return features(records(spark.createDataFrame(rows, "path string, size long, mtime double"), Config().normalization))


def test_pairs_come_out_of_the_blocks_unshuffled(spark):
    f = _named(spark, [f"film {i % 7} part{i % 5}.mkv" for i in range(40)])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (blocking.candidate_pairs(f, Blocking()), blocking.attached_pairs(f, Blocking(), f.columns)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan[: plan.index("Join")]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("most", [3, 9, 500])
def test_pairs_and_pairs_of_names_equal_plain_loops(spark, most):
    o, words = Blocking(max_block_size=most), ["large", "ring", "bolt", "s01e02", "blue"]
    f = _named(spark, [f"{words[i % 5]}.{words[i * i % 4]}.{1990 + i % 3}.{('mkv', 'jpg', 'txt')[i % 3]}" for i in range(30)])
    members, entries = {}, {}
    for r in blocking.block_keys(f, o).collect():
        members.setdefault((r.kind, r.key), set()).add(r.path)
        entries[r.kind, r.key] = entries.get((r.kind, r.key), 0) + 1
    want = sorted({(a, b) for k, m in members.items() if 2 <= entries[k] <= most for a in m for b in m if a < b})
    assert sorted(map(tuple, blocking.candidate_pairs(f, o).collect())) == want
    name = {r.path: r.normalized_name for r in f.collect()}
    assert sorted(map(tuple, blocking.name_pairs(f, o).collect())) == sorted({(name[a], name[b]) for a, b in want})


def test_forest_keeps_components_and_few_edges(spark):
    edges = spark.createDataFrame([(f"{c}{i:02}", f"{c}{j:02}") for c in "ab" for i in range(20) for j in range(i)], "path_a string, path_b string").coalesce(1)
    kept = groups.forest(edges)
    assert kept.count() == 38
    assert sorted(map(tuple, groups.components(kept).collect())) == sorted(map(tuple, groups.components(edges).collect()))


def test_scan_excludes_folders_below_the_root(spark, tmp_path):
    for p in ("a.txt", "sub/b.TXT", "node_modules/c.txt", "sub/d.mkv"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x")
    listed = catalog.list_files(spark, [str(tmp_path)])
    kept = catalog.scan(listed, Scan((".txt",), ("Node_Modules",)), str(tmp_path))
    assert {r.path.rpartition("/")[2] for r in kept.collect()} == {"a.txt", "b.TXT"}
    assert catalog.list_files(spark, [str(tmp_path)], recurse=False, extensions=[".TXT"]).count() == 1


def test_refresh_reuses_and_purges(spark):
    old = spark.createDataFrame([("a", 1.0, 5), ("b", 1.0, 5), ("gone", 1.0, 5)], "path string, mtime double, size long")
    now = spark.createDataFrame([("a", 1.005, 5), ("b", 2.0, 5), ("c", 1.0, 1)], "path string, mtime double, size long")
    out = {r.path: r.mtime for r in incremental.refresh(now, old, lambda d: d).collect()}
    assert out == {"a": 1.0, "b": 2.0, "c": 1.0}
    assert [r.path for r in incremental.stale(old, now).collect()] == ["gone"]


def test_fingerprint_cache_with_old_hashes_is_empty(spark, tmp_path):
    good, old, broken = tmp_path / "g.json", tmp_path / "o.json", tmp_path / "b.json"
    good.write_text(json.dumps([{"path": "/a", "mtime": "1.5", "hashes": [1, 2**64 - 1]}]))
    old.write_text(json.dumps([{"path": "/a", "mtime": "1.5", "hashes": ["ffx"]}]))
    broken.write_text("[{")
    assert caches.read_fingerprints(spark, str(good)).first().hashes == [1, -1]
    assert caches.read_fingerprints(spark, str(old)).count() == 0
    assert caches.read_fingerprints(spark, str(broken)).count() == 0


def test_catalog_and_matches_round_trip(spark, tmp_path):
    c = spark.createDataFrame([("/a", ["x", "y"])], "path string, tokens array<string>")
    caches.write_catalog(c, str(tmp_path / "c"))
    assert caches.read_catalog(spark, str(tmp_path / "c")).first().tokens == ["x", "y"]
    caches.clear(spark, str(tmp_path / "c"))
    assert caches.read_catalog(spark, str(tmp_path / "c")).count() == 0
    m = spark.createDataFrame([("/a", "/b", 1, 2, 90.0, "x", {"s": 1.0})], "path_a string, path_b string, file_a_size long, file_b_size long, confidence_score double, category string, scores map<string,double>")
    caches.write_matches(m, str(tmp_path / "m"))
    assert caches.read_matches(spark, str(tmp_path / "m")).first().scores == {"s": 1.0}
    sinks.write_csv(m, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()
    assert json.loads(back.scores) == {"s": 1.0} and tuple(back.asDict()) == sinks.MATCH_COLUMNS
    sinks.write_json(m, str(tmp_path / "json"))
    assert [m["scores"] for m in json.loads((tmp_path / "json").read_text())] == [{"s": 1.0}]
    sinks.write_json_lines(m, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 1
    sinks.write_columns(m, str(tmp_path / "parquet"))
    assert "scores_json" in spark.read.parquet(str(tmp_path / "parquet")).columns


def test_action_plan_marks_collisions(spark):
    s = spark.createDataFrame([("/x/a",), ("/y/a",), ("/y/b",), ("/y/b",)], "path string")
    plan = {r.path: r.collides for r in sinks.action_plan(s, "move", "/bak").collect()}
    assert plan == {"/x/a": True, "/y/a": True, "/y/b": False}
    with pytest.raises(ValueError):
        sinks.action_plan(s, "burn")


def test_protocol(spark):
    lines = spark.createDataFrame([("noise",), ("[3/10] x",), ("MATCH_GROUP_2:/a,/b",)], "value string")
    assert [(r.group_no, r.pos, r.path) for r in caches.parse_protocol(lines).orderBy("pos").collect()] == [(2, 0, "/a"), (2, 1, "/b")]
    assert caches.parse_progress(lines).first()[:] == (3, 10)


def test_csv_can_be_compressed(spark, tmp_path):
    m = spark.createDataFrame([("/a", "/b", 1, 2, 90.0, "x", {"s": 1.0})], "path_a string, path_b string, file_a_size long, file_b_size long, confidence_score double, category string, scores map<string,double>")
    sinks.write_csv(m, str(tmp_path / "csv"), "gzip")
    assert all(p.name.endswith(".csv.gz") for p in (tmp_path / "csv").glob("part-*"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()
    assert back.path_a == "/a" and json.loads(back.scores) == {"s": 1.0}
