"""Video mode against plain loops in the order of a sequential scan."""

import bisect
import random

import pytest

from pyspark.sql import functions as F

from simigraph.operators import visual

DURATIONS, PRINTS = "path string, duration double", "video string, hashes array<long>"


def leaders_by_force(rows, tolerance=5.0):
    """Groups of paths in the order in which they are begun."""
    found = []
    for path, d in sorted(rows):
        if d is None:
            continue
        for lead, members in found:
            if abs(lead - d) <= tolerance:
                members.append(path)
                break
        else:
            found.append((d, [path]))
    return found


def near(s, t):
    return ((s ^ t) & (1 << 64) - 1).bit_count() <= 10


def groups_by_force(durations, prints, threshold=70.0, quick=True):
    order = [p for _, members in leaders_by_force(durations) if len(members) > 1 for p in members if prints.get(p)]
    sig = lambda h: tuple(h) if len(h) < 3 else (h[0], h[len(h) // 2], h[-1])
    group = {p: {p} for p in order}
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            x, y = prints[a], prints[b]
            same = sum(any(near(s, t) for t in y) for s in x)
            if quick and sig(x) == sig(y) or same / min(len(x), len(y)) * 100 >= threshold:
                both = group[a] | group[b]
                for p in both:
                    group[p] = both
    return {p: min(g) for p, g in group.items() if len(g) > 1}


def run(spark, durations, prints, **options):
    out = visual.video_groups(spark.createDataFrame(durations, DURATIONS), spark.createDataFrame(list(prints.items()), PRINTS), **options)
    return {r.path: r.group for r in out.collect()}


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def shots(rnd, n, frames, black=0.3):
    """Videos of which some share shots, with changed bits, and many have black frames."""
    scenes = [[rnd.getrandbits(64) for _ in range(12)] for _ in range(n // 5 + 1)]
    out = {}
    for i in range(n):
        scene = rnd.choice(scenes)
        some = [h ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 6))) for h in rnd.sample(scene, rnd.randint(1, frames))]
        out[f"v{i:03}"] = [signed(0 if rnd.random() < black else h) for h in some]
    return out


def test_pairs_across_duration_groups(spark):
    durations = [("a", 0.0), ("b", 4.0), ("c", 8.0), ("d", 8.5), ("e", 40.0), ("f", None)]
    prints = {p: [1, 2, 3, 1 << 40] for p in "bcef"} | {"a": [-1, -2, -3], "d": [0x5A5A5A5A5A5A5A5A, 0x3C3C3C3C3C3C3C3C, 0x0F0F0F0F0F0F0F0F]}
    assert run(spark, durations, prints) == {"b": "b", "c": "b"}
    assert set(run(spark, durations, prints, by_duration=False)) == set("bcef")


@pytest.mark.parametrize("seed", [1, 2])
def test_video_groups_equal_plain_loops(spark, seed):
    rnd = random.Random(seed)
    prints = shots(rnd, 60, 8, 0.04)
    prints |= {f"w{i}": prints["v000"] for i in range(5)} | {"x": [], "y": [0] * 9, "z": [0]}
    durations = [(p, rnd.choice([None, float(rnd.randint(0, 60))])) for p in prints]
    want = groups_by_force(durations, prints)
    assert len(set(want.values())) > 1
    assert run(spark, durations, prints) == want
    assert run(spark, durations, prints, quick=False, threshold=55.0) == groups_by_force(durations, prints, 55.0, False)


def test_the_earlier_video_is_asked(spark):
    """Ten frames of which seven are black have 70 % of ten with one black frame, but not the other way round."""
    rnd = random.Random(3)
    few = [0] + [signed(rnd.getrandbits(64)) for _ in range(9)]
    many = [0] * 7 + [signed(rnd.getrandbits(64)) for _ in range(3)]
    durations = [("a", 1.0), ("b", 2.0)]
    assert run(spark, durations, {"a": many, "b": few}) == {"a": "a", "b": "a"}
    assert run(spark, durations, {"a": few, "b": many}) == {}


def test_pairs_reach_the_threshold(spark):
    rnd = random.Random(5)
    prints = shots(rnd, 50, 9, 0.5)
    got = {(r.video_a, r.video_b): r.percent for r in visual.match_videos(spark.createDataFrame(list(prints.items()), PRINTS), quick=False).collect()}
    names = sorted(prints)
    percent = {(a, b): sum(any(near(s, t) for t in prints[b]) for s in prints[a]) / min(len(prints[a]), len(prints[b])) * 100 for i, a in enumerate(names) for b in names[i + 1 :]}
    assert got == {k: pytest.approx(v) for k, v in percent.items() if v >= 70}


def test_a_frame_of_all_videos_joins_nothing(spark):
    rnd = random.Random(6)
    prints = [(f"{i:05}", [0] + [signed(rnd.getrandbits(64)) for _ in range(9)]) for i in range(2000)]
    frames = spark.createDataFrame(prints, PRINTS).selectExpr("video", "hashes", "video lo", "video hi")
    assert visual.candidates(frames).count() == 0


def test_leaders_of_one_long_chain(spark):
    rnd = random.Random(7)
    durations = rnd.sample(range(100_000), 100_000)
    rows = [(f"{k:06}", d / 100) for k, d in enumerate(durations)]
    found, since, want = [], {}, {}
    for path, d in rows:
        at = bisect.bisect_left(found, d)
        near = [x for x in found[max(0, at - 2) : at + 2] if abs(x - d) <= 5]
        if not near:
            found.insert(at, d)
            since[d] = path
        want[d] = min(near, key=since.__getitem__, default=d)
    got = visual.leaders(spark.createDataFrame(rows, DURATIONS).selectExpr("duration", "path first"))
    plan = got._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "Window" not in plan
    assert {r.duration: (r.leader, r.lead_first) for r in got.collect()} == {d: (x, since[x]) for d, x in want.items()}


def test_leaders_in_the_order_of_durations(spark):
    rows = [(f"{i:03}", float(i)) for i in range(30)] + [("x", float("nan")), ("y", float("inf")), ("z", None), ("zz", 29.0)]
    got = {r.path: r.leader for r in visual.duration_groups(spark.createDataFrame(rows, DURATIONS)).collect()}
    assert got == {p: lead for lead, members in leaders_by_force(rows[:30] + rows[33:]) for p in members if len(members) > 1}
    same = visual.duration_groups(spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.5)], DURATIONS), 0.0)
    assert {r.path for r in same.collect()} == {"a", "b"}
    with pytest.raises(ValueError, match="negative"):
        visual.duration_groups(spark.createDataFrame(rows, DURATIONS), -1.0)


def test_raw_frames_of_a_small_file_are_made_by_many_tasks(spark, tmp_path):
    from simigraph.plans.visual import s12

    rows = [(i, f"part {i}", "TYPE", "Brand") for i in range(200)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    found = s12(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() > 1
    assert found.count() == 400


def test_keys_of_bands_are_never_broadcast(spark, tmp_path):
    """A small file of few rows, as planners see it, makes 68 keys a frame."""
    spark.createDataFrame([(v, [v * 977 + f for f in range(20)], v, v) for v in range(8)], "video long, hashes array<long>, lo long, hi long").write.parquet(str(tmp_path / "p"))
    prints = spark.read.parquet(str(tmp_path / "p"))
    for df in (visual.candidates(prints), visual.near_hashes(prints.select(F.col("video").alias("id"), F.col("hashes")[0].alias("hash")))):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_long_videos_equal_plain_loops(spark, monkeypatch):
    """Few long videos are compared pair by pair, in pieces and without keys of bands; short ones beside them too."""
    rnd = random.Random(8)
    scene = [rnd.getrandbits(64) for _ in range(40)]
    changed = lambda h: signed(h ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))))
    long_ = {f"v{i}": [changed(rnd.choice(scene) if rnd.random() < share else rnd.getrandbits(64)) for _ in range(150 + 40 * i)] for i, share in enumerate((1.0, 0.95, 0.9, 0.8, 0.5, 0.0))}
    long_["v6"] = [signed(h) for h in scene[:3]] * 50  # frames that repeat
    short = {f"s{i}": [changed(h) for h in rnd.sample(scene, 10)] for i in range(4)} | {"s9": [signed(rnd.getrandbits(64)) for _ in range(5)]}
    monkeypatch.setattr(visual, "PIECE", 60)
    for prints in (long_, long_ | short):
        frames = spark.createDataFrame(list(prints.items()), PRINTS)
        got = {(r.video_a, r.video_b): r.percent for r in visual.match_videos(frames, quick=False).collect()}
        names = sorted(prints)
        percent = {(a, b): sum(any(near(s, t) for t in prints[b]) for s in prints[a]) / min(len(prints[a]), len(prints[b])) * 100 for i, a in enumerate(names) for b in names[i + 1 :]}
        assert got == {k: pytest.approx(v) for k, v in percent.items() if v >= 70} and len(got) > 2
        durations = [(p, float(rnd.randint(0, 12))) for p in prints]
        assert run(spark, durations, prints) == groups_by_force(durations, prints)
    keyed = spark.createDataFrame(list(long_.items()), PRINTS).selectExpr("video", "hashes", "video lo", "video hi")
    plan = visual.compared(keyed)._jdf.queryExecution().optimizedPlan().toString()
    assert "bits" not in plan and "power" not in plan
    monkeypatch.setattr(visual, "FEW", 3)  # then by their keys
    assert sorted(visual.compared(keyed).select("video_a", "video_b").collect()) == sorted(visual.compared_pairs(keyed).select("video_a", "video_b").collect())


def test_keys_of_a_small_file_are_made_by_many_tasks(spark, tmp_path):
    spark.createDataFrame([(v, [v * 977 + f for f in range(20)], v, v) for v in range(8)], "video long, hashes array<long>, lo long, hi long").coalesce(1).write.parquet(str(tmp_path / "p"))
    plan = visual.candidates(spark.read.parquet(str(tmp_path / "p")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition 4, true") >= 2
