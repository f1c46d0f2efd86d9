"""Videos by the hashes of their frames."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simigraph import store
from simigraph.functions.digests import average_hash, frame_match_percent, hamming, visual_signature
from simigraph.operators import groups

BITS, BANDS = 64, 4
# Differing bits of near frames, per cent of near frames, seconds between durations.
DISTANCE, THRESHOLD, TOLERANCE = 10, 70.0, 5.0
#: Frames of a long video, as many long ones as are compared pair by pair, frames of the first that a task compares at once, and of the second.
LONG, FEW, PIECE, STEP = 128, 256, 4096, 256


def fingerprints(frames: DataFrame) -> DataFrame:
    """video and its frames' hashes in order."""
    hashed = frames.select("video", F.struct("frame", average_hash(F.col("pixels")).alias("hash")).alias("f"))
    return hashed.groupBy("video").agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["hash"]).alias("hashes"))


def _masks(most: int) -> list[int]:
    """A band's bits with up to so many changed, as what to change."""
    return [sum(1 << b for b in bits) for k in range(most + 1) for bits in itertools.combinations(range(BITS // BANDS), k)]


def near_hashes(hashes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """All pairs (id_a < id_b, bits) of (id, hash) within the distance, exactly.

    Hashes are cut into BANDS bands; two hashes within the distance differ by at
    most distance / BANDS bits in one of them. Each side is listed under its
    bands with up to half as many bits changed, so that those meet: 4 bands of
    16 bits and 17 keys each for distances up to 11. A key stands for one hash
    in 2^16 / 17, so the joins' buckets are that much smaller than the table.
    """
    width, each = BITS // BANDS, distance // BANDS
    band = lambda k: F.shiftrightunsigned("hash", width * k).bitwiseAND(F.lit((1 << width) - 1).cast("long"))

    def side(s: str, most: int) -> DataFrame:
        keys = F.array(*(F.struct(F.lit(k).alias("band"), band(k).alias("bits")) for k in range(BANDS)))
        rows = hashes.select(F.col("id").alias(f"id_{s}"), F.col("hash").alias(f"hash_{s}"), F.explode(keys).alias("k"))
        changed = F.explode(F.transform(F.array(*(F.lit(m).cast("long") for m in _masks(most))), lambda m: F.col("k.bits").bitwiseXOR(m)))
        return rows.select(f"id_{s}", f"hash_{s}", "k.band", changed.alias("bits"))

    bits = hamming(F.col("hash_a"), F.col("hash_b"))
    # A small table makes many keys, which planners don't see and would send through the driver.
    met = side("a", each - each // 2).join(side("b", each // 2).hint("merge"), ["band", "bits"]).where("id_a < id_b").where(bits <= distance)
    return met.select("id_a", "id_b", bits.cast("int").alias("bits")).distinct()


def signature_pairs(prints: DataFrame) -> DataFrame:
    """Pairs of videos with the same first, middle and last hash."""
    signed = prints.select("video", visual_signature(F.col("hashes")).alias("sig")).where("sig is not null")
    a, b = signed.withColumnRenamed("video", "video_a"), signed.withColumnRenamed("video", "video_b")
    return a.join(b, "sig").where("video_a < video_b").select("video_a", "video_b")


def frame_matches(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """video_a, video_b (in order) and the percentage of a's frames that b has.

    Only pairs of videos with some near frames come out; they are found by bands
    over the distinct hashes.
    """
    frames = prints.select("video", F.size("hashes").alias("n"), F.posexplode("hashes").alias("pos", "hash"))
    distinct = frames.select("hash").distinct()
    near = near_hashes(distinct.select(F.col("hash").alias("id"), "hash"), distance).select("id_a", "id_b")
    near = near.union(near.select("id_b", "id_a")).union(distinct.select("hash", "hash"))
    a, b = frames.select(F.col("video").alias("video_a"), "pos", F.col("hash").alias("id_a")), frames.select(F.col("video").alias("video_b"), F.col("hash").alias("id_b")).distinct()
    sides = a.join(near, "id_a").join(b, "id_b").where("video_a < video_b").select("video_a", "video_b", "pos").distinct()
    found = sides.groupBy("video_a", "video_b").agg(F.count("*").alias("matched"))
    sizes = prints.select("video", F.size("hashes").alias("n"))
    joined = found.join(sizes.select(F.col("video").alias("video_a"), F.col("n").alias("n_a")), "video_a").join(sizes.select(F.col("video").alias("video_b"), F.col("n").alias("n_b")), "video_b")
    return joined.select("video_a", "video_b", (F.col("matched") / F.least("n_a", "n_b") * 100).alias("percent"))


def candidates(prints: DataFrame, distance: int = DISTANCE, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (video_a, video_b) that may reach the threshold, from (video, hashes, lo, hi); a comes before b: lo of a is below hi of b.

    A pair needs ceil(threshold * the smaller number of frames) frames of a with a
    near one in b. So of a's n frames, in whatever order, one of the first
    n - need + 1 has one. The order is by how often the frame's bands occur: rare
    frames come first, and a frame that many videos have is looked up only for
    videos that are short enough to be matched by the frames from there on. Those
    find b by the band and by the size of its need in powers of two, so that
    frames of long videos never meet.
    """
    if threshold <= 0:
        raise ValueError("any two videos reach a threshold of nothing")
    share = threshold / 100
    need = lambda n: F.greatest(F.ceil(n * share - 1e-9), F.lit(1)).cast("int")
    width = BITS // BANDS
    band = lambda h, k: F.shiftrightunsigned(h, width * k).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    masks = F.array(*(F.lit(m).cast("long") for m in _masks(distance // BANDS - distance // BANDS // 2)))
    masks_b = F.array(*(F.lit(m).cast("long") for m in _masks(distance // BANDS // 2)))
    sized = prints.where(F.size("hashes") > 0).select("video", "lo", "hi", F.size("hashes").alias("n"), "hashes")
    sized = store.spread(sized)  # a small file of few rows makes many keys
    frames = sized.select("video", "lo", "n", F.posexplode("hashes").alias("pos", "hash"))
    bands = F.explode(F.array(*(F.struct(F.lit(k).alias("band"), band(F.col("hash"), k).alias("bits")) for k in range(BANDS))))
    # How many distinct hashes of videos have the band: what a lookup would meet.
    held = sized.select("video", F.explode(F.array_distinct("hashes")).alias("hash")).select(F.col("hash"), bands.alias("k")).groupBy("k").agg(F.count("*").alias("held"))
    distinct = sized.select(F.explode("hashes").alias("hash")).distinct()
    rarity = distinct.select("hash", bands.alias("k")).join(held, "k").groupBy("hash").agg(F.max("held").alias("held"))
    ranked = frames.join(rarity, "hash").groupBy("video", "lo", "n").agg(F.array_sort(F.collect_list(F.struct("held", "hash"))).alias("f"))
    each = ranked.select("video", "lo", "n", F.posexplode("f").alias("at", "f")).select("video", "lo", "n", (F.col("n") - F.col("at")).alias("room"), F.col("f.hash").alias("hash"))
    # Of equal frames of a video the first one has the most room.
    each = each.groupBy("video", "lo", "n", "hash").agg(F.max("room").alias("room"))
    each = store.spread(store.materialise(each, "frames"))
    power = lambda n: F.floor(F.log2(n.cast("double"))).cast("int")

    def keyed(df: DataFrame, flips: Column, *cols: str) -> DataFrame:
        rows = df.select(*cols, "hash", bands.alias("k"))
        return rows.select(*cols, "hash", "k.band", F.explode(F.transform(flips, lambda m: F.col("k.bits").bitwiseXOR(m))).alias("bits"))

    b = sized.select(F.col("video").alias("video_b"), "hi", F.col("n").alias("n_b"), F.explode(F.array_distinct("hashes")).alias("hash"))
    b = keyed(b, masks_b, "video_b", "hi", "n_b").withColumnRenamed("hash", "hash_b")
    everywhere = keyed(each.where(F.col("room") >= need(F.col("n"))).withColumnRenamed("video", "video_a"), masks, "video_a", "lo", "room", "n")
    short = keyed(each.where(F.col("room") < need(F.col("n"))).withColumnRenamed("video", "video_a"), masks, "video_a", "lo", "room", "n")
    short = short.select("*", F.explode(F.sequence(F.lit(0), power(F.col("room")))).alias("power"))
    # Frames of a video with one key go as one row, so a key joins videos and not their frames. Planners don't see how many
    # rows the keys make of a small table, so they are kept from sending it through the driver.
    b = b.groupBy("video_b", "hi", "n_b", "band", "bits").agg(F.collect_list("hash_b").alias("hashes_b"))
    asked = lambda df, *more: df.groupBy("video_a", "lo", "n", "band", "bits", *more).agg(F.collect_list(F.struct("room", "hash")).alias("frames"))
    other = (F.col("lo") < F.col("hi")) & (F.col("video_a") != F.col("video_b"))
    near = F.exists("frames", lambda x: (need(F.least("n", "n_b")) <= x["room"]) & F.exists("hashes_b", lambda y: hamming(x["hash"], y) <= distance))
    met = asked(everywhere).join(b.hint("merge"), ["band", "bits"]).where(other).where(near).select("video_a", "video_b")
    b_short = b.withColumn("power", power(need(F.col("n_b")))).hint("merge")
    met_short = asked(short, "power").join(b_short, ["band", "bits", "power"]).where(other).where(near).select("video_a", "video_b")
    return met.unionByName(met_short).distinct()


def near_frames(pairs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``matched`` in place of (hashes_a, times, hashes_b): how often those of a that have a near one in b occur."""
    kept = [c for c in pairs.columns if c not in ("hashes_a", "times", "hashes_b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matched = []
            for a, times, b in zip(*(batch.column(c) for c in ("hashes_a", "times", "hashes_b")), strict=True):
                a, times, b = (x.values.to_numpy() for x in (a, times, b))
                whole = times.sum()
                for k in range(0, len(b), STEP):
                    alone = ~(np.bitwise_count((a[:, None] ^ b[None, k : k + STEP]).view(np.uint64)) <= distance).any(axis=1)
                    a, times = a[alone], times[alone]
                matched.append(whole - times.sum())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(matched, pa.int64())], [*kept, "matched"])

    store.ship(pairs.sparkSession)
    return pairs.mapInArrow(run, pairs.select(*kept, F.lit(0).cast("long").alias("matched")).schema)


def compared_pairs(prints: DataFrame, distance: int = DISTANCE, threshold: float = THRESHOLD) -> DataFrame:
    """As ``compared``, every pair by its distinct frames, a piece of a's at a time: for few videos of many frames.

    Such pairs have some near frames anyway, and what the bands' keys would be is many times the frames.
    What is shuffled is both videos' frames for each pair of videos and piece.
    """
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = prints.select("video", "lo", "hi", F.size("hashes").alias("n"))
    a, b = sized.selectExpr("video video_a", "lo", "n n_a"), sized.selectExpr("video video_b", "hi", "n n_b")
    pairs = a.crossJoin(b).where((F.col("lo") < F.col("hi")) & (F.col("video_a") != F.col("video_b"))).drop("lo", "hi")
    each = prints.select("video", F.size("hashes").alias("n"), F.explode("hashes").alias("hash")).where("hash is not null")
    each = each.groupBy("video", "n", "hash").agg(F.count("*").alias("times"))
    piece = F.pmod(F.xxhash64("hash"), F.ceil(F.col("n") / PIECE)).alias("piece")
    listed = each.groupBy(F.col("video").alias("video_a"), piece).agg(F.collect_list(F.struct("hash", "times")).alias("f"))
    listed = listed.select("video_a", "f.hash", "f.times").withColumnRenamed("hash", "hashes_a")
    others = prints.select(F.col("video").alias("video_b"), F.array_distinct(F.filter("hashes", lambda h: h.isNotNull())).alias("hashes_b"))
    work = pairs.join(listed, "video_a").join(others, "video_b").select("video_a", "video_b", "n_a", "n_b", "hashes_a", "times", "hashes_b")
    found = near_frames(work.repartition(tasks), distance).groupBy("video_a", "video_b", "n_a", "n_b").agg(F.sum("matched").alias("matched"))
    percent = F.col("matched") / F.least("n_a", "n_b") * 100
    return found.select("video_a", "video_b", percent.alias("percent")).where(F.col("percent") >= threshold)


def compared(prints: DataFrame, distance: int = DISTANCE, threshold: float = THRESHOLD) -> DataFrame:
    """video_a, video_b and percent of the pairs of (video, hashes, lo, hi) that reach the threshold: candidates, then all frames of both.

    Where a few videos are long, each of their pairs is compared without being looked up.
    """
    is_long = F.size("hashes") >= LONG
    # One row of counts.
    n, long_ones = prints.agg(F.count("*"), F.count_if(is_long)).first()
    few = 1 < long_ones <= FEW
    if few and long_ones == n:
        return compared_pairs(prints, distance, threshold)
    found = candidates(prints, distance, threshold)
    side = lambda s: prints.select(F.col("video").alias(f"video_{s}"), F.col("hashes").alias(f"hashes_{s}"))
    both = found.join(side("a"), "video_a").join(side("b"), "video_b")
    if few:
        both = both.where((F.size("hashes_a") < LONG) | (F.size("hashes_b") < LONG))
    some = exact_percent(both, distance).where(F.col("percent") >= threshold).select("video_a", "video_b", "percent")
    return some.unionByName(compared_pairs(prints.where(is_long), distance, threshold)) if few else some


def match_videos(prints: DataFrame, distance: int = DISTANCE, threshold: float = THRESHOLD, quick: bool = True) -> DataFrame:
    """All pairs in the order of their names, with their percentage; equal signatures count as 100."""
    found = compared(prints.select("video", "hashes", F.col("video").alias("lo"), F.col("video").alias("hi")), distance, threshold)
    if not quick:
        return found
    same = signature_pairs(prints)
    return found.join(same, ["video_a", "video_b"], "left_anti").unionByName(same.withColumn("percent", F.lit(100.0)))


def exact_percent(pairs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The same percentage for given pairs with both arrays of hashes."""
    return pairs.withColumn("percent", frame_match_percent(F.col("hashes_a"), F.col("hashes_b"), distance))


def leaders(durations: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """duration, leader and the leader's first path, of distinct (duration, first).

    Whoever comes first among all within the tolerance leads, those within its
    tolerance follow, and the others go on: the same leaders as taking one after
    the other in the order of their paths. In cells somewhat wider than the
    tolerance only the first of a cell can lead, and only neighbours of a cell can
    be near, so a round is two joins by cells; the rounds grow with the logarithm
    of a chain's length where paths are in no order, and at worst (paths in the
    order of durations) with the number of leaders in a row. Each round is a table.
    """
    if tolerance < 0:
        raise ValueError("the tolerance is negative")
    width = tolerance * (1 + 1e-9) or 1.0
    whole = store.materialise(durations.select("duration", "first", F.floor(F.col("duration") / width).alias("cell")), "durations")
    around = lambda cells: F.explode(F.array(*(F.col("cell") + k for k in cells)))
    near = F.abs(F.col("duration") - F.col("leader")) <= tolerance
    open_, found = whole, []
    while not open_.isEmpty():
        first = open_.groupBy("cell").agg(F.min(F.struct("first", "duration")).alias("m")).select("cell", F.col("m.first").alias("lead_first"), F.col("m.duration").alias("leader"))
        beaten = open_.join(first.select(around((-1, 1)).alias("cell"), "leader", "lead_first"), "cell").where(near & (F.col("first") < F.col("lead_first"))).select("leader").distinct()
        lead = store.materialise(first.join(beaten, "leader", "left_anti").select("leader", "lead_first", "cell"), "leaders")
        led = open_.join(lead.select(around((-1, 0, 1)).alias("cell"), "leader"), "cell").where(near).select("duration").distinct()
        rest = store.materialise(open_.join(led, "duration", "left_anti"), "durations")
        if open_ is not whole:
            store.discard(open_)
        found.append(lead)
        open_ = rest
    if not found:
        return whole.select("duration", F.col("duration").alias("leader"), F.col("first").alias("lead_first"))
    lead = found[0]
    for more in found[1:]:
        lead = lead.unionByName(more)
    met = whole.join(lead.select(around((-1, 0, 1)).alias("cell"), "leader", "lead_first"), "cell").where(near)
    return met.groupBy("duration").agg(F.min(F.struct("lead_first", "leader")).alias("l")).select("duration", "l.leader", "l.lead_first")


def duration_groups(files: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """path, duration, its leader and the leader's first path, for groups of two and more; unknown and infinite durations go.

    A file joins the first earlier leader within the tolerance, in path order,
    else leads. Later files of a duration follow its first.
    """
    known = files.where(F.col("duration").isNotNull() & ~F.isnan("duration") & (F.abs("duration") != float("inf")))
    lead = leaders(known.groupBy("duration").agg(F.min("path").alias("first")), tolerance)
    joined = known.select("path", "duration").join(lead, "duration")
    big = joined.groupBy("leader").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return joined.join(big, "leader").select("path", "duration", "leader", "lead_first")


def video_groups(videos: DataFrame, prints: DataFrame, distance: int = DISTANCE, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, quick: bool = True, by_duration: bool = True) -> DataFrame:
    """path and its group (the first path) of videos that look alike, from (path, duration) and (video, hashes).

    Durations only say which videos take part: those of groups of two and more,
    each compared with every other, of whatever group. Of a pair, the one whose
    leader came first (then the one with the first path) is asked for its frames.
    Videos with the same frames count as one, which comes both as early as the first
    and as late as the last of them; they, and videos with the same signature,
    are tied to the first one instead of each other.
    """
    taking_part = prints.where(F.size("hashes") > 0).select(F.col("video").alias("path"), "hashes")
    order = F.struct("path")
    if by_duration:
        taking_part = taking_part.join(duration_groups(videos, tolerance).select("path", "lead_first"), "path")
        order = F.struct("lead_first", "path")
    taking_part = store.materialise(taking_part.withColumn("order", order), "videos")
    alike = taking_part.groupBy("hashes").agg(F.min("order").alias("lo"), F.max("order").alias("hi"))
    alike = store.materialise(alike.select(F.col("lo.path").alias("video"), "hashes", "lo", "hi"), "prints")
    copies = taking_part.join(alike, "hashes").where(F.col("path") != F.col("video"))
    edges = compared(alike, distance, threshold).select("video_a", "video_b").unionByName(copies.select(F.col("video").alias("video_a"), F.col("path").alias("video_b")))
    if quick:
        signed = alike.select("video", visual_signature(F.col("hashes")).alias("sig"))
        first = signed.groupBy("sig").agg(F.min("video").alias("first"))
        edges = edges.unionByName(signed.join(first, "sig").where("video <> first").select(F.col("first").alias("video_a"), F.col("video").alias("video_b")))
    return groups.components(edges, "video_a", "video_b").select(F.col("node").alias("path"), F.col("component").alias("group"))
