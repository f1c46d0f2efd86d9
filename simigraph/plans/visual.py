"""Frames, videos and durations."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from simigraph import store
from simigraph.functions.digests import average_hash, frame_match_percent, frames_of, visual_signature
from simigraph.operators import visual
from simigraph.plans.registry import query
from simigraph.plans.state import resumed
from simigraph.sources import caches, ranged
from simigraph.sources.catalog import BLEND, embedding_frames, event_durations, table

HASHES = f"""WITH raw AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), cells AS (SELECT label, i, avg(v[i]) AS m FROM raw, range(1, 65) AS r(i) GROUP BY label, i), shots AS (SELECT label, list(m ORDER BY i) AS c FROM cells GROUP BY label),
px AS (SELECT vec_id, label, list_transform(range(1, 65), lambda i: v[i] * (1 - {BLEND}::DOUBLE) + c[i] * {BLEND}::DOUBLE) AS e FROM raw JOIN shots USING (label)), mean AS (SELECT vec_id, label, e, list_sum(e) / 64 AS m FROM px),
h AS (SELECT vec_id AS frame, CAST(label AS BIGINT) AS video, list_reduce(list_concat([0::BIGINT], list_transform(list_slice(e, 2, 64), lambda v: CASE WHEN v >= m THEN 1::BIGINT ELSE 0::BIGINT END)), lambda a, b: a * 2 + b) + CASE WHEN e[1] >= m THEN (-9223372036854775807 - 1)::BIGINT ELSE 0::BIGINT END AS hash FROM mean)"""


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_frames(spark, sf_dir).select("frame", "video", average_hash(F.col("pixels")).alias("hash"))


@query("x10_ahash", HASHES + " SELECT frame, hash FROM h")
def x10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashes(spark, sf_dir).select("frame", "hash")


@query("x11_hamming", HASHES + " SELECT a.frame AS frame, CAST(bit_count(xor(a.hash, b.hash)) AS INTEGER) AS bits FROM h a JOIN h b ON b.frame = a.frame + 1")
def x11(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = hashes(spark, sf_dir)
    b = a.select((F.col("frame") - 1).alias("frame"), F.col("hash").alias("other"))
    return a.join(b, "frame").select("frame", F.bit_count(F.col("hash").bitwiseXOR(F.col("other"))).alias("bits"))


@query("j11_hamming_pairs", HASHES + f" SELECT a.frame AS id_a, b.frame AS id_b, CAST(bit_count(xor(a.hash, b.hash)) AS INTEGER) AS bits FROM h a JOIN h b ON a.frame < b.frame WHERE bit_count(xor(a.hash, b.hash)) <= {visual.DISTANCE}")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual.near_hashes(hashes(spark, sf_dir).select(F.col("frame").alias("id"), "hash"))


# A video for each shot and each remainder of its frames by five, so that there are many.

PRINTS = HASHES + ", v AS (SELECT video * 5 + frame % 5 AS video, frame, hash FROM h), prints AS (SELECT video, list(hash ORDER BY frame) AS hashes FROM v GROUP BY video)"


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = embedding_frames(spark, sf_dir).withColumn("video", F.col("video") * 5 + F.col("frame") % 5)
    return visual.fingerprints(frames)


@query("x12_visual_signature", PRINTS + " SELECT video, hashes[1] AS first, CASE WHEN len(hashes) < 3 THEN NULL ELSE hashes[len(hashes) // 2 + 1] END AS middle, hashes[len(hashes)] AS last FROM prints")
def x12(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = prints(spark, sf_dir).select("video", visual_signature(F.col("hashes")).alias("s"))
    return signed.select("video", F.element_at("s", 1).alias("first"), F.when(F.size("s") == 3, F.element_at("s", 2)).alias("middle"), F.element_at("s", -1).alias("last"))


@query("j10_signature_pairs", "SELECT a.o_orderkey AS video_a, b.o_orderkey AS video_b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = b.o_orderstatus AND a.o_orderkey < b.o_orderkey")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as videos whose two hashes are their customer and status."""
    o = table(spark, sf_dir, "orders")
    status = F.xxhash64("o_orderstatus")
    return visual.signature_pairs(o.select(F.col("o_orderkey").alias("video"), F.array(F.col("o_custkey").cast("long"), status).alias("hashes")))


_COMPARED = PRINTS + f", c AS (SELECT a.video AS video_a, b.video AS video_b, count(DISTINCT x.frame) AS matched, any_value(len(a.hashes)) AS na, any_value(len(b.hashes)) AS nb FROM prints a JOIN prints b ON a.video < b.video JOIN v x ON x.video = a.video JOIN v y ON y.video = b.video AND bit_count(xor(x.hash, y.hash)) <= {visual.DISTANCE} GROUP BY 1, 2) "


@query("x13_frame_match", _COMPARED + "SELECT video_a, video_b, matched / least(na, nb)::DOUBLE * 100 AS percent FROM c")
def x13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual.frame_matches(store.materialise(prints(spark, sf_dir), "prints"))


@query("f12_video_matches", _COMPARED + "SELECT video_a, video_b, matched / least(na, nb)::DOUBLE * 100 AS percent FROM c WHERE matched / least(na, nb)::DOUBLE * 100 >= 70")
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual.match_videos(store.materialise(prints(spark, sf_dir), "prints"))


@query("a13_given_pairs", PRINTS + f", m AS (SELECT a.video AS video, len(list_filter(a.hashes, lambda x: len(list_filter(b.hashes, lambda y: bit_count(xor(x, y)) <= {visual.DISTANCE})) > 0)) AS matched, least(len(a.hashes), len(b.hashes)) AS n FROM prints a JOIN prints b ON b.video = a.video + 1) SELECT video, matched / n::DOUBLE * 100 AS percent FROM m")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = store.materialise(prints(spark, sf_dir), "prints")
    b = a.select((F.col("video") - 1).alias("video"), F.col("hashes").alias("other"))
    return a.join(b, "video").select("video", frame_match_percent(F.col("hashes"), F.col("other"), visual.DISTANCE).alias("percent"))


_DURATIONS = "SELECT CAST(event_id AS VARCHAR) AS path, value AS duration FROM events WHERE value IS NOT NULL"
# One step for each distinct duration, in the order of its first path, with the leaders so far.
LEADERS = f"""WITH RECURSIVE f AS ({_DURATIONS}), firsts AS (SELECT duration, row_number() OVER (ORDER BY min(path)) AS k FROM f GROUP BY duration),
steps AS (SELECT 0::BIGINT AS k, NULL::DOUBLE AS duration, NULL::DOUBLE AS leader, []::DOUBLE[] AS leaders
  UNION ALL SELECT n.k, n.duration, n.lead, CASE WHEN n.lead = n.duration AND NOT list_contains(n.leaders, n.duration) THEN list_append(n.leaders, n.duration) ELSE n.leaders END
  FROM (SELECT x.k, x.duration, s.leaders, coalesce(list_filter(s.leaders, lambda l: abs(x.duration - l) <= 5)[1], x.duration) AS lead FROM steps s JOIN firsts x ON x.k = s.k + 1) n),
led AS (SELECT f.path, f.duration, steps.leader, count(*) OVER (PARTITION BY steps.leader) AS n FROM f JOIN steps ON steps.duration = f.duration)"""


@query("a05_duration_groups", LEADERS + " SELECT path, duration, leader FROM led WHERE n > 1")
def a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual.duration_groups(event_durations(spark, sf_dir)).drop("lead_first")


@query("j12_near_durations", "WITH d AS (SELECT DISTINCT value AS d FROM events WHERE value IS NOT NULL), p AS (SELECT a.d AS a, b.d AS b FROM d a JOIN d b ON a.d < b.d AND b.d - a.d <= 0.05) SELECT a, count(*) AS near FROM p GROUP BY a")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range join by cells of the tolerance's width and their neighbours."""
    d = table(spark, sf_dir, "events").where("value is not null").select(F.col("value").alias("d")).distinct()
    cell = F.floor(F.col("d") / 0.05).cast("long")
    a = d.select(F.col("d").alias("a"), F.explode(F.array(cell, cell + 1)).alias("cell"))
    b = d.select(F.col("d").alias("b"), cell.alias("cell"))
    return a.join(b, "cell").where((F.col("a") < F.col("b")) & (F.col("b") - F.col("a") <= 0.05)).groupBy("a").agg(F.count("*").alias("near"))


VIDEO_DURATIONS = PRINTS + ", files AS (SELECT video AS path, CAST(video * 7919 % 11 AS DOUBLE) AS duration FROM prints)"


def videos(prints_: DataFrame) -> DataFrame:
    return prints_.select(F.col("video").alias("path"), (F.col("video") * 7919 % 11).cast("double").alias("duration"))


# Durations are 0 to 10 and the tolerance is 5, so there are three leaders at most; they are found one after the other. Videos of groups of
# two and more are put in a row, group after group, and each is asked for its frames by every later one.
_VIDEO_GROUPS = (
    VIDEO_DURATIONS.replace("WITH raw", "WITH RECURSIVE raw", 1)
    + """, l1 AS (SELECT min_by(duration, path) AS d FROM files), l2 AS (SELECT min_by(duration, path) AS d FROM files, l1 WHERE abs(duration - l1.d) > 5),
l3 AS (SELECT min_by(duration, path) AS d FROM files, l1, l2 WHERE abs(duration - l1.d) > 5 AND abs(duration - l2.d) > 5),
leads AS (SELECT path, CASE WHEN abs(duration - l1.d) <= 5 THEN 1 WHEN abs(duration - l2.d) <= 5 THEN 2 ELSE 3 END AS no FROM files, l1, l2, l3),
flat AS (SELECT path, row_number() OVER (ORDER BY no, path) AS place FROM (SELECT *, count(*) OVER (PARTITION BY no) AS members FROM leads) WHERE members > 1),
placed AS (SELECT place, video, hashes, hashes[1] AS f, CASE WHEN len(hashes) < 3 THEN hashes ELSE [hashes[1], hashes[len(hashes) // 2 + 1], hashes[len(hashes)]] END AS sig FROM prints JOIN flat ON path = video),
e AS (SELECT p.video AS a, q.video AS b FROM placed p JOIN placed q ON p.place < q.place WHERE p.sig = q.sig
  OR len(list_filter(p.hashes, lambda x: len(list_filter(q.hashes, lambda y: bit_count(xor(x, y)) <= 10)) > 0)) / least(len(p.hashes), len(q.hashes))::DOUBLE * 100 >= 70),
both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS seen FROM both_ UNION SELECT r.node, both_.b FROM r JOIN both_ ON r.seen = both_.a)
SELECT node AS path, min(seen) AS "group" FROM r GROUP BY node"""
)


@query("a06_video_groups", _VIDEO_GROUPS)
def a06_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Video mode from durations and fingerprints to groups."""
    found = store.materialise(prints(spark, sf_dir), "prints")
    return visual.video_groups(videos(found), found)


@query("s09_fingerprint_cache", PRINTS + " SELECT video, len(hashes) AS frames, hashes[1] AS first, hashes[len(hashes)] AS last FROM prints")
def s09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints written to their cache, as unsigned text, and read back."""
    path = caches.fingerprint_path(store.new_path(spark, "prints"), "1/10")
    caches.write_fingerprints(prints(spark, sf_dir).select(F.col("video").cast("string").alias("path"), F.lit(1.5).alias("mtime"), "hashes"), path)
    back = caches.read_fingerprints(spark, path, lines=True)
    return back.select(F.col("path").cast("long").alias("video"), F.size("hashes").cast("long").alias("frames"), F.element_at("hashes", 1).alias("first"), F.element_at("hashes", -1).alias("last"))


@query("r02_resumed_fingerprints", PRINTS + " SELECT video, hashes[1] AS first, CASE WHEN video % 4 < 2 THEN 1 ELSE 2 END AS run FROM prints")
def r02_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints by batches, into a cache; the first run is stopped after two batches, the second makes the others."""
    shots = embedding_frames(spark, sf_dir).withColumn("video", F.col("video") * 5 + F.col("frame") % 5)
    frames = store.new_path(spark, "frames")  # dealt like the work, so a batch reads its own
    shots.withColumn("_batch", (F.col("video") % 4).cast("int")).write.partitionBy("_batch").parquet(frames)
    stored = spark.read.schema(StructType([*shots.schema.fields]).add("_batch", "integer")).parquet(frames)

    def make(todo: DataFrame, k: int) -> DataFrame:
        some = stored.where(F.col("_batch") == k).drop("_batch").join(todo.select(F.col("path").cast("long").alias("video")), "video", "left_semi")
        return visual.fingerprints(some).select(F.col("video").cast("string").alias("path"), F.lit(1.0).alias("mtime"), F.element_at("hashes", 1).alias("first"))

    work = stored.select(F.col("video").cast("string").alias("path"), F.lit(1.0).alias("mtime")).distinct()
    return resumed(work, make, "first long", F.col("path").cast("long") % 4).select(F.col("path").cast("long").alias("video"), "first", "run")


# Files with the headers of a video container for each part: the duration in milliseconds is its price in cents.


def container(key: int, ms: int) -> bytes:
    """By the key: MP4 with its headers after the pictures or before them, Matroska, or AVI; each seventh is cut off."""
    box = lambda name, body: struct.pack(">I4s", 8 + len(body), name) + body
    element = lambda name, body: name + (len(body) | 1 << 28).to_bytes(4, "big") + body
    pictures = bytes(5000)
    if key % 3 == 0:
        old = struct.pack(">IIIII", 0, 0, 0, 1000, ms)
        new = b"\x01\0\0\0" + struct.pack(">QQIQ", 0, 0, 1000, ms)
        moov = box(b"moov", box(b"trak", b"\0" * 9) + box(b"mvhd", (old if key % 2 else new) + bytes(80)))
        parts = [box(b"mdat", pictures), moov] if key % 2 else [moov, box(b"mdat", pictures)]
        out = box(b"ftyp", b"isom\0\0\2\0") + b"".join(parts)
    elif key % 3 == 1:
        info = element(b"\x2a\xd7\xb1", (1_000_000).to_bytes(3, "big")) + element(b"\x44\x89", struct.pack(">d", float(ms)))
        out = element(b"\x1a\x45\xdf\xa3", b"\x42\x82\x84webm") + element(b"\x18\x53\x80\x67", element(b"\xec", bytes(300)) + element(b"\x15\x49\xa9\x66", info) + element(b"\x1f\x43\xb6\x75", pictures))
    else:
        chunk = lambda name, body: struct.pack("<4sI", name, len(body)) + body
        hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", struct.pack("<5I", 1000, 0, 0, 0, ms) + bytes(36)))
        out = chunk(b"RIFF", b"AVI " + chunk(b"JUNK", bytes(99)) + b"\0" + hdrl + chunk(b"LIST", b"movi" + pictures))
    return out[:30] if key % 7 == 0 else out


@query("s11_durations", "SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN CAST(round(p_retailprice * 100) AS BIGINT) / 1000.0::DOUBLE END AS duration FROM part")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Video files of all parts, written out and probed."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            paths = [f"/{k % 50}/{k}.{('mp4', 'mkv', 'avi')[k % 3]}" for k, _ in rows]
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array([container(k, ms) for k, ms in rows], pa.binary())], ["path", "content"])

    store.ship(spark)
    root = store.new_path(spark, "videos")
    ranged.write_files(table(spark, sf_dir, "part").select("p_partkey", F.round(F.col("p_retailprice") * 100).cast("long")).mapInArrow(made, "path string, content binary"), root)
    found = ranged.durations(ranged.ranged_files(spark, [root]))
    return found.select(F.regexp_extract("path", r"([0-9]+)\.[a-z0-9]+$", 1).cast("long").alias("p_partkey"), "duration")


# Raw gray bytes as a decoder writes them: the first 128 characters of each part's names.

_RAW = "WITH raw AS (SELECT p_partkey, rpad(p_name || p_type || p_brand, 130, '.') AS s FROM part), bytes AS (SELECT p_partkey, f, list_transform(range(1, 65), lambda i: CAST(ascii(substr(s, CAST(f * 64 + i AS BIGINT), 1)) AS DOUBLE)) AS e FROM raw, range(0, 2) AS r(f)), mean AS (SELECT *, list_sum(e) / 64 AS m FROM bytes)"


@query("s12_raw_frames", _RAW + ", h AS (SELECT p_partkey, f, list_reduce(list_concat([0::BIGINT], list_transform(list_slice(e, 2, 64), lambda v: CASE WHEN v >= m THEN 1::BIGINT ELSE 0::BIGINT END)), lambda a, b: a * 2 + b) + CASE WHEN e[1] >= m THEN (-9223372036854775807 - 1)::BIGINT ELSE 0::BIGINT END AS hash FROM mean) SELECT p_partkey, CAST(f AS INTEGER) AS frame, hash FROM h")
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """130 bytes are two frames; what is left over is dropped."""
    raw = F.rpad(F.concat("p_name", "p_type", "p_brand"), 130, ".").cast("binary")
    frames = store.spread(table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))).select("p_partkey", F.posexplode(frames_of(F.col("raw"))).alias("frame", "pixels"))
    return frames.select("p_partkey", "frame", average_hash(F.col("pixels")).alias("hash"))
