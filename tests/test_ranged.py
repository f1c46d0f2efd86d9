"""Files read in pieces, container headers, and work that goes on where it was stopped."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from simigraph import store
from simigraph.operators import exact, incremental
from simigraph.plans.visual import container
from simigraph.progress import Progress
from simigraph.sources import containers, ranged


@pytest.fixture
def tree(spark, tmp_path):
    """Files of equal and other sizes, some equal in their ends, some as a whole, in folders of two levels."""
    rnd = random.Random(1)
    base = rnd.randbytes(5000)
    contents = {"a/x.bin": base, "a/b/y.BIN": base, "a/b/c/d/z.bin": base[:2500] + b"!" + base[2501:], "q.txt": rnd.randbytes(5000), "a/e.txt": b"", "f.txt": b"", "a/g.txt": b"short", "a/b/h.txt": b"other length", "a/b/i.txt": b"shor1"}
    rows = [(k, bytearray(v)) for k, v in contents.items()]
    assert ranged.write_files(spark.createDataFrame(rows, "path string, content binary"), f"file://{tmp_path}/t") == len(contents)
    return f"{tmp_path}/t", contents


def test_listing(spark, tree):
    root, contents = tree
    for shares in (1, 3):
        rows = ranged.ranged_files(spark, [f"file://{root}"], shares=shares).collect()
        assert {r.path[len(root) + 1 :]: r["size"] for r in rows} == {k: len(v) for k, v in contents.items()} and len(rows) == len(contents)
        assert all(r.bytes_read == 0 and r.first is None for r in rows)
        assert {r.extension for r in rows} == {".bin", ".txt"} and all(abs(r.mtime - os.stat(r.path).st_mtime) < 1e-6 for r in rows)
    assert ranged.ranged_files(spark, [root], recurse=False).count() == 2
    assert ranged.ranged_files(spark, [f"{root}/none"]).count() == 0
    with pytest.raises(ValueError, match="mounted"):
        ranged.ranged_files(spark, ["s3://b/x"])


def test_filters_are_taken_into_the_listing(spark, tree):
    root, contents = tree
    key = "spark.sql.python.filterPushdown.enabled"
    wanted = lambda f: f.where((F.col("size") >= 5) & (F.col("extension") == ".bin") & F.col("path").contains("/b/"))
    plain = wanted(ranged.ranged_files(spark, [root], ends=100)).collect()
    spark.conf.set(key, "true")
    try:
        files = wanted(ranged.ranged_files(spark, [root], ends=100))
        rows = files.collect()
        folder = ranged.FilteringReader({"roots": root, "ends": "100"})
        kept = list(folder.pushFilters([ranged.GreaterThanOrEqual(("size",), 5), ranged.EqualTo(("extension",), ".bin"), ranged.EqualTo(("mtime",), 1.0)]))
        assert [k.attribute for k in kept] == [("mtime",)]
        assert sum(b.num_rows for p in folder.partitions() for b in folder.read(p)) == 3
    finally:
        spark.conf.unset(key)
    assert {r.path for r in rows} == {r.path for r in plain} == {f"{root}/a/b/y.BIN", f"{root}/a/b/c/d/z.bin"}
    assert all(bytes(r.first) == contents[r.path[len(root) + 1 :]][:100] and bytes(r.last) == contents[r.path[len(root) + 1 :]][-100:] and r.bytes_read == 200 for r in rows)


def test_only_what_is_needed_is_read(spark, tree):
    root, contents = tree
    listing = store.materialise(ranged.ranged_files(spark, [root]).select("path", "size", "mtime"), "listing")
    signed = {r.path[len(root) + 1 :]: r for r in ranged.signatures(exact.size_groups(listing), 1000).collect()}
    assert set(signed) == {"a/x.bin", "a/b/y.BIN", "a/b/c/d/z.bin", "q.txt", "a/e.txt", "f.txt", "a/g.txt", "a/b/i.txt"}
    assert {signed[k].bytes_read for k in ("a/x.bin", "a/b/y.BIN", "a/b/c/d/z.bin", "q.txt")} == {2000}
    assert signed["a/g.txt"].quick == hashlib.md5(b"shortshort").hexdigest() and signed["a/g.txt"].bytes_read == 5
    assert signed["a/x.bin"].quick == signed["a/b/c/d/z.bin"].quick == hashlib.md5(contents["a/x.bin"][:1000] + contents["a/x.bin"][-1000:]).hexdigest()
    groups = {r.path[len(root) + 1 :]: r.sha256 for r in exact.exact_groups_of_files(listing, 1000).collect()}
    assert groups == {k: hashlib.sha256(contents[k]).hexdigest() for k in ("a/x.bin", "a/b/y.BIN", "a/e.txt", "f.txt")}
    whole = {r.path[len(root) + 1 :]: r.bytes_read for r in ranged.digests(exact.quick_groups_of_files(listing, 1000)).collect()}
    assert whole == {k: len(contents[k]) for k in ("a/x.bin", "a/b/y.BIN", "a/b/c/d/z.bin", "a/e.txt", "f.txt")}


def test_files_that_vanish(spark, tree):
    root, _ = tree
    gone = spark.createDataFrame([(f"{root}/nothing", 5, 0.0), (f"{root}/a/g.txt", 5, 0.0)], "path string, size long, mtime double")
    assert {r.path.rpartition("/")[2]: r.quick is None for r in ranged.signatures(gone).collect()} == {"nothing": True, "g.txt": False}
    assert [r.sha256 for r in ranged.digests(gone).where("path like '%nothing'").collect()] == [None]
    assert ranged.durations(gone).where("duration is not null").count() == 0


def test_no_content_in_an_exchange(spark):
    """Contents are read by one scan, and go into no shuffle."""
    rows = [(f"/{i}", 3, 0.0, bytearray(b"abc")) for i in range(20)]
    path = store.new_path(spark, "given")
    spark.createDataFrame(rows, "path string, size long, mtime double, content binary").write.parquet(path)
    files = spark.read.parquet(path)
    for found in (exact.exact_groups(files), exact.quick_groups(files), exact.hash_groups(files), exact.size_groups(files).select("path", "size")):
        assert "content#" not in found._jdf.queryExecution().executedPlan().toString()
    assert exact.funnel(files).first()[:] == (20, 20, 20, 20, 1)


@pytest.mark.parametrize("key", range(1, 13))
def test_durations_of_containers(key):
    ms = 1000 * key + 7
    data = container(key, ms)
    read = []

    def piece(at, n):
        read.append(n)
        return data[at : at + n]

    assert containers.duration(piece, len(data)) == (None if key % 7 == 0 else pytest.approx(ms / 1000, abs=1e-6))
    assert sum(read) < 500 < len(data) or key % 7 == 0


def test_broken_containers_have_no_duration():
    rnd = random.Random(2)
    for key in (1, 2, 3, 4, 6):
        whole = container(key, 90_000)
        for _ in range(400):
            data = bytearray(whole[: rnd.randint(0, len(whole))] if rnd.random() < 0.5 else whole)
            for _ in range(rnd.randint(0, 4)):
                if data:
                    data[rnd.randrange(min(len(data), 500))] = rnd.choice([0, 1, 255, rnd.randrange(256)])
            found = containers.duration(lambda at, n, d=bytes(data): d[at : at + n], len(data))
            assert found is None or found >= 0
    assert containers.duration(lambda at, n: b"", 0) is None
    forever = b"\0\0\0\x08free" * 10
    assert containers.duration(lambda at, n: (forever * (n // 80 + 2))[at % 8 : at % 8 + n], 1 << 40) is None


def test_fragmented_mp4_and_unknown_sizes():
    box = lambda name, body: (8 + len(body)).to_bytes(4, "big") + name + body
    number = lambda *n: b"".join(x.to_bytes(4, "big") for x in n)
    data = box(b"ftyp", b"isom") + box(b"moov", box(b"mvhd", number(0, 0, 0, 600, 0)) + box(b"mvex", box(b"mehd", number(0, 1500))))
    assert containers.duration(lambda at, n: data[at : at + n], len(data)) == 2.5
    live = b"\x1a\x45\xdf\xa3\x80" + b"\x18\x53\x80\x67\x01" + b"\xff" * 7 + b"\x15\x49\xa9\x66\x87\x44\x89\x84\x45\x7a\x00\x00"
    assert containers.duration(lambda at, n: live[at : at + n], len(live)) == 4.0


class Stopped(Exception):
    pass


def test_work_goes_on_where_it_was_stopped(spark):
    work = spark.createDataFrame([(f"/{i}", 1.0) for i in range(40)], "path string, mtime double")
    cache, made, heard = store.new_path(spark, "cache"), [], []

    def make(todo, k):
        made.append((k, {r.path for r in todo.collect()}))
        return todo.withColumn("n", F.length("path"))

    def stop(p: Progress):
        heard.append(p)
        if (p.kind, p.done) == ("batch", 2):
            raise Stopped

    schema = "path string, mtime double, n int"
    with pytest.raises(Stopped):
        incremental.resumable(work, cache, make, schema, 4, listener=stop)
    assert [p.kind for p in heard] == ["files", "batch"] * 2
    assert [(p.done, p.item) for p in heard if p.kind == "files"] == [(len(made[0][1]), max(made[0][1])), (len(made[0][1]) + len(made[1][1]), max(made[1][1]))]
    assert [k for k, _ in made] == [0, 1] and store.versions(spark, cache) == [1, 2]
    assert incremental.resumable(work, cache, make, schema, 4).count() == 40
    assert sum(len(p) for _, p in made) == 40 and len({p for _, some in made for p in some}) == 40
    # Changed files are made again, in place of the old rows; others are not.
    made.clear()
    newer = work.withColumn("mtime", F.when(F.col("path") == "/7", 2.0).otherwise(F.col("mtime")))
    assert incremental.resumable(newer, cache, make, schema, 4).count() == 40
    assert [p for _, p in made] == [{"/7"}] and store.read(spark, cache).count() == 40
    assert incremental.resumable(work.limit(0), cache, make, schema, 4).count() == 0
