import datetime
import threading
import time

import pytest

from simigraph import store
from simigraph.progress import Progress, StreamProgress, cancellable, log_to, logger, observed, stages, watching
from simigraph.streaming import scans, versions

VERSIONS = "path string, size long, mtime double"


def test_catalog_stream_keeps_the_latest_version(spark, tmp_path):
    source, catalog, log = (f"file://{tmp_path}/{n}" for n in ("in", "catalog", "log"))
    spark.createDataFrame([("a", 1, 1.0), ("b", 1, 5.0)], VERSIONS).coalesce(1).write.parquet(source)
    scans.keep_catalog(scans.file_stream(spark, source, VERSIONS, 1), catalog, log, 4, keep=9).awaitTermination()
    spark.createDataFrame([("a", 2, 3.0), ("b", 2, 4.0), ("c", 3, 1.0)], VERSIONS).coalesce(1).write.mode("append").parquet(source)
    scans.keep_catalog(scans.file_stream(spark, source, VERSIONS, 1), catalog, log, 4, keep=9).awaitTermination()
    assert {(r.path, r["size"]) for r in scans.read_catalog(spark, catalog, VERSIONS).collect()} == {("a", 2), ("b", 1), ("c", 3)}
    assert {(r.path, r["size"]) for r in scans.read_catalog(spark, catalog, VERSIONS, 1).collect()} == {("a", 1), ("b", 1)}


def test_deletions_in_the_stream(spark, tmp_path):
    schema = f"{VERSIONS}, deleted boolean"
    source, catalog, log = (f"file://{tmp_path}/{n}" for n in ("in", "catalog", "log"))
    for rows in ([("a", 1, 1.0, False), ("b", 1, 5.0, None)], [("a", 0, 2.0, True), ("b", 0, 4.0, True)], [("a", 9, 1.5, False), ("c", 3, 1.0, False), ("c", 3, 2.0, True)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        scans.keep_catalog(scans.file_stream(spark, source, schema, 1), catalog, log, 2).awaitTermination()
    assert [(r.path, r["size"]) for r in scans.read_catalog(spark, catalog, VERSIONS).collect()] == [("b", 1)]


@pytest.mark.parametrize("at", ["put", "commit", "_claim", "clean"])
def test_catalog_survives_a_writer_that_dies(spark, tmp_path, monkeypatch, at):
    source, catalog, log = (f"file://{tmp_path}/{n}" for n in ("in", "catalog", "log"))
    spark.createDataFrame([("a", 1, 1.0), ("b", 1, 5.0)], VERSIONS).write.parquet(source)
    scans.keep_catalog(scans.file_stream(spark, source, VERSIONS), catalog, log, 3).awaitTermination()
    spark.createDataFrame([("c", 3, 1.0)], VERSIONS).write.mode("append").parquet(source)

    def dies(*_, **__):
        raise RuntimeError("gone")

    with monkeypatch.context() as m:
        m.setattr(store, at, dies)
        with pytest.raises(Exception, match="gone"):
            scans.keep_catalog(scans.file_stream(spark, source, VERSIONS), catalog, log, 3).awaitTermination()
    assert {r.path for r in scans.read_catalog(spark, catalog, VERSIONS).collect()} == {"a", "b"} | ({"c"} if at == "clean" else set())
    scans.keep_catalog(scans.file_stream(spark, source, VERSIONS), catalog, log, 3).awaitTermination()
    assert {r.path for r in scans.read_catalog(spark, catalog, VERSIONS).collect()} == {"a", "b", "c"}


def test_versions(spark, tmp_path):
    table = f"file://{tmp_path}/t"
    assert store.read(spark, table) is None
    for n in range(1, 5):
        store.replace(spark.range(n), table)
        assert store.read(spark, table).count() == n
    assert store.versions(spark, table) == [3, 4]
    assert store.read(spark, table, 3).count() == 3
    with pytest.raises(ValueError, match="no version 1"):
        store.read(spark, table, 1)
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("part-")]) == 2
    store.put(spark.range(1), table)  # a writer that died
    store.clean(spark, table)
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("part-")]) == 3
    store.clean(spark, table, orphans_after=0)
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("part-")]) == 2
    assert not [p for p in (tmp_path / "t" / "_log").iterdir() if not p.name.isdigit()]


@pytest.mark.parametrize("first", [0, 1])
def test_two_whole_writers_at_once(spark, tmp_path, first):
    """Both write before either commits; both commits stand, and the later one is read."""
    table = f"file://{tmp_path}/t"
    frames = [spark.range(3), spark.range(100, 105)]
    folders = [store.put(f, table) for f in frames]
    for k in (first, 1 - first):
        store.commit(spark, table, {0: folders[k]}, frames[k].schema, whole=True)
        assert {r.id for r in store.read(spark, table).collect()} == {r.id for r in frames[k].collect()}
    assert store.versions(spark, table) == [1, 2]
    assert {r.id for r in store.read(spark, table, 1).collect()} == {r.id for r in frames[first].collect()}


def test_two_who_take_the_same_number(spark, tmp_path, monkeypatch):
    table = f"file://{tmp_path}/t"
    schema = spark.range(1).schema
    assert store._claim(spark, table, store.Version(1, {}, schema))
    assert not store._claim(spark, table, store.Version(1, {0: "other"}, schema))
    assert store.version(spark, table).folders == {}
    # One that looked before the other committed finds the number taken, and looks again.
    folder, seen = store.put(spark.range(2), table), []
    real = store.version

    def behind(*args, **options):
        seen.append(1)
        return None if len(seen) == 1 else real(*args, **options)

    with monkeypatch.context() as m:
        m.setattr(store, "version", behind)
        assert store.commit(spark, table, {0: folder}, schema, whole=True).number == 2
    assert store.read(spark, table).count() == 2


def test_merging_writers(spark, tmp_path):
    """One merges other buckets between the reading and the commit of another, then the same bucket."""
    table = f"file://{tmp_path}/t"
    store.merge(spark, table, [0, 1], lambda k, old: spark.range(k, k + 1))
    calls = []

    def slow(k, old):
        calls.append(old.count())
        if len(calls) == 1:
            store.merge(spark, table, [1], lambda _, o: o.union(spark.range(10, 11)))
        if len(calls) == 2:
            store.merge(spark, table, [0], lambda _, o: o.union(spark.range(20, 21)))
        return old.union(spark.range(30, 31))

    store.merge(spark, table, [0], slow)
    assert {r.id for r in store.read(spark, table).collect()} == {0, 1, 10, 30} and calls == [1]
    store.merge(spark, table, [0], slow)  # disturbed: made again from the other's rows
    assert {r.id for r in store.read(spark, table, bucket=0).collect()} == {0, 20, 30} and calls == [1, 2, 3]
    base = store.version(spark, table)
    store.merge(spark, table, [0], lambda _, o: o)
    with pytest.raises(store.Conflict):
        store.commit(spark, table, {0: "x"}, base.schema, base)


def test_versions_as_state(spark, tmp_path):
    """Only newer versions come out; tombstones go once the watermark has passed them, files stay."""
    schema = "path string, size long, mtime double, deleted boolean, ts timestamp"
    source, log = f"file://{tmp_path}/in", f"file://{tmp_path}/log"
    day = lambda d: datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(days=d)
    seen, sizes = [], []

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        got = []
        stream = versions.changes(scans.file_stream(spark, source, schema, 1), late="1 hour", forget_ms=86_400_000)
        with versions.keyed_state(spark):
            q = stream.writeStream.foreachBatch(lambda b, _: got.extend(tuple(r) for r in b.collect())).option("checkpointLocation", log).trigger(availableNow=True).start()
        q.awaitTermination()
        seen.append(sorted(got))
        sizes.append(q.lastProgress.stateOperators[0].numRowsTotal)

    run([("a", 1, 1.0, False, day(0)), ("a", 2, 3.0, None, day(0)), ("b", 1, 1.0, False, day(0)), ("c", 1, 1.0, False, day(0)), (None, 1, 1.0, False, day(0))])
    assert seen[-1] == [("a", 2, 3.0, False), ("b", 1, 1.0, False), ("c", 1, 1.0, False)]
    run([("a", 9, 2.0, False, day(0.01)), ("b", 0, 5.0, True, day(0.01)), ("b", 7, 5.0, False, day(0.01)), ("c", 1, 1.0, False, day(0.01))])
    assert seen[-1] == [("b", 0, 5.0, True)]
    run([("b", 3, 4.0, False, day(0.02)), ("d", 1, 1.0, False, day(0.02))])
    assert seen[-1] == [("d", 1, 1.0, False)]
    many = [(f"x{k}", 1, 1.0, True, day(0.02)) for k in range(50)]
    run(many)
    assert sizes[-1] == 54
    run([("e", 1, 1.0, False, day(9))])
    run([("f", 1, 1.0, False, day(9.1))])
    assert sizes[-1] == 5  # a, c, d, e and f; the tombstones of b and x are forgotten
    run([("b", 8, 1.0, False, day(9.2)), ("a", 1, 1.0, False, day(9.2))])
    assert seen[-1] == [("b", 8, 1.0, False)]
    assert spark.conf.get(versions.PROVIDER, None) != versions.ROCKS


def test_tombstones_of_vanished_files(spark):
    known = spark.createDataFrame([("/a", 1, 1.0), ("/b", 1, 1.0)], VERSIONS)
    assert [r[:4] for r in versions.tombstones(known, known.where("path = '/a'"), 9.0).collect()] == [("/b", 0, 9.0, True)]
    with pytest.raises(ValueError, match="stream"):
        versions.changes(known)


def test_stream_progress_and_windows(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'x' event_type union all select timestamp'2024-01-03 00:10:00', 'y'").write.parquet(source)
    seen: list[Progress] = []
    listener = StreamProgress(seen.append)
    spark.streams.addListener(listener)
    try:
        rows = scans.windowed_counts(scans.file_stream(spark, source, "ts timestamp, event_type string"))
        out = scans.drain(rows, "windows").collect()
    finally:
        spark.streams.removeListener(listener)
    assert [(r.event_type, r.n) for r in out] == [("x", 1)]  # the other window may still get rows
    assert seen and seen[0].kind == "started"


def test_cancelling_work_that_runs(spark):
    """Another thread cancels a job that would take minutes; what comes after it runs."""
    slow = spark.range(0, 10**11, 1, 4).selectExpr("sum(pmod(xxhash64(id), 7)) s")
    seen: list[Progress] = []
    began = time.monotonic()
    with cancellable(spark, "slow") as cancel, watching(spark, seen.append, 0.1):
        timer = threading.Timer(3, cancel)
        timer.start()
        with pytest.raises(Exception, match="(?i)cancel"):
            slow.collect()
    assert 2 < time.monotonic() - began < 60
    assert seen and all(p.kind == "stage" and p.done < p.total for p in seen)
    assert spark.range(10).count() == 10 and stages(spark) == []


def test_counting_what_is_written(spark):
    rows, counted = observed(spark.createDataFrame([("/a",), ("/c",), ("/b",)], "path string"))
    store.discard(store.materialise(rows, "rows"))
    assert counted() == (3, "/c")
    none, counted = observed(spark.range(5).where("id > 9"), "id")
    store.discard(store.materialise(none, "rows"))
    assert counted() == (0, "")


def test_cancelling_and_logging(spark, tmp_path):
    with cancellable(spark, "t") as cancel:
        assert spark.range(10).count() == 10
        cancel()
    assert stages(spark) == []
    log_to(str(tmp_path / "log.txt"))
    logger.info("hello")
    for h in list(logger.handlers):
        logger.removeHandler(h)
        h.close()
    assert "hello" in (tmp_path / "log.txt").read_text()


def test_digest_cache(spark, tmp_path):
    from simigraph.sources import caches

    (tmp_path / "c.json").write_text('[{"Path": "C:/A.TXT", "LastWriteTime": 5, "Size": 3, "SHA256": "AB"}]')
    assert caches.read_digests(spark, str(tmp_path / "c.json")).first()[:] == ("c:/a.txt", 5, 3, "ab")


def test_unknown_yaml_is_made(tmp_path):
    pytest.importorskip("yaml")
    from simigraph.config import Config, load

    assert load(str(tmp_path / "x" / "c.yaml")) == Config()
