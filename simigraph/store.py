"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_local: dict[str, str] = {}
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; in local mode a temporary folder where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="simigraph-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _local[app] = f"file://{path}"
    return _local[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/simigraph/{tag}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt to as many tasks as shuffles have: a small file is read by one, however dear its rows are later."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once nothing reads it any more."""
    for t in tables:
        delete_path(t.sparkSession, t.stored_at)


# Tables kept by a log of commits. A version is one file of the log, which names a folder for each bucket and the columns. Folders have names of
# their own, so no writer ever writes where another one does; what isn't named by a version is never read.

LOG = "_log"
#: Stores where a file can be put in place at once, and only if there is none yet.
ATOMIC = ("file", "hdfs", "viewfs", "abfs", "abfss")


class Conflict(FileExistsError):
    """Another writer has changed the same buckets since they were read."""


@dataclass(frozen=True)
class Version:
    number: int
    folders: dict[int, str]
    schema: StructType


def versions(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the committed versions, in order."""
    fs, p = _path(spark, f"{table}/{LOG}")
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n) for n in names if n.isdigit())


def version(spark: SparkSession, table: str, number: int | None = None) -> Version | None:
    """The version of this number, or the newest; none of a table that was never written."""
    while True:
        found = versions(spark, table)
        if number is None and not found:
            return None
        wanted = found[-1] if number is None else number
        fs, p = _path(spark, f"{table}/{LOG}/{wanted:020d}")
        try:
            stream = fs.open(p)
        except Py4JJavaError:
            if number is None:  # it was cleaned away meanwhile, so there is a newer one
                continue
            raise ValueError(f"{table} has no version {number}") from None
        try:
            entry = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(wanted, {int(k): f for k, f in entry["folders"].items()}, StructType.fromJson(entry["schema"]))


def read(spark: SparkSession, table: str, number: int | None = None, bucket: int | None = None) -> DataFrame | None:
    """The newest version or that of a number, whole or one bucket of it; none of what was never written."""
    v = version(spark, table, number)
    if v is None:
        return None
    names = [f for k, f in sorted(v.folders.items()) if bucket in (None, k)]
    if not names:
        return None if bucket is not None else spark.createDataFrame([], v.schema)
    return spark.read.schema(v.schema).parquet(*(f"{table}/{n}" for n in names))


def put(df: DataFrame, table: str) -> str:
    """Write a folder that no version names yet."""
    name = f"part-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(f"{table}/{name}")
    return name


def commit(spark: SparkSession, table: str, folders: dict[int, str], schema: StructType, base: Version | None = None, whole: bool = False) -> Version:
    """Make a version with these folders in place of those of the same buckets (of all buckets, if ``whole``).

    With ``base``, the version that was read, a bucket that another writer has
    changed since is a Conflict; writers of different buckets don't disturb each
    other. Two who take the same number find out as the file is put in place, and
    the later one looks again.
    """
    while True:
        last = version(spark, table)
        now = last.folders if last else {}
        if not whole:
            was = base.folders if base else {}
            clash = [k for k in folders if now.get(k) != was.get(k)]
            if clash:
                raise Conflict(f"another writer has changed buckets {clash} of {table}")
        new = Version(last.number + 1 if last else 1, dict(folders) if whole else now | folders, schema)
        if _claim(spark, table, new):
            return new


def _claim(spark: SparkSession, table: str, new: Version) -> bool:
    """Put the version's file in place at once, if no other writer was faster."""
    entry = json.dumps({"folders": {str(k): f for k, f in new.folders.items()}, "schema": json.loads(new.schema.json())})
    fs, final = _path(spark, f"{table}/{LOG}/{new.number:020d}")
    _, draft = _path(spark, f"{table}/{LOG}/.{uuid.uuid4().hex}")
    scheme = fs.getUri().getScheme()
    if scheme not in ATOMIC:
        raise ValueError(f"{scheme} can't put a file in place at once; tables with a log need one of {', '.join(ATOMIC)}")
    out = fs.create(draft, True)
    out.write(bytearray(entry.encode()))
    out.close()
    try:
        if scheme != "file":
            return bool(fs.rename(draft, final))
        nio = spark._jvm.java.nio.file
        place = lambda p: nio.Paths.get(spark._jvm.java.net.URI(f"file://{p.toUri().getPath()}"))
        try:
            nio.Files.createLink(place(final), place(draft))
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True
    finally:
        fs.delete(draft, False)


def clean(spark: SparkSession, table: str, keep: int = 2, orphans_after: float | None = None) -> None:
    """Drop all but the newest ``keep`` versions and the folders that only they name.

    Folders that no version names may belong to a writer that hasn't committed;
    with ``orphans_after``, those that are so many hours old go as well.
    """
    numbers = versions(spark, table)
    old, kept = numbers[:-keep], numbers[-keep:]
    named: set[str] = set()
    for n in kept:
        named |= set(version(spark, table, n).folders.values())
    for n in old:
        gone = set(version(spark, table, n).folders.values()) - named
        delete_path(spark, f"{table}/{LOG}/{n:020d}")
        for f in gone:
            delete_path(spark, f"{table}/{f}")
    if orphans_after is not None:
        fs, p = _path(spark, table)
        for f in fs.listStatus(p):
            name = f.getPath().getName()
            if name.startswith("part-") and name not in named and f.getModificationTime() < (time.time() - orphans_after * 3600) * 1000:
                delete_path(spark, f"{table}/{name}")


def replace(df: DataFrame, table: str, keep: int = 2) -> Version:
    """The rows as the whole table. Readers see the version before until it is there; of two writers, the later one's rows stay."""
    done = commit(df.sparkSession, table, {0: put(df, table)}, df.schema, whole=True)
    clean(df.sparkSession, table, keep)
    return done


def merge(spark: SparkSession, table: str, buckets: Iterable[int], make: Callable[[int, DataFrame | None], DataFrame], keep: int = 2, tries: int = 20) -> Version | None:
    """Replace each of the buckets by ``make`` of its number and its rows so far (none of a new bucket), all in one version.

    Buckets that another writer has changed meanwhile are made again from its rows.
    """
    made: dict[int, tuple[str | None, str]] = {}  # the folder that was read, the folder that was written
    wanted, schema = sorted(set(buckets)), None
    if not wanted:
        return version(spark, table)
    for _ in range(tries):
        base = version(spark, table)
        for k in wanted:
            before = base.folders.get(k) if base else None
            if k in made and made[k][0] == before:
                continue
            if k in made:
                delete_path(spark, f"{table}/{made[k][1]}")
            rows = make(k, spark.read.schema(base.schema).parquet(f"{table}/{before}") if before else None)
            schema = rows.schema
            made[k] = before, put(rows, table)
        try:
            done = commit(spark, table, {k: f for k, (_, f) in made.items()}, schema, base)
        except Conflict:
            continue
        clean(spark, table, keep)
        return done
    raise Conflict(f"{table} was changed by others {tries} times in a row")


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, which need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(suffix=".zip", prefix=f"{root.name}-")
    os.close(fd)
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)
