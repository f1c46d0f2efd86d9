"""Files read where they lie: listings by folder, and only the bytes that are asked for.

``RangedFiles`` is a data source of listings. The driver lists folders only, a
task the files of some of them, or a share of them where folders are dealt to
several tasks; with ``ends``, it reads the first and the last bytes of each. Filters on
path, size and extension are taken into the listing, so files that they leave out
are never opened. ``signatures``, ``digests`` and ``durations`` read files of a
table of paths, which is dealt out by what there is to read, so candidates alone
are opened: a signature reads two chunks, a digest a file in chunks, a duration
the headers around it. No content is ever held whole or shuffled.

Paths are local ones or those of a store that Arrow opens (``s3://``, ``gs://``,
``hdfs://``). A file that is gone or can't be read has null in place of what was
to be read, and no listing.
"""

from __future__ import annotations

import contextlib
import hashlib
import itertools
import os
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from pathlib import PurePosixPath
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from simigraph import store
from simigraph.functions.digests import CHUNK
from simigraph.sources import containers

LISTING = "path string, extension string, size long, mtime double, first binary, last binary, bytes_read long"
#: Levels of folders that the driver lists, files and bytes of a batch, bytes that a task reads on average.
LEVELS, BATCH_FILES, BATCH_BYTES, TASK_BYTES = 2, 1000, 16 << 20, 128 << 20


def local(path: str) -> str | None:
    """The path as the file system knows it; none of another store's."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


def open_file(path: str) -> BinaryIO:
    if (plain := local(path)) is not None:
        return open(plain, "rb", buffering=0)
    from pyarrow import fs

    files, name = fs.FileSystem.from_uri(path)
    return files.open_input_file(name)


class Ranged:
    """Reads pieces of a file and counts their bytes."""

    def __init__(self, file: BinaryIO):
        self.file, self.bytes_read = file, 0
        self.size = file.seek(0, os.SEEK_END)

    def read(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        out = b""
        while len(out) < n and (more := self.file.read(n - len(out))):
            out += more
        self.bytes_read += len(out)
        return out

    def ends(self, chunk: int) -> tuple[bytes, bytes]:
        """First and last chunk; of a file of one chunk the first is both."""
        first = self.read(0, min(chunk, self.size))
        return first, self.read(self.size - chunk, chunk) if self.size > chunk else first


@dataclass
class Folders(InputPartition):
    """Folders, each with whether what lies deeper is read too; of their files one share."""

    folders: list[tuple[str, bool]]
    share: int


_COMPARE: dict[type, Callable[[Any, Any], bool]] = {
    EqualTo: lambda v, x: v == x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x,
    In: lambda v, x: v in x, StringStartsWith: lambda v, x: v.startswith(x), StringEndsWith: lambda v, x: v.endswith(x), StringContains: lambda v, x: x in v,
}


class RangedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.roots = options["roots"].split("\n")
        self.recurse = options.get("recurse", "true").lower() == "true"
        self.ends, self.shares = int(options.get("ends", "0")), int(options.get("shares", "1"))
        self.tasks = int(options.get("tasks", "64"))
        self.tests: list[tuple[str, type, Any]] = []

    def partitions(self) -> Sequence[Folders]:
        found: list[tuple[str, bool]] = []
        level = list(self.roots)
        for _ in range(LEVELS if self.recurse else 0):
            found += [(p, False) for p in level]
            level = [e.path for p in level for e in _entries(p) if e.is_dir(follow_symlinks=False)]
        found += [(p, self.recurse) for p in level]
        groups = [g for k in range(self.tasks) if (g := found[k :: self.tasks])]
        return [Folders(g, k) for g in groups for k in range(self.shares)]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for path in itertools.chain.from_iterable(_files(*f) for f in partition.folders):
            if zlib.crc32(path.encode("utf-8", "surrogateescape")) % self.shares != partition.share:
                continue
            row = self._row(path)
            if row is None:
                continue
            rows.append(row)
            held += 2 * self.ends
            if len(rows) >= BATCH_FILES or held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _row(self, path: str) -> tuple | None:
        try:
            info = os.stat(path)
        except OSError:
            return None
        values = {"path": path, "size": info.st_size, "extension": PurePosixPath(path).suffix.lower()}
        if not all(_COMPARE[kind](values[column], wanted) for column, kind, wanted in self.tests):
            return None
        first = last = None
        n = 0
        if self.ends:
            with contextlib.suppress(OSError), open_file(path) as f:
                ranged = Ranged(f)
                first, last = ranged.ends(self.ends)
                n = ranged.bytes_read
        return path, values["extension"], info.st_size, info.st_mtime, first, last, n


class FilteringReader(RangedReader):
    """A listing that takes filters; Spark refuses one that could where sessions don't let filters through."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if type(f) in _COMPARE and column in ("path", "size", "extension"):
                self.tests.append((column, type(f), tuple(f.value) if isinstance(f, In) else f.value))
            else:
                yield f


class RangedFiles(DataSource):
    """Files below local or mounted folders; options: roots (one a line), recurse, ends, tasks, shares, filters."""

    @classmethod
    def name(cls) -> str:
        return "ranged_files"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> RangedReader:
        return (FilteringReader if self.options.get("filters") == "true" else RangedReader)(self.options)


def _entries(folder: str) -> list[os.DirEntry]:
    try:
        with os.scandir(folder) as found:
            return sorted(found, key=lambda e: e.name)
    except OSError:
        return []


def _files(folder: str, deep: bool) -> Iterator[str]:
    for e in _entries(folder):
        if e.is_dir(follow_symlinks=False):
            if deep:
                yield from _files(e.path, True)
        elif e.is_file():
            yield e.path


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.int64())
    names = [c.split()[0] for c in LISTING.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def ranged_files(spark: SparkSession, roots: Sequence[str], recurse: bool = True, ends: int = 0, shares: int = 1) -> DataFrame:
    """Files below the roots: path, extension, size, mtime; with ``ends``, first and last so many bytes.

    ``shares`` deals each folder to so many tasks, for folders with very many files.
    Filters reach the listing where ``spark.sql.python.filterPushdown.enabled`` is set.
    """
    store.ship(spark)
    spark.dataSource.register(RangedFiles)
    plain = [local(r) for r in roots]
    if None in plain:
        raise ValueError("listings are of local or mounted folders; use list_files for other stores")
    filters = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("ranged_files").options(roots="\n".join(plain), recurse=str(recurse).lower(), ends=str(ends), tasks=str(4 * spark.sparkContext.defaultParallelism), shares=str(shares), filters=filters).load()


def spread(files: DataFrame, total: int) -> DataFrame:
    """The rows dealt out by their path to as many tasks as there is to read, so narrow rows don't end up in few tasks."""
    n = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    return files.repartition(n, "path")


def _each(files: DataFrame, name: str, kind: str, make: Callable[[Ranged], Any]) -> DataFrame:
    """The files with what is made of each, and the bytes read for it."""
    arrow = {"string": pa.string(), "double": pa.float64()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, read = [], []
            for path in b.column(b.schema.get_field_index("path")).to_pylist():
                try:
                    with open_file(path) as f:
                        ranged = Ranged(f)
                        made.append(make(ranged))
                        read.append(ranged.bytes_read)
                except OSError:
                    made.append(None)
                    read.append(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, arrow), pa.array(read, pa.int64())], [*b.schema.names, name, "bytes_read"])

    store.ship(files.sparkSession)
    schema = StructType([*files.schema.fields]).add(name, kind).add("bytes_read", "long")
    return files.mapInArrow(run, schema)


def signatures(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(path, size, mtime) with quick, the MD5 over the first and last chunk, and bytes_read."""

    def quick(f: Ranged) -> str:
        first, last = f.ends(chunk)
        return hashlib.md5(first + last).hexdigest()

    n = files.count()
    return _each(spread(files.select("path", "size", "mtime"), n * 2 * chunk), "quick", "string", quick)


def digests(files: DataFrame) -> DataFrame:
    """(path, size, mtime) with sha256, read in chunks, and bytes_read."""

    def sha256(f: Ranged) -> str:
        found, at = hashlib.sha256(), 0
        while piece := f.read(at, CHUNK):
            found.update(piece)
            at += len(piece)
        return found.hexdigest()

    total = files.agg(F.sum("size")).first()[0] or 0
    return _each(spread(files.select("path", "size", "mtime"), total), "sha256", "string", sha256)


def durations(files: DataFrame) -> DataFrame:
    """(path, size, mtime) with duration in seconds from the container's headers, null of others, and bytes_read."""
    n = files.count()
    return _each(spread(files.select("path", "size", "mtime"), n << 12), "duration", "double", lambda f: containers.duration(f.read, f.size))


def write_files(files: DataFrame, root: str) -> int:
    """Each row's content as a file below the root, from (path, content); how many there are. A task that is run again writes the same files."""
    top = local(root)
    if top is None:
        raise ValueError("files are written to local or mounted folders")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                name = os.path.join(top, path.lstrip("/"))
                os.makedirs(os.path.dirname(name), exist_ok=True)
                draft = f"{name}.{os.getpid()}.part"
                with open(draft, "wb") as f:
                    f.write(content or b"")
                os.replace(draft, name)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    store.ship(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
