"""One JSON file with an array of all rows, as a data source that is written to.

Tasks write their rows as parts beside the target; the commit joins the parts in
the order of the partitions, piece by piece, and puts the file in place at once. A
task that is run again leaves a part that no commit names; an aborted write
leaves the file that was there. The file is one, as the format asks: what is
exported so passes one disk, though never one memory. Folders are local or
mounted ones, as for listings.

Compressed, it is one gzip file of many members, which any program can unpack.
Each holds whole rows and has its own length in the extra field of its header, so
readers step from member to member and unpack them by many tasks.
"""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from simigraph import store
from simigraph.sources.ranged import local

#: Characters of a member's text before it is packed, members that a task reads, and the level of zlib.
MEMBER_CHARS, TASK_MEMBERS, LEVEL = 4 << 20, 8, 4
#: A member's header: magic, method, flag of an extra field, time, flags, system, length of the field, its name and length, length of the member.
HEADER = struct.Struct("<2sBBIBBH2sHI")
_START = b"\x1f\x8b", 8, 4, 0, 0, 255, 8, b"SG", 4


def _member(text: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = z.compress(text) + z.flush()
    return HEADER.pack(*_START, HEADER.size + len(body) + 8) + body + struct.pack("<II", zlib.crc32(text), len(text))


def _members(path: str) -> Iterator[tuple[int, int]]:
    """Offset and length of each member; only headers are read."""
    with open(path, "rb", buffering=0) as f:
        at, end = 0, f.seek(0, os.SEEK_END)
        while at < end:
            f.seek(at)
            head = f.read(HEADER.size)
            fields = HEADER.unpack(head) if len(head) == HEADER.size else ()
            if fields[:-1] != _START or at + fields[-1] > end:
                raise ValueError(f"{path} isn't packed by members that have their lengths")
            yield at, fields[-1]
            at += fields[-1]


def _plain(text: bytes) -> bytes:
    return text


_flat = json.JSONEncoder(ensure_ascii=False, default=str).encode
_deep = json.JSONEncoder(ensure_ascii=False, default=str, indent=2).encode


def _values(column: pa.Array) -> list:
    """As ``to_pylist``, which is slow."""
    kind = column.type
    if pa.types.is_string(kind) or ((pa.types.is_integer(kind) or pa.types.is_floating(kind)) and not column.null_count):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _texts(column: pa.Array) -> list[str]:
    """The values of a column of rows as JSON; what is nested is written once for all that are equal."""
    if not pa.types.is_nested(column.type):
        return list(map(_flat, _values(column)))
    if pa.types.is_map(column.type):
        keys, items, ends = _values(column.keys), _values(column.items), column.offsets.to_numpy().tolist()
        there = column.is_valid().to_numpy(zero_copy_only=False).tolist()
        values = [dict(zip(keys[i:j], items[i:j], strict=True)) if t else None for t, i, j in zip(there, ends, ends[1:], strict=False)]
    else:
        values = column.to_pylist()
    known: dict[str, str] = {}
    texts = []
    for v in values:
        told = repr(v)
        if told not in known:
            known[told] = _deep(v).replace("\n", "\n  ")
        texts.append(known[told])
    return texts


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str
    rows: int


class JsonArrayWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool, compression: str):
        if compression not in ("none", "gzip"):
            raise ValueError(f"unknown compression {compression}")
        self.path, self.overwrite = path, overwrite
        self.pack: Callable[[bytes], bytes] = _member if compression == "gzip" else _plain
        self.row = "{\n" + ",\n".join(f"  {_flat(c).replace('%', '%%')}: %s" for c in schema.names) + "\n}"
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        number = TaskContext.get().partitionId()
        name, n = f"{self.path}.{self.run}-{number}-{uuid.uuid4().hex}.part", 0
        os.makedirs(os.path.dirname(name), exist_ok=True)
        held, size = [], 0
        with open(name, "wb") as f:
            for batch in iterator:
                for row in zip(*map(_texts, batch.columns), strict=True):
                    held.append((",\n" if n else "") + self.row % row)
                    n, size = n + 1, size + len(held[-1])
                    if size >= MEMBER_CHARS:
                        f.write(self.pack("".join(held).encode()))
                        held, size = [], 0
            if held:
                f.write(self.pack("".join(held).encode()))
        return Part(number, name, n)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        if os.path.exists(self.path) and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.path)
        draft = f"{self.path}.{self.run}.whole"
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        with open(draft, "wb") as out:
            out.write(self.pack(b"[\n"))
            for k, p in enumerate(q for q in parts if q.rows):
                out.write(self.pack(b",\n") if k else b"")
                with open(p.path, "rb") as f:
                    shutil.copyfileobj(f, out, 1 << 20)
                os.remove(p.path)  # so that the disk never holds all rows twice
            out.write(self.pack(b"\n]\n"))
        os.replace(draft, self.path)
        self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        """Delete the parts."""
        for m in messages:
            if m is not None:
                with contextlib.suppress(OSError):
                    os.remove(m.path)


@dataclass
class Members(InputPartition):
    found: list[tuple[int, int]]


class JsonArrayReader(DataSourceReader):
    """The rows' texts of a compressed file."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> Sequence[Members]:
        found = list(_members(self.path))
        return [Members(found[k : k + TASK_MEMBERS]) for k in range(0, len(found), TASK_MEMBERS)]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        with open(self.path, "rb") as f:
            for at, n in partition.found:
                f.seek(at)
                # Rows begin and end with braces; the array's own signs are around them.
                text = zlib.decompress(f.read(n), zlib.MAX_WBITS | 16).decode().strip("[],\n")
                if text:
                    rows = text.removesuffix("\n}").split("\n},\n")
                    yield pa.RecordBatch.from_arrays([pa.array([r + "\n}" for r in rows], pa.string())], ["row"])


class JsonArray(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_array"

    def schema(self) -> str:
        return "row string"

    def reader(self, schema: StructType) -> JsonArrayReader:
        return JsonArrayReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> JsonArrayWriter:
        return JsonArrayWriter(self.options["path"], schema, overwrite, self.options.get("compression", "none"))


def _registered(spark: SparkSession, path: str) -> str:
    plain = local(path)
    if plain is None:
        raise ValueError("the file lies in a local or mounted folder")
    store.ship(spark)
    spark.dataSource.register(JsonArray)
    return plain


def write(rows: DataFrame, path: str, overwrite: bool = True, compression: str = "none") -> None:
    """All rows as one file of that name; maps become objects. ``compression`` is none or gzip, a twentieth of the disk or so for matches."""
    plain = _registered(rows.sparkSession, path)
    rows.write.format("json_array").mode("overwrite" if overwrite else "append").option("compression", compression).save(plain)


def read(spark: SparkSession, path: str, schema: str, compression: str = "none") -> DataFrame:
    """Rows of a file that ``write`` made, by as many tasks as it has splits.

    Strings hold no raw line break and what is nested is indented, so the text between two rows is nowhere else.
    """
    if compression == "gzip":
        rows = spark.read.format("json_array").load(_registered(spark, path))
    else:
        text = spark.read.option("lineSep", "\n},\n").text(path).select(F.regexp_replace("value", r"\A\[\n|\n\}\n\]\n?\z", "").alias("row"))
        rows = text.where(F.col("row").startswith("{")).select(F.concat("row", F.lit("\n}")).alias("row"))
    return rows.select(F.from_json("row", schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")
