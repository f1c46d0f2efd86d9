"""Digests of contents, and hashes of frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 1 << 20


def quick_signature(content: Column, chunk: int = CHUNK) -> Column:
    """MD5 over the first and last chunk; a content of one chunk counts twice."""
    size = F.octet_length(content)
    first = F.substring(content, 1, chunk)
    last = F.when(size > chunk, F.substring(content, size - (chunk - 1), F.lit(chunk))).otherwise(first)
    return F.md5(F.concat(first, last))


def full_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def average_hash(frame: Column) -> Column:
    """One bit for each pixel, 1 from the mean up, first pixel highest; 64 pixels give a signed long."""
    frame = F.transform(frame, lambda v: v.cast("double"))
    mean = F.aggregate(frame, F.lit(0.0), lambda a, v: a + v) / F.size(frame)
    return F.aggregate(frame, F.struct(F.lit(0).cast("long").alias("h"), mean.alias("m")), lambda s, v: F.struct(F.shiftleft(s["h"], 1).bitwiseOR((v >= s["m"]).cast("long")).alias("h"), s["m"].alias("m")))["h"]


def frames_of(raw: Column) -> Column:
    """A decoder's gray bytes as frames of 64 pixels; what is left over at the end is dropped."""
    pixel = lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int")
    whole = F.floor(F.octet_length(raw) / 64).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.greatest(whole - 1, F.lit(0))), lambda f: F.transform(F.sequence(F.lit(1), F.lit(64)), lambda p: pixel(f * 64 + p)))
    return F.when(whole > 0, each).otherwise(F.array().cast("array<array<int>>"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def visual_signature(hashes: Column) -> Column:
    """First, middle and last of the hashes; all of fewer than three; null of none."""
    n = F.size(hashes)
    middle = F.element_at(hashes, F.floor(n / 2).cast("int") + 1)
    return F.when(n >= 3, F.array(F.element_at(hashes, 1), middle, F.element_at(hashes, -1))).when(n > 0, hashes)


def frame_match_percent(a: Column, b: Column, distance: int = 10) -> Column:
    """Frames of a with a near one in b, by the smaller number of frames; may exceed 100."""
    near = F.size(F.filter(a, lambda x: F.exists(b, lambda y: hamming(x, y) <= distance)))
    return near / F.least(F.size(a), F.size(b)) * 100
