"""Durations from the headers of video containers: MP4 and MOV, Matroska and WebM, AVI.

A parser gets a function that reads (offset, n) bytes and the size of the file, and
walks from header to header, so pictures and sound are passed over, wherever the
headers lie. What is cut off, contradicts itself or is another container has no
duration. Seconds are to six places.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable

Read = Callable[[int, int], bytes]
#: Headers that a file may have before it counts as broken.
MOST_HEADERS = 100_000
# Names that files of the ISO format begin with, and ids of Matroska.
ISO_FIRST = (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"pnot")
EBML, SEGMENT, INFO, SCALE, LENGTH = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489


class Broken(ValueError):
    """Headers that can't be followed."""


def duration(read: Read, size: int) -> float | None:
    """Seconds; none of what isn't a whole header of a known container."""
    try:
        start = read(0, min(size, 12))
        if start[4:8] in ISO_FIRST:
            found = _iso(read, size)
        elif start[:4] == EBML.to_bytes(4, "big"):
            found = _matroska(read, size)
        elif start[:4] == b"RIFF" and start[8:12] == b"AVI ":
            found = _avi(read, size)
        else:
            return None
    except (Broken, struct.error):
        return None
    return round(found, 6) if found is not None and math.isfinite(found) and found >= 0 else None


def _boxes(read: Read, at: int, end: int):
    """(name, begin, end) of each box of a range."""
    for _ in range(MOST_HEADERS):
        if at + 8 > end:
            return
        head = read(at, 16)
        n, name = struct.unpack_from(">I4s", head)
        begin = at + 8
        if n == 1:
            n, begin = struct.unpack_from(">Q", head, 8)[0], at + 16
        elif n == 0:
            n = end - at
        if at + n > end or at + n < begin:
            raise Broken("a box ends outside")
        yield name, begin, at + n
        at += n
    raise Broken("too many boxes")


def _versioned(read: Read, at: int, short: str, long: str) -> tuple[int, ...]:
    """Fields after a version and flags."""
    layout = long if read(at, 1) == b"\x01" else short
    return struct.unpack(layout, read(at + 4, struct.calcsize(layout)))


def _iso(read: Read, size: int) -> float | None:
    for name, begin, end in _boxes(read, 0, size):
        if name != b"moov":
            continue
        scale = units = pieces = None
        for child, at, to in _boxes(read, begin, end):
            if child == b"mvhd":
                *_, scale, units = _versioned(read, at, ">IIII", ">QQIQ")
                if units in (0xFFFFFFFF, (1 << 64) - 1):
                    units = 0  # unknown
            elif child == b"mvex":
                for inner, place, _ in _boxes(read, at, to):
                    if inner == b"mehd":
                        (pieces,) = _versioned(read, place, ">I", ">Q")
        return (units or pieces) / scale if scale and (units or pieces) else None
    return None


def _vint(read: Read, at: int, keep: bool) -> tuple[int | None, int]:
    """A number of Matroska and where it ends; none of an unknown size."""
    first = read(at, 1)
    if not first or not first[0]:
        raise Broken("no length")
    n = 9 - first[0].bit_length()
    raw = read(at, n)
    if len(raw) < n:
        raise Broken("cut off")
    value = int.from_bytes(raw, "big")
    if keep:
        return value, at + n
    value &= (1 << 7 * n) - 1
    return None if value == (1 << 7 * n) - 1 else value, at + n


def _elements(read: Read, at: int, end: int):
    """(id, begin, end) of each element; one of unknown size reaches to the end."""
    for _ in range(MOST_HEADERS):
        if at >= end:
            return
        name, at = _vint(read, at, True)
        n, begin = _vint(read, at, False)
        if n is not None and begin + n > end:
            raise Broken("an element ends outside")
        at = end if n is None else begin + n
        yield name, begin, at
    raise Broken("too many elements")


def _matroska(read: Read, size: int) -> float | None:
    for name, begin, end in _elements(read, 0, size):
        if name != SEGMENT:
            continue
        for part, at, to in _elements(read, begin, end):
            if part != INFO:
                continue
            scale, length = 1_000_000, None
            for field, a, b in _elements(read, at, to):
                if field == SCALE:
                    scale = int.from_bytes(read(a, b - a), "big")
                elif field == LENGTH:
                    length = struct.unpack(">f" if b - a == 4 else ">d", read(a, b - a))[0]
            return length * scale / 1e9 if length is not None and scale else None
        return None
    return None


def _chunks(read: Read, at: int, end: int):
    for _ in range(MOST_HEADERS):
        if at + 8 > end:
            return
        name, n = struct.unpack("<4sI", read(at, 8))
        if at + 8 + n > end:
            raise Broken("a chunk ends outside")
        yield name, at + 8, at + 8 + n
        at += 8 + n + n % 2
    raise Broken("too many chunks")


def _avi(read: Read, size: int) -> float | None:
    for name, begin, end in _chunks(read, 12, size):
        if name == b"LIST" and read(begin, 4) == b"hdrl":
            for child, at, to in _chunks(read, begin + 4, end):
                if child == b"avih" and to - at >= 20:
                    micros, *_, frames = struct.unpack("<5I", read(at, 20))
                    return micros * frames / 1e6 if micros and frames else None
    return None
