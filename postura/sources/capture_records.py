"""Record structure of packet captures over bytes that are read piece by piece.

A capture is walked from a record's start to a place where another starts.
Where a walk may begin in the middle of a file is found by `boundary`: a chain
of records that look right for longer than any record may be.  Such a chain has
left whatever payload it may have begun in, so the record reached is a true
one; and the walk that comes from before has to land exactly there, which is
checked.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

#: First bytes of the classic format -> (byte order, parts of a second).
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
# Kinds of blocks and the least length of each, and the marks of a section's byte order.
SECTION, INTERFACE, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 3, 6
LEAST = {SECTION: 28, INTERFACE: 20, SIMPLE: 16, ENHANCED: 32}
SECTION_START = b"\x0a\x0d\x0d\x0a"
ORDERS = {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}
MICROSECONDS = 10**6
#: Longest record that a chain is tried on, and days its times may lie from the first one's.
LONGEST, DAYS = 1 << 18, 3660


class Held:
    """Bytes that are all here."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read(self, at: int, n: int) -> bytes:
        return self.data[at : at + n]


class Paged:
    """Bytes of an open file, read a piece at a time; one piece is held."""

    def __init__(self, file, size: int, piece: int = 4 << 20):
        self.file, self.size, self.piece, self.at, self.held = file, size, piece, 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not self.at <= at <= at + n <= self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(max(0, min(max(n, self.piece), self.size - at)))
        return self.held[at - self.at : at - self.at + n]


@dataclass
class Layout:
    """What the head of a file says, and what its sections have said so far."""

    classic: bool
    order: str
    unit: int
    first: int
    links: list[tuple[bool, int]] = field(default_factory=list)  # of each interface: Ethernet or not, units of a second
    seconds: int = 0  # of the first record of a classic capture


def layout(data) -> Layout:
    """The head of a capture; ValueError if it is none, or none of Ethernet frames."""
    head = data.read(0, 28)
    if head[:4] in MAGIC:
        order, unit = MAGIC[head[:4]]
        if len(head) >= 24 and struct.unpack_from(order + "I", head, 20)[0] & 0xFFFF != 1:
            raise ValueError("not an Ethernet capture")
        return Layout(True, order, unit, 24, seconds=struct.unpack_from(order + "I", head, 24)[0] if len(head) == 28 else 0)
    if head[:4] == SECTION_START:
        return Layout(False, ORDERS.get(head[8:12], "<"), MICROSECONDS, 0)
    raise ValueError("not a capture")


def resolution(options: bytes, order: str) -> int:
    """Units of a second that an interface's options state."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "HH", options, at)
        if code == 0:
            break
        if code == 9 and size >= 1 and at + 4 < len(options):
            x = options[at + 4]
            return MICROSECONDS if x & 127 > 30 else 2 ** (x & 127) if x & 128 else 10**x
        at += 4 + size + -size % 4
    return MICROSECONDS


@dataclass
class Walk:
    """What a walk has met: where it stands, whether it ended at damage, and the heads it passed."""

    at: int
    damaged: bool = False
    heads: list[int] = field(default_factory=list)


def walk(data, shape: Layout, at: int, stop: int, told: Walk) -> Iterator[tuple[int, float | None, int, int, int]]:
    """(record's place, milliseconds, original length, place of the frame, its length) of packets whose records start before stop.

    A frame that is not Ethernet has length 0.  told is kept up to date.
    """
    return (_classic if shape.classic else _blocks)(data, shape, at, stop, told)


def _classic(data, shape: Layout, at: int, stop: int, told: Walk):
    head = struct.Struct(shape.order + "IIII")
    told.damaged = data.size < shape.first
    while at < stop and not told.damaged:
        told.at = at
        if at + 16 > data.size:
            told.damaged = True
            return
        s, part, kept, whole = head.unpack(data.read(at, 16))
        if kept > data.size - at - 16 or kept > 0x7FFFFFFF:
            told.damaged = True
            return
        told.at = at + 16 + kept
        yield at, s * 1000 + part * 1000 / shape.unit, whole or kept, at + 16, kept
        at = told.at


def _blocks(data, shape: Layout, at: int, stop: int, told: Walk):
    while at < stop:
        told.at = at
        head = data.read(at, 12)
        if len(head) < 12:
            told.damaged = True
            return
        section = head[:4] == SECTION_START
        if section:
            if head[8:12] not in ORDERS:
                told.damaged = True
                return
            shape.order, shape.links = ORDERS[head[8:12]], []
        kind, size = struct.unpack_from(shape.order + "II", head)
        if size < max(12, LEAST.get(kind, 0)) or size % 4 or at + size > data.size:
            told.damaged = True
            return
        told.at = at + size
        if section or kind == INTERFACE:
            told.heads.append(at)
        if kind == INTERFACE:
            body = data.read(at, size)
            shape.links.append((struct.unpack_from(shape.order + "H", body, 8)[0] == 1, resolution(body[16:-4], shape.order)))
        elif kind == ENHANCED:
            link, high, low, kept, whole = struct.unpack_from(shape.order + "IIIII", data.read(at + 8, 20))
            ethernet, unit = shape.links[link] if link < len(shape.links) else (True, MICROSECONDS)
            if kept <= size - 28 and at + 28 + kept <= data.size:
                yield at, float((high << 32 | low) * 1000 // unit), whole, at + 28, kept if ethernet else 0
        elif kind == SIMPLE:
            whole = struct.unpack(shape.order + "I", data.read(at + 8, 4))[0]
            yield at, None, whole, at + 12, min(whole, size - 16)
        at += size


def boundary(data, shape: Layout, near: int, cover: int = LONGEST) -> int | None:
    """A record's start some way after near, the same for whoever asks; None if no chain of records is found.

    cover: bytes that a chain has to run; it should be no less than the longest record.
    """
    stride = 1 if shape.classic else 4
    start = max(shape.first, near + -near % stride)
    for at in range(start, min(start + cover + 16, data.size), stride):
        here, rest = at, None
        while here is not None and here < at + cover:
            here, rest = (_next_classic if shape.classic else _next_block)(data, shape, here, cover), here
        if here is not None and here > rest:
            return here
    return None


def _next_classic(data, shape: Layout, at: int, cover: int) -> int | None:
    """Place after a record that looks right."""
    if at + 16 > data.size:
        return None
    s, part, kept, whole = struct.unpack(shape.order + "IIII", data.read(at, 16))
    if part >= shape.unit or kept > cover or (whole and kept > whole) or at + 16 + kept > data.size:
        return None
    return at + 16 + kept if abs(s - shape.seconds) < DAYS * 86400 else None


def _next_block(data, shape: Layout, at: int, cover: int) -> int | None:
    head = data.read(at, 12)
    if len(head) < 12:
        return None
    order = ORDERS.get(head[8:12]) if head[:4] == SECTION_START else shape.order
    if order is None:
        return None
    size = struct.unpack_from(order + "I", head, 4)[0]
    if size < 12 or size % 4 or size > max(cover, 64) or at + size > data.size:
        return None
    return at + size if data.read(at + size - 4, 4) == head[4:8] else None
