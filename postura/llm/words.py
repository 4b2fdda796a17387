"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a run of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z are lower-cased:
digits, a-z and every byte of a character beyond ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE_BYTES = 2 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_P = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(h: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit value of each 64-bit value."""
    h = h.copy()
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(by)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n, kept between calls."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


def slices(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of about limit."""
    first = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= limit:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def encoded(texts) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


class Words:
    """Words of a slice of texts: places in the joined bytes, 64-bit names, and counts by text."""

    def __init__(self, raw: list[bytes]):
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.buf = _LOWER[np.frombuffer(b"\n".join([*raw, b""]), np.uint8)]
        inside = _IN_WORD[self.buf]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
        self.start, self.end = edge[::2], edge[1::2]
        text_end = np.cumsum(sizes + 1)
        self.first = np.searchsorted(self.start, np.concatenate([[0], text_end]))  # first word of each text
        self.counts = np.diff(self.first)
        up, down = powers(len(self.buf) + 1)
        sums = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        self.name = mixed((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def text(self, k: int) -> bytes:
        return self.buf[self.start[k] : self.end[k]].tobytes()
