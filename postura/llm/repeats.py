"""Removal of repeated byte strings, by blockwise suffix sorting with a difference cover.

A byte goes if a WIDTH-byte string over it also starts in a document of a
smaller id.  That needs the suffixes of all documents in order to depth WIDTH,
and never all at once:

1. Texts are joined to blocks of about BLOCK_BYTES, a few of them a row of a
   table dealt by row.
2. Cover sample: suffixes whose place modulo PERIOD is in COVER, a perfect
   difference set.  Any two suffixes are some one shift below PERIOD before a
   sample suffix each, and two equal WIDTH-byte strings then hold the same
   first WIDTH - PERIOD + 1 bytes of sample suffix at that shift.
3. Sieve: sample suffixes whose first bytes nobody else has drop out.  It goes
   by 64-bit names of those bytes; equal bytes have equal names, so no repeat
   is lost, and a false tie costs only work.
4. The sample suffixes left are sorted by their bytes, one suffix bucket (a set
   of first bytes) at a time.  Their order gives each a rank at every depth.
   A suffix some places before a sample suffix is told by the bytes up to it,
   sorted from the right, and by the rank of the sample suffix at the depth
   that is left.  So each suffix of the corpus meets every equal one at their
   common shift, whatever stands between, and equality is that of bytes.

Within a block equal surroundings of a sample suffix are one entry before
anything is shuffled, so a passage in a third of all documents costs a few
entries a block.  Entries travel packed by row and group; answers come back as
a bit for each shift of an entry.  Only one bucket's entries are on disk at a
time.

Defined results: null text: no bytes; null id: later than every id; rows of
one id do not take bytes from each other (ties); ids of any type stay as they
are and go in their own order, those that are no whole numbers by their ranks;
empty texts and tables give empty results; very long texts are
cut into overlapping parts (PART_BYTES) and put together again; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..operators.places import placed
from .common import bounded_batches, discard, release, saved, shared_dir, table, tidy
from .words import encoded, powers

WIDTH = 50
PERIOD = 31
#: Perfect difference set modulo 31: every residue is a difference of two.
COVER = (1, 5, 11, 24, 25, 27)
#: Bytes that a sample suffix may lie behind the suffixes it tells apart.
REACH = PERIOD - 1
BLOCK_BYTES = 1 << 20
#: Bytes of texts in a row of blocks; its entries for a group travel together.
ROW_BYTES = 8 << 20
PART_BYTES = 4 << 20
#: Suffix buckets, sorted one after the other: bounds what is on disk at once.
SAMPLE_PASSES, PASSES = 2, 4
#: Packed entries that one task sorts together.
GROUP_BYTES = 6 << 20
LAST = np.iinfo(np.int64).max
_FIELDS = ("ids", "sizes", "starts", "wholes", "rows")


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, part_bytes: int = PART_BYTES) -> DataFrame:
    """(row, and of each of its blocks ids, sizes, starts, wholes, rows, data): texts joined; long ones in parts that overlap by width - 1 bytes."""

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        n = seen = size = total = 0
        held: list[tuple] = []
        made: list[tuple] = []

        def block():
            *numbers, parts = zip(*held)
            numbers.insert(1, [len(p) for p in parts])
            return (*(np.array(x, np.int64).tobytes() for x in numbers), b"".join(parts))

        def out():
            return pd.DataFrame([{"row": (task << 32) + n} | dict(zip((*_FIELDS, "data"), map(list, zip(*made))))])

        for pdf in batches:
            for name, text in zip(pdf["i"], encoded(pdf["t"])):
                name = LAST if pd.isna(name) else int(name)
                for start in range(0, max(1, len(text) - width + 1), part_bytes):
                    part = text[start : start + part_bytes + width - 1]
                    held.append((name, start, len(text), (task << 32) + seen, part))
                    size += len(part)
                    total += len(part)
                    if size >= BLOCK_BYTES:
                        made.append(block())
                        held, size = [], 0
                    if total >= ROW_BYTES and made:
                        yield out()
                        made, total, n = [], size, n + 1
                seen += 1
        if held:
            made.append(block())
        if made:
            yield out()

    shape = "row long, " + ", ".join(f"{c} array<binary>" for c in (*_FIELDS, "data"))
    return docs.select(F.col(id_col).try_cast("long").cast("string").alias("i"), F.col(text_col).alias("t")).mapInPandas(tidy(joined), shape)


def order_of(names: np.ndarray) -> np.ndarray:
    """Places in ascending order of name: the high bits are sorted with the place in the low ones, five times as fast as argsort."""
    low = np.uint64(max(1, int(len(names)).bit_length()))
    mask = (np.uint64(1) << low) - np.uint64(1)
    packed = np.sort((names & ~mask) | np.arange(len(names), dtype=np.uint64))
    order = (packed & mask).astype(np.int64)
    high = packed & ~mask
    same = np.flatnonzero(high[1:] == high[:-1])
    if len(same) and (names[order[same]] != names[order[same + 1]]).any():  # high bits alone don't tell them apart
        return np.argsort(names, kind="stable")
    return order


def _groups(names: np.ndarray, n: int) -> np.ndarray:
    """Group of each name: names are even, so groups are."""
    return (((names >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


_patterns: dict[int, np.ndarray] = {}


def _cover(phase: int, n: int) -> np.ndarray:
    """Offsets below n, at least, that are in the cover if the first byte's place is phase modulo PERIOD; kept between calls."""
    if phase not in _patterns or _patterns[phase][-1] < n:
        inside = np.sort((np.array(COVER) - phase) % PERIOD)
        _patterns[phase] = (np.arange(n // PERIOD + 2)[:, None] * PERIOD + inside).ravel()
    return _patterns[phase]


class Block:
    """A block's bytes with document and place of each."""

    def __init__(self, row: dict, k: int, width: int):
        self.ids, self.sizes, self.starts, self.wholes, self.rows = (np.frombuffer(row[c][k], np.int64) for c in _FIELDS)
        self.data = np.frombuffer(row["data"][k], np.uint8)
        self.width = width
        self.first = np.cumsum(self.sizes) - self.sizes

    def part(self, at: np.ndarray) -> np.ndarray:
        """Text part of each place."""
        return np.searchsorted(self.first, at, side="right") - 1  # of empty parts the last one starts at a place, and has it

    def sample(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the cover sample with all the depth they need, and their text parts."""
        depth = self.width - REACH
        parts, places = [], []
        for k in np.flatnonzero(self.sizes >= depth).tolist():
            size = int(self.sizes[k])
            offsets = _cover(int(self.starts[k]) % PERIOD, size)
            places.append(offsets[: np.searchsorted(offsets, size - depth, side="right")] + self.first[k])
            parts.append(k)
        n = [len(x) for x in places]
        return _joined(places, np.zeros(0, np.int64)), np.repeat(np.array(parts, np.int64), n)

    def sieved(self, buckets: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each bucket: distinct names of its sample suffixes in order, whether two documents have one, their places in that order, name of each place."""
        depth = self.width - REACH
        up, down = powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data + np.uint64(1)) * up[:-1], out=sums[1:])
        every, part = self.sample()
        for bucket in buckets:
            mine = bucket[self.data[every]]
            at, docs = every[mine], self.ids[part[mine]]
            h = _mixed((sums[at + depth] - sums[at]) * down[at])
            order = order_of(h)
            h, at, docs = h[order], at[order], docs[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            first = np.flatnonzero(new)
            more = np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first) if len(first) else np.zeros(0, bool)
            yield h[first], more, at, np.cumsum(new) - 1

    def entries(self, mask: bytes, buckets: list[np.ndarray]) -> Iterator[Entries]:
        """For each bucket the distinct surroundings of its sample suffixes that went through the sieve."""
        padded = np.concatenate([np.zeros(REACH, np.uint8), self.data, np.zeros(self.width, np.uint8)])
        windows = np.lib.stride_tricks.sliding_window_view(padded, REACH + self.width)
        every = np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), count=len(self.data)))
        for bucket in buckets:
            at = every[bucket[self.data[every]]]
            p = self.part(at)
            before = np.minimum(at - self.first[p], REACH).astype(np.uint8)
            after = np.minimum(self.first[p] + self.sizes[p] - at, self.width).astype(np.uint8)
            around, docs = windows[at], self.ids[p]
            order = order_of(_names(around) ^ (before.astype(np.uint64) << np.uint64(8) ^ after))
            at, before, after, around, docs = at[order], before[order], after[order], around[order], docs[order]
            new = np.ones(len(at), bool)
            # names only bring likely equals side by side
            new[1:] = (around[1:] != around[:-1]).any(axis=1) | (before[1:] != before[:-1]) | (after[1:] != after[:-1])
            first = np.flatnonzero(new)
            least = np.minimum.reduceat(docs, first) if len(first) else docs
            own = around[first]
            names = _names(own[:, REACH : self.width])
            yield Entries(own, np.stack([before[first], after[first]], axis=1), least, names, at, np.cumsum(new) - 1, docs)


class Entries(NamedTuple):
    """Distinct surroundings, bytes before and after in the same text, least document and name of the first bytes of each; all places, with entry and document of each."""

    around: np.ndarray
    room: np.ndarray
    least: np.ndarray
    names: np.ndarray
    at: np.ndarray
    entry: np.ndarray
    docs: np.ndarray


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _names(rows: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row of bytes."""
    words = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    words[:, : rows.shape[1]] = rows
    h = np.zeros(len(rows), np.uint64)
    for column in words.view(np.uint64).T:
        h = _mixed(h + column)
    return h


def _blocks_of(row: dict, width: int) -> Iterator[Block]:
    for k in range(len(row["data"])):
        yield Block(row, k, width)


def _byte_counts(dealt: DataFrame) -> dict[int, int]:
    """Number of each byte in all texts."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(256, np.int64)
        for pdf in batches:
            for parts in pdf["data"]:
                for data in parts:
                    total += np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        yield pd.DataFrame({"byte": np.arange(256), "c": total})

    return {r["byte"]: r["c"] for r in dealt.select("data").mapInPandas(tidy(counted), "byte int, c long").groupBy("byte").agg(F.sum("c").alias("c")).collect()}


def _buckets(counts: dict[int, int], n: int) -> list[np.ndarray]:
    """n sets of first bytes (as tables) with about as many suffixes each."""
    load, sets = [0] * n, [np.zeros(256, bool) for _ in range(n)]
    for byte in sorted(range(256), key=lambda b: -counts.get(b, 0)):
        k = load.index(min(load))
        load[k] += counts.get(byte, 0)
        sets[k][byte] = True
    return sets


def _dealt_out(group: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of entries by group, first of each group (and the end), groups that have some."""
    order = np.argsort(group, kind="stable")
    cut = np.searchsorted(group[order], np.arange(n_groups + 1))
    return order, cut, np.flatnonzero(np.diff(cut))


def _answered(answers, k: int, group: np.ndarray, n_groups: int, kind) -> np.ndarray:
    """Answers of bucket k to all entries of a row; kind: of one answer (bool: a bit)."""
    order, cut, _ = _dealt_out(group, n_groups)
    out = np.zeros(len(group), kind)
    for a in answers if answers is not None else ():
        if a["k"] == k:
            g = a["g"]
            n = cut[g + 1] - cut[g]
            got = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=n) if kind is bool else np.frombuffer(a["bits"], kind)
            out[order[cut[g] : cut[g + 1]]] = got
    return out


def _answers(found: DataFrame) -> DataFrame:
    """All answers to a row."""
    return found.groupBy("row").agg(F.collect_list(F.struct("k", "g", "bits")).alias("answers"))


def _joined(parts: list[np.ndarray], empty) -> np.ndarray:
    return np.concatenate(parts) if parts else empty


def _sieve_bucket(dealt: DataFrame, bucket: np.ndarray, k: int, n_groups: int, width: int) -> DataFrame:
    """(row, k, g, bits): which names of a bucket's sample suffixes other blocks have too."""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                names = _joined([next(b.sieved([bucket]))[0] for b in _blocks_of(row, width)], np.zeros(0, np.uint64))
                order, cut, live = _dealt_out(_groups(names, n_groups), n_groups)
                names = names[order]
                yield pd.DataFrame({"row": row["row"], "g": live, "names": [names[cut[g] : cut[g + 1]].tobytes() for g in live]})

    def tied(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, np.uint64) for x in pdf["names"]]
        ordered = np.sort(np.concatenate(parts))
        again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])  # in two blocks
        out = pdf[["row", "g"]].copy()
        out["bits"] = [np.packbits(_among(x, again)).tobytes() for x in parts]
        return out

    packed = dealt.mapInPandas(tidy(entries), "row long, g int, names binary")
    return packed.groupBy("g").applyInPandas(tied, "row long, g int, bits binary").select("row", F.lit(k).alias("k"), "g", "bits")


def _among(x: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == x


def _masks(dealt: DataFrame, ties: DataFrame, buckets: list[np.ndarray], n_groups: int, width: int) -> DataFrame:
    """(row, masks): per block a bit for each place with a sample suffix that went through the sieve."""

    def masked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                on = [np.zeros(len(data), bool) for data in row["data"]]
                for k, found in enumerate(zip(*[list(b.sieved(buckets)) for b in _blocks_of(row, width)])):
                    tie = _answered(row["answers"], k, _groups(np.concatenate([f[0] for f in found]), n_groups), n_groups, bool)
                    first = 0
                    for mask, (names, more, at, entry) in zip(on, found):
                        mask[at[(tie[first : first + len(names)] | more)[entry]]] = True
                        first += len(names)
                yield pd.DataFrame([{"row": row["row"], "masks": [np.packbits(m).tobytes() for m in on]}])

    return dealt.join(_answers(ties), "row", "left").mapInPandas(tidy(masked), "row long, masks array<binary>")


def ranked(around: np.ndarray, before: np.ndarray, after: np.ndarray, docs: np.ndarray, width: int) -> np.ndarray:
    """A bit for each shift of each entry: its string that starts so many bytes before the sample suffix also starts in a smaller document of another entry.

    Sample suffixes are sorted by their bytes and the bytes before them from
    the right; with the common prefixes of neighbours that gives ranks at
    every depth.  A string is the pair of both ranks.
    """
    n = len(docs)
    order = np.argsort(np.ascontiguousarray(around[:, REACH:]).view(f"S{width}").ravel(), kind="stable")
    around, before, after, docs = around[order], before[order], after[order], docs[order]
    left = np.ascontiguousarray(around[:, REACH - 1 :: -1])
    back = np.argsort(left.view(f"S{REACH}").ravel(), kind="stable")

    def common(rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        apart = rows[1:] != rows[:-1]
        out[1:] = np.where(apart.any(axis=1), apart.argmax(axis=1), rows.shape[1])
        return out

    right_common, left_common = common(around[:, REACH:]), common(left[back])
    bits = np.zeros(n, np.uint32)
    low = np.uint64(n.bit_length())
    rank = np.empty(n, np.int64)
    for shift in range(PERIOD):
        depth = width - shift
        several = right_common >= depth
        several[:-1] |= several[1:]
        live = np.flatnonzero(several & (before >= shift) & (after >= depth))
        if len(live) < 2:
            continue
        rank[back] = np.cumsum(left_common < shift)
        key = (np.cumsum(right_common < depth)[live].astype(np.uint64) << low) | rank[live].astype(np.uint64)
        if 3 * int(low) <= 64:
            packed = np.sort((key << low) | np.arange(len(live), dtype=np.uint64))
            key, at = packed >> low, live[(packed & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)]
        else:
            by = np.argsort(key, kind="stable")
            key, at = key[by], live[by]
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        own = docs[at]
        least = np.minimum.reduceat(own, np.flatnonzero(new))
        bits[at[own > least[np.cumsum(new) - 1]]] |= np.uint32(1 << shift)
    out = np.empty(n, np.uint32)
    out[order] = bits
    return out


def _sorted_bucket(masked: DataFrame, bucket: np.ndarray, k: int, n_groups: int, width: int) -> DataFrame:
    """(row, k, g, bits): the answers of ranked() to the entries of a bucket."""
    size = REACH + width

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                found = [next(b.entries(mask, [bucket]))[:4] for b, mask in zip(_blocks_of(row, width), row["masks"])]
                around, room, least, names = (np.concatenate(x) for x in zip(*found))
                order, cut, live = _dealt_out(_groups(names, n_groups), n_groups)
                around, room, least = around[order], room[order], least[order]
                part = lambda x: [x[cut[g] : cut[g + 1]].tobytes() for g in live]  # noqa: E731, B023
                yield pd.DataFrame({"row": row["row"], "g": live, "around": part(around), "room": part(room), "docs": part(least)})

    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        around = np.frombuffer(b"".join(pdf["around"]), np.uint8).reshape(-1, size)
        room = np.frombuffer(b"".join(pdf["room"]), np.uint8).reshape(-1, 2)
        docs = np.frombuffer(b"".join(pdf["docs"]), np.int64)
        bits = ranked(around, room[:, 0], room[:, 1], docs, width)
        out = pdf[["row", "g"]].copy()
        ends = np.cumsum([len(x) // 8 for x in pdf["docs"]])
        out["bits"] = [x.tobytes() for x in np.split(bits, ends[:-1])]
        return out

    packed = masked.mapInPandas(tidy(entries), "row long, g int, around binary, room binary, docs binary")
    return packed.groupBy("g").applyInPandas(sort, "row long, g int, bits binary").select("row", F.lit(k).alias("k"), "g", "bits")


_DIGEST = "row long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, start long, data binary, marks binary"


def _digest(data: np.ndarray, marks: np.ndarray, width: int) -> tuple[int, int, str]:
    """(bytes removed, spans, hash of the rest) of a whole text whose marked strings go."""
    at = np.flatnonzero(marks)
    if not len(at):
        return 0, 0, hashlib.sha256(data.tobytes()).hexdigest()
    delta = np.zeros(len(data) + 1, np.int32)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + width, -1)
    gone = np.cumsum(delta[:-1]) > 0
    return int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()), hashlib.sha256(data[~gone].tobytes()).hexdigest()


def _marked(masked: DataFrame, found: DataFrame, buckets: list[np.ndarray], n_groups: int, width: int) -> DataFrame:
    """Digest of each text in one part; of others the parts with a bit for each string to remove."""

    def marks_of(row: dict) -> list[np.ndarray]:
        marks = [np.zeros(len(data), bool) for data in row["data"]]
        all_blocks = [[e._replace(around=None) for e in b.entries(mask, buckets)] for b, mask in zip(_blocks_of(row, width), row["masks"])]
        for k, held in enumerate(zip(*all_blocks)):
            bits = _answered(row["answers"], k, _groups(np.concatenate([e.names for e in held]), n_groups), n_groups, np.uint32)
            first = 0
            for own, e in zip(marks, held):
                mine, later = bits[first : first + len(e.names)][e.entry], e.docs > e.least[e.entry]
                before, after = e.room[e.entry, 0], e.room[e.entry, 1]
                for shift in range(PERIOD):  # a later document of a block has all strings of the surroundings from the first
                    on = ((mine >> np.uint32(shift)) & np.uint32(1)).astype(bool) | (later & (before >= shift) & (after >= width - shift))
                    own[e.at[on] - shift] = True
                first += len(e.names)
        return marks

    def removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                for k, marks in enumerate(marks_of(row)):
                    ids, sizes, starts, wholes, rows = (np.frombuffer(row[c][k], np.int64) for c in _FIELDS)
                    whole = np.frombuffer(row["data"][k], np.uint8)
                    out = []
                    for i, (first, size) in enumerate(zip(np.cumsum(sizes) - sizes, sizes)):
                        data, own = whole[first : first + size], marks[first : first + size]
                        name = None if ids[i] == LAST else int(ids[i])
                        if size == wholes[i]:
                            n, spans, rest = _digest(data, own, width)
                            out.append((int(rows[i]), name, int(size), n, spans, rest, None, None, None))
                        else:
                            out.append((int(rows[i]), name, int(wholes[i]), None, None, None, int(starts[i]), data.tobytes(), np.packbits(own).tobytes()))
                    frame = pd.DataFrame(out, columns=[x.split()[0] for x in _DIGEST.split(", ")], dtype=object)
                    yield frame.astype({c: "Int64" for c in ("row", "doc_id", "n_bytes", "n_removed", "n_spans", "start")})

    return masked.join(_answers(found), "row", "left").mapInPandas(tidy(removed), _DIGEST)


def _whole(width: int):
    def put_together(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        n = int(pdf["n_bytes"].iloc[0])
        data, marks = np.zeros(n, np.uint8), np.zeros(n, bool)
        for start, part, bits in zip(pdf["start"], pdf["data"], pdf["marks"]):
            start = int(start)
            data[start : start + len(part)] = np.frombuffer(part, np.uint8)
            marks[start : start + len(part)] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(part)).astype(bool)
        gone, spans, rest = _digest(data, marks, width)
        return pd.DataFrame({"row": pdf["row"].iloc[:1], "n_bytes": [n], "n_removed": [gone], "n_spans": [spans], "kept_sha256": [rest]})

    return put_together


def without_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    if not REACH < width < 256:
        raise ValueError(f"width must be from {PERIOD} to 255")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        return _of_whole_ids(docs, width, part_bytes).withColumnRenamed("doc_id", id_col)
    # a rank each distinct id; texts meet them once
    ids = docs.select("doc_id").filter("doc_id is not null").distinct().withColumn("_one", F.lit(0))
    ranks = saved(placed(ids, "_one", ["doc_id"], name="rank").select("doc_id", "rank"), "ranks")
    found = _of_whole_ids(docs.join(ranks, "doc_id", "left").select(F.col("rank").alias("doc_id"), "text"), width, part_bytes)
    return found.withColumnRenamed("doc_id", "rank").join(ranks, "rank", "left").select(F.col("doc_id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _of_whole_ids(docs: DataFrame, width: int, part_bytes: int) -> DataFrame:
    """without_repeats of (doc_id, text) with whole numbers as ids."""
    spark = docs.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"blocks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    try:
        with bounded_batches(spark):
            # dealt by row once: later joins with small tables by row move no text
            blocks(docs, "doc_id", "text", width, part_bytes).repartition(n_parts, "row").write.bucketBy(n_parts, "row").option("compression", "zstd").option("path", path).saveAsTable(name)
            dealt = spark.table(name)
            release(spark)
            counts = _byte_counts(dealt)
            total = sum(counts.values())
            samples, buckets = _buckets(counts, SAMPLE_PASSES), _buckets(counts, PASSES)

            n_sample = max(1, -(-total * len(COVER) * 8 // (PERIOD * SAMPLE_PASSES * GROUP_BYTES)))
            ties = None
            for k, bucket in enumerate(samples):
                part = saved(_sieve_bucket(dealt, bucket, k, n_sample, width), "ties")
                ties = part if ties is None else ties.unionByName(part)
                release(spark)
            masks = saved(_masks(dealt, ties, samples, n_sample, width), "masks")
            release(spark)

            # a share of the sample goes through the sieve
            n_groups = max(1, -(-total * len(COVER) * (REACH + width + 10) // (3 * PERIOD * PASSES * GROUP_BYTES)))
            masked = dealt.join(masks, "row")
            found = None
            for k, bucket in enumerate(buckets):
                part = saved(_sorted_bucket(masked, bucket, k, n_groups, width), "later")
                found = part if found is None else found.unionByName(part)
                release(spark)
            rows = saved(_marked(masked, found, buckets, n_groups, width), "marked")
    finally:
        discard(spark, name, path)
    out = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    long = rows.filter("data is not null")
    names = long.groupBy("row").agg(F.max("doc_id").alias("doc_id"))
    parts = long.select("row", "n_bytes", "start", "data", "marks").groupBy("row").applyInPandas(_whole(width), "row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return rows.filter("data is null").select(out).unionByName(parts.join(names, "row").select(out))


def op8_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents without the strings of 50 bytes that start in an earlier one."""
    return without_repeats(table(spark, sf_dir, "documents"))
