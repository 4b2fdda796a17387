"""Best-fit packing with large-item matching.

How pieces share sequences depends on lengths alone, and there are at most
`capacity` lengths: the plan is made on the exact length histogram (at most
`capacity` numbers, whatever the corpus) and gives kinds of sequences with
counts.  Pieces longer than a third of the capacity go at most two to a
sequence, by greedy matching (the longest with the longest that still fits);
shorter ones fill the tightest gap, longest first.  Each piece then finds its
place by its rank among the pieces of its length.  Ranks come from counts of
salted groups of some 250 rows; the salt comes from the row's number in the
written table of pieces, so a length, and a row, that a third of all documents
share is spread evenly, however many there are.

Defined results: null text: an empty document, one end token; repeated rows
and ids are packed each; null id stays null; ties: which of the pieces of one
length takes which place goes by the hash of the row's number;
very long texts: whole, their ids take some 50 times their bytes in one task;
empty table: empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.places import placed as placed_in
from .common import fresh, saved, table, texts_of, tidy, with_columns

CAPACITY = 4096
END_ID = 1
#: Rows of one length that are ranked together.
GROUP_ROWS = 250
SLICE_CHARS = 1 << 20
CACHED_CHUNKS = 500_000
#: The normalizing and cutting for which the three rules below hold; texts are encoded as a whole under any other.
KNOWN_CUTTING = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}
#: Texts of these characters alone are cut at white space and encoded chunk by chunk: none of the vocabulary's
#: pretokens holds white space, composition leaves these characters as they are, and they lower-case one by one.
PLAIN = re.compile(r"[\t\n\v\f\r\x20-\x7e¡-¬®-ÿ]*")
#: The vocabulary's pretokens over those characters; each is encoded by itself.
PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
#: The byte alphabet: bytes without a printing character get the next ones from 256 on.
BYTE_LETTERS = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Seen(dict):
    """Chunk -> number; new ones are noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n


class ChunkEncoder:
    """The tokenizer's ids of whole texts; each distinct chunk between white space is encoded once a worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        held = json.loads(self.tokenizer.to_str())
        self.known = all(held[k] == v for k, v in KNOWN_CUTTING.items()) and held["model"]["type"] == "BPE"
        self._reset()

    def _reset(self):
        self.seen, self.words = _Seen(), _Seen()
        self.ids: list[list[int]] = []  # of each word
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)  # of each chunk

    def _learn(self):
        if not self.seen.new:
            return
        number = self.words.__getitem__
        parts = [[number(w) for w in PRETOKEN.findall(c)] for c in self.seen.new]
        model = self.tokenizer.model  # the words need no more normalizing or cutting, only the byte alphabet
        for word in self.words.new:
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(BYTE_LETTERS)
            self.ids.append([t.id for t in model.tokenize(word)])
        ids = self.ids
        got = [ids[p[0]] if len(p) == 1 else [x for w in p for x in ids[w]] for p in parts]
        size = np.fromiter(map(len, got), np.int64, len(got))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, np.fromiter((x for g in got for x in g), np.uint32, int(size.sum()))])
        self.seen.new, self.words.new = [], []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as encode(text, add_special_tokens=False) gives them."""
        if len(self.seen) > CACHED_CHUNKS:
            self._reset()
        plain = [self.known and bool(PLAIN.fullmatch(t)) and not any(s in t for s in self.special) for t in texts]
        at, counts = [], []
        number = self.seen.__getitem__
        for t, p in zip(texts, plain):
            chunks = t.lower().split() if p else []
            at.append(np.fromiter(map(number, chunks), np.int64, len(chunks)))
            counts.append(len(chunks))
        self._learn()
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        size = self.size[at]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        return [
            ids[ends[i] : ends[i + 1]] if p else np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
            for i, p in enumerate(plain)
        ]


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): documents as token ids, longer ones cut at the capacity."""
    path = path or default_path()
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = [t or "" for t in texts_of(batch, "t")]
            first = 0
            while first < len(texts):
                end = total = first
                while end < len(texts) and total < SLICE_CHARS:
                    total, end = total + len(texts[end]) + 1, end + 1
                rows, parts = [], []
                for i, ids in enumerate(own.encode(texts[first:end]), first):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        rows.append((i, k, start, len(part), zlib.crc32(part.tobytes())))
                        parts.append(part.astype(np.int32))
                at, piece, start, length, crc = np.array(rows, np.int64).T
                # the id, of whatever kind, stays as it came
                columns = [batch.column(0).take(pa.array(at)), pa.array(piece.astype(np.int32)), *map(pa.array, (start, length, crc))]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(length)]).astype(np.int32), np.concatenate(parts)))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)
                first = end

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(tidy(cut), schema).withColumnRenamed("doc_id", id_col)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces of it in a sequence, first sequence, offset) of each run of equal sequences."""
    counts = {n: c for n, c in counts.items() if c}
    large = sorted((n for n in counts if 3 * n > capacity), reverse=True)
    left = {n: counts[n] for n in large}
    kinds: list[tuple[list[tuple[int, int]], int]] = []  # closed: ([(length, pieces)], sequences)
    gaps: dict[int, list[list]] = {}  # gap -> [[parts, sequences]]
    order: list[int] = []  # gaps in use, ascending

    def leave(parts, n, gap):
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        gaps[gap].append([parts, n])

    rising = large[::-1]
    for a in large:
        while left[a]:
            at = bisect_left(rising, capacity - a + 1) - 1
            while at >= 0 and (left[rising[at]] < 1 + (rising[at] == a)):
                at -= 1
            if at < 0:
                leave([(a, 1)], left[a], capacity - a)
                left[a] = 0
            else:
                b = rising[at]
                n = left[a] // 2 if a == b else min(left[a], left[b])
                left[a] -= n
                left[b] -= n
                leave([(a, 2)] if a == b else [(a, 1), (b, 1)], n, capacity - a - b)
        rising = [x for x in rising if left[x]]
    for n in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
        c = counts[n]
        while c:
            at = bisect_left(order, n)
            if at == len(order):
                each = capacity // n
                if c >= each:
                    leave([(n, each)], c // each, capacity - each * n)
                if c % each:
                    leave([(n, c % each)], 1, capacity - (c % each) * n)
                break
            gap = order[at]
            parts, m = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            each = min(gap // n, c)
            full = min(m, c // each)
            leave([*parts, (n, each)], full, gap - each * n)
            if m > full:
                leave(parts, m - full, gap)
            c -= full * each
    kinds += [(parts, m) for gap in order for parts, m in gaps[gap]]
    rank: dict[int, int] = dict.fromkeys(counts, 0)
    out, first = [], 0
    for parts, m in kinds:
        offset = 0
        for n, each in parts:
            out.append((n, rank[n], each, first, offset))
            rank[n] += m * each
            offset += n * each
        first += m
    return out


def numbered(pieces: DataFrame, row_col: str) -> DataFrame:
    """pieces as a written table with the number of each row, which then stays."""
    return saved(pieces.withColumn(row_col, F.monotonically_increasing_id()), "pieces")


def salted(pieces: DataFrame, row_col: str, hist: dict[int, int]) -> DataFrame:
    """pieces with salt: groups of some GROUP_ROWS rows of one length."""
    salts = pieces.sparkSession.createDataFrame([(n, -(-c // GROUP_ROWS)) for n, c in hist.items()], "length long, n_salts long")  # a row a length
    return pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64(row_col), F.col("n_salts"))).drop("n_salts")


def pack(pieces: DataFrame, row_col: str, capacity: int = CAPACITY) -> DataFrame:
    """pieces (a table, as `numbered` writes it: it is read three times) with sequence_id and offset instead of row_col."""
    spark = pieces.sparkSession
    hist = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    if not hist:
        return pieces.drop(row_col).withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    runs = sorted(plan(hist, capacity))
    rows = salted(pieces, row_col, hist)
    groups = placed_in(rows.groupBy("length", "salt").count(), "length", ["salt"], F.col("count"), "through")
    groups = groups.select("length", "salt", (F.col("through") - F.col("count")).alias("first_rank"))
    inside = Window.partitionBy("length", "salt").orderBy(row_col)
    ranked = rows.withColumn("n", F.row_number().over(inside)).join(groups, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("first_rank") + F.col("n") - 1).drop("first_rank", "n", "salt", row_col)
    # runs: bounded by the number of lengths and pieces in a sequence, not by the corpus
    shared = spark.sparkContext.broadcast(np.array(runs, np.int64))
    schema = type(pieces.schema)([f for f in ranked.schema.fields if f.name != "rank"]).add("sequence_id", "long").add("offset", "long")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = (table[:, 0] << 45) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            run = table[np.searchsorted(keys, (length << 45) + rank, side="right") - 1]
            k = rank - run[:, 1]
            out = with_columns(batch, {"sequence_id": pa.array(run[:, 3] + k // run[:, 2]), "offset": pa.array(run[:, 4] + (k % run[:, 2]) * length)})
            yield out.select(schema.names)

    return ranked.mapInArrow(tidy(placed), schema)


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Every piece of docs with its place."""
    pieces = token_pieces(docs, path, capacity, end_id, keep_ids)
    row_col = fresh(pieces, "_piece_row")
    return pack(numbered(pieces, row_col), row_col, capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents packed into sequences of 4096 tokens."""
    return packed(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
