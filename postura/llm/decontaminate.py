"""Benchmark decontamination with suffix arrays over the training texts.

Each slice of a partition's texts is a shard with a word suffix array of its
own.  Words are named by their place in the benchmark's vocabulary (0: not in
it), and the array holds the suffixes that open with words of some test
suffix; all others can match nothing.  Every test suffix (an item from one of
its words on), each distinct one once, is binary-searched in every shard.  From
the first place of a text where an item matches, the longest verbatim match is
found in the suffix array of the item; the search goes on behind it, so a match
of any length is one entry and repeated words cost no more than others.  The
benchmark is the stated query set: its items go to the tasks in blocks of at
most BLOCK_BYTES of text, one pass over the documents a block.

Words are looked up by 64-bit names; every match found is then compared with
the item word by word, as bytes.

Defined results: null or empty text has no words; items without words match
nothing; an item of fewer than `window` words is one window; repeated rows are
judged each by itself; items with a null id are searched as all others, count as
one item together and are left out of the hash, as in SQL; very long texts: whole,
their words take some 50 times their bytes in one task; empty tables give empty
or clean results; other columns are kept, whatever their names (columns that are
called like the results of `matches` are replaced there, not in `decontaminated`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fresh, table, texts_of, tidy, with_columns
from .words import Words, encoded, slices

WINDOW = 10
#: Text of the benchmark that goes to the tasks at once.
BLOCK_BYTES = 8 << 20
OPENING = 3
_FOUND = "array<struct<item_id:string,item_word:long,word:long,words:long>>"
_FOUND_TYPE = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("word", pa.int64()), ("words", pa.int64())]))


class Suffixes:
    """The distinct openings of all test suffixes with at least one window, ready to be searched."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        w = Words(encoded(t for _, t in items))
        self.window = window
        self.vocabulary, rank = np.unique(w.name, return_inverse=True)
        self.names = [name for name, _ in items]
        self.own = [(rank[w.first[k] : w.first[k + 1]] + 1).astype(np.uint32) for k in range(len(items))]
        self.words = w
        self.sorted: dict[int, np.ndarray] = {}  # suffix array of an item, made when it is needed
        rows, widths, item = [np.zeros((0, window), np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, own in enumerate(self.own):
            width = min(window, len(own))
            if width:
                part = np.zeros((len(own) - width + 1, window), np.uint32)
                part[:, :width] = np.lib.stride_tricks.sliding_window_view(own, width)
                part = np.unique(part, axis=0)
                rows.append(part)
                widths.append(np.full(len(part), width))
                item.append(np.full(len(part), k))
        rows, widths, item = np.concatenate(rows), np.concatenate(widths), np.concatenate(item)
        keyed = np.column_stack([widths.astype(np.uint32), rows])
        _, first, which = np.unique(keyed, axis=0, return_index=True, return_inverse=True)
        which = which.ravel()
        order = np.argsort(which, kind="stable")
        self.width = widths[first]
        self.items, self.cut = item[order], np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(first)))])  # items of each opening
        rows = rows[first].astype(">u4")
        self.low = _keys(rows)
        self.high = _keys(np.where(np.arange(window) < self.width[:, None], rows, np.uint32(0xFFFFFFFF)).astype(">u4"))
        # openings of 1, 2, ... words that all test suffixes have; a longer one narrows more
        self.opening = min(OPENING, int(self.width.min())) if len(first) else 0
        self.openings = [np.unique(_packed([rows[:, j].astype(np.uint64) for j in range(k + 1)])) for k in range(self.opening)]

    def items_of(self, which: np.ndarray) -> np.ndarray:
        """Items, each once, that hold any of some openings."""
        return np.unique(np.concatenate([self.items[self.cut[u] : self.cut[u + 1]] for u in np.unique(which)]))

    def longest(self, item: int, text: np.ndarray, at: int) -> tuple[int, int]:
        """(place in the item, words) of the longest match of what a text says from a place on, by binary search."""
        own = self.own[item]
        if item not in self.sorted:
            self.sorted[item] = suffix_array(own)
        order, best = self.sorted[item], (0, 0)
        low, high = 0, len(order)
        while low < high:
            mid = (low + high) // 2
            p = int(order[mid])
            n = min(len(own) - p, len(text) - at)
            n = common(own[p : p + n], text[at : at + n])
            if n > best[1] or (n == best[1] and p < best[0]):
                best = (p, n)
            if p + n == len(own) or (at + n < len(text) and own[p + n] < text[at + n]):
                low = mid + 1
            else:
                high = mid
        return best

    def ranks(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of a shard's words with a 0 after each text, and the text of each place."""
        at = np.searchsorted(self.vocabulary, w.name)
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == w.name if len(self.vocabulary) else np.zeros(len(at), bool)
        text = np.repeat(np.arange(len(w.counts)), w.counts)
        out = np.zeros(len(at) + len(w.counts) + self.window, np.uint32)
        out[np.arange(len(at)) + text] = np.where(known, at + 1, 0)
        return out, np.repeat(np.arange(len(w.counts)), w.counts + 1)

    def search(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(test suffix, place) of every match of its first window in a shard."""
        none = np.zeros(0, np.int64)
        if not self.opening:
            return none, none
        at = np.flatnonzero(ranks[: len(ranks) - self.window])
        for k in range(1, self.opening):
            found = self.openings[k]
            key = _packed([ranks[at + j].astype(np.uint64) for j in range(k + 1)])
            pos = np.searchsorted(found, key)
            pos[pos == len(found)] = 0
            at = at[found[pos] == key]
        if not len(at):
            return none, none
        keys = _keys(ranks[at[:, None] + np.arange(self.window)].astype(">u4"))
        order = np.argsort(keys, kind="stable")
        keys, suffixes = keys[order], at[order]  # the shard's suffix array
        low, high = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        n = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(n)), n)
        return which, suffixes[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Values that two arrays of one length have in common at their start."""
    at, step = 0, 64
    while at < len(a):
        apart = np.flatnonzero(a[at : at + step] != b[at : at + step])
        if len(apart):
            return at + int(apart[0])
        at, step = at + step, step * 2
    return len(a)


def suffix_array(values: np.ndarray) -> np.ndarray:
    """Places of the suffixes in order, by doubling: each round sorts by pairs of ranks."""
    rank, n = np.unique(values, return_inverse=True)[1].astype(np.int64), len(values)
    step = 1
    while True:
        later = np.full(n, -1, np.int64)
        later[: max(0, n - step)] = rank[step:]
        order = np.lexsort((later, rank))
        new = np.ones(n, np.int64)
        new[0] = 0
        new[1:] = (rank[order[1:]] != rank[order[:-1]]) | (later[order[1:]] != later[order[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        step *= 2


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of big-endian ranks as byte strings: compared as the ranks are."""
    rows = np.ascontiguousarray(rows)
    return rows.view(f"S{4 * rows.shape[1]}").ravel() if len(rows) else np.zeros(0, "S4")


def _packed(columns: list[np.ndarray]) -> np.ndarray:
    """One 64-bit value of up to three ranks; below two million words it is unique, beyond it only narrows less."""
    out = columns[0]
    for c in columns[1:]:
        out = (out << np.uint64(21)) ^ c
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[tuple[bool, list[tuple[str, str]]]]:
    items = benchmark.select(F.col(id_col).cast("string").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    size = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = -(-size // limit) or 1
    for k in range(n):
        yield k == n - 1, [(r["i"], r["t"]) for r in items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()]


def _runs(tests: Suffixes, ranks: np.ndarray, which: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Longest matches of one text: (item, its first word, the text's first word, words), from each place that no match before it covers."""
    out = []
    for item in tests.items_of(which):
        mine = np.isin(which, np.flatnonzero(_holders(tests, item)))
        places = np.unique(at[mine])
        width, k = min(tests.window, len(tests.own[item])), 0
        while k < len(places):
            x = int(places[k])
            p, n = tests.longest(item, ranks, x)
            out.append((int(item), p, x, n))
            k = int(np.searchsorted(places, x + max(n, width) - width + 1))
    return out


def _holders(tests: Suffixes, item: int) -> np.ndarray:
    """Whether each opening is one of an item's; kept."""
    if not hasattr(tests, "held"):
        tests.held = {}
    if item not in tests.held:
        owner = np.repeat(np.arange(len(tests.cut) - 1), np.diff(tests.cut))
        flag = np.zeros(len(tests.cut) - 1, bool)
        flag[owner[tests.items == item]] = True
        tests.held[item] = flag
    return tests.held[item]


def _verified(tests: Suffixes, w: Words, d: int, ranks: np.ndarray, which: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Matches of text d whose words are those of the item, byte by byte."""
    first = int(w.first[d])

    def same(item: int, p: int, x: int, n: int) -> bool:
        own = int(tests.words.first[item])
        return all(tests.words.text(own + p + k) == w.text(first + x + k) for k in range(n))

    runs = _runs(tests, ranks, which, at)
    if all(same(*run) for run in runs):
        return runs
    # two words share a name: such a place matches nothing, and a match ends before it
    out = []
    for item, p, x, n in runs:
        own, k = int(tests.words.first[item]), 0
        width = min(tests.window, len(tests.own[item]))
        equal = [tests.words.text(own + p + k) == w.text(first + x + k) for k in range(n)]
        while k < n:
            end = next((j for j in range(k, n) if not equal[j]), n)
            if end - k >= width:
                out.append((item, p + k, x + k, end - k))
            k = end + 1
    return out


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, keep_text: bool = True, words_col: str = "_dc_words", found_col: str = "_dc_found") -> DataFrame:
    """A row a document: its columns (without the text, if not keep_text), _dc_words, and _dc_found.

    _dc_words: number of words; _dc_found: its longest verbatim matches, an
    array of (item_id, item_word, word, words).
    """
    spark = docs.sparkSession
    more = StructType().add(words_col, "long").add(found_col, StructType.fromDDL(f"x {_FOUND}")[0].dataType).fields
    result = docs.drop(words_col, found_col)
    for k, (last, items) in enumerate(_blocks(benchmark, item_col, item_text_col, block_bytes)):
        gone = [text_col] if last and not keep_text else []
        schema = StructType([f for f in docs.drop(words_col, found_col).schema.fields if f.name not in gone] + more)
        shared = spark.sparkContext.broadcast(items)  # at most block_bytes of text

        def searched(batches: Iterator[pa.RecordBatch], shared=shared, k=k, schema=schema) -> Iterator[pa.RecordBatch]:
            tests = Suffixes(shared.value, window)
            for batch in batches:
                raw = encoded(texts_of(batch, text_col))
                before = batch.column(batch.schema.get_field_index(found_col)).to_pylist() if k else None
                for a, b in slices([len(x) for x in raw]):
                    w = Words(raw[a:b])
                    ranks, text = tests.ranks(w)
                    which, at = tests.search(ranks)
                    found: list[list] = [[] for _ in range(b - a)]
                    owner = text[at]
                    order = np.argsort(owner, kind="stable")
                    cut = np.flatnonzero(np.diff(owner[order])) + 1
                    for part in np.split(order, cut) if len(order) else []:
                        d = int(owner[part[0]])
                        start = int(w.first[d] + d)
                        runs = _verified(tests, w, d, ranks[start : start + int(w.counts[d])], which[part], at[part] - start)
                        found[d] = [{"item_id": tests.names[i], "item_word": int(p), "word": int(x), "words": int(n)} for i, p, x, n in runs]
                    if k:
                        found = [old + new for old, new in zip(before[a:b], found)]
                    out = with_columns(batch, {words_col: pa.array(w.counts, pa.int64()), found_col: pa.array(found, _FOUND_TYPE)}, a, b - a)
                    yield out.select(schema.names)

        result = result.mapInArrow(tidy(searched), schema)
    return result


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any match, with their columns."""
    words, found = fresh(docs, "_dc_words"), fresh(docs, "_dc_found")
    return matches(docs, benchmark, words_col=words, found_col=found, **options).filter(F.size(found) == 0).select(*docs.columns)


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of the rows of matches()."""
    spans = F.sort_array(F.transform("_dc_found", lambda m: F.struct(m["word"].alias("a"), (m["word"] + m["words"]).alias("b"))))
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    more = lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["end"]))).alias("n"))
    items = F.sort_array(F.array_distinct(F.transform("_dc_found", lambda m: m["item_id"])))
    return found.select(
        F.col(id_col).alias("doc_id"), F.col("_dc_words").alias("n_words"), F.aggregate(spans, zero, more, lambda s: s["n"]).alias("n_hit"), items.alias("items"),
    ).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the whole benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return summary(matches(docs, table(spark, sf_dir, "benchmark"), keep_text=False))


OP4_SQL = r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as g from (
  select item_id, w, least(10, len(w)) as k, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
ks as (select distinct k from bw),
dw as (select rid, i, k, array_to_string(w[i:i + k - 1], ' ') as g from (
  select rid, w, k, unnest(range(1, len(w) - k + 2)) as i from d, ks where len(w) >= k)),
h as (select distinct rid, i, dw.k, item_id from dw join bw on dw.k = bw.k and dw.g = bw.g),
n as (select rid, count(distinct p)::bigint as n_hit from (select rid, unnest(range(i, i + k)) as p from (select distinct rid, i, k from h)) group by rid),
t as (select rid, count(*)::bigint as n_items, sha256(string_agg(s, ',' order by s)) as items_sha256 from (select distinct rid, item_id::varchar as s from h) group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (rid) left join t using (rid)
"""
