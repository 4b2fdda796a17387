"""Near-duplicate classes with ProbMinHash signatures, banding and verification.

Shingles are five words (all words of a shorter text).  Every shingle is a
Poisson process with its weight as rate whose arrivals fall on random
registers; a register keeps its earliest arrival.  A shingle's process is
followed only while its time is below the latest register of its text, so
most shingles of a long text end after one arrival.  Registers of two texts
agree with the probability Jaccard similarity of their weighted shingles.  The
weight of a shingle is its count in the text (weights "count", the default); with
weights "set" it is 1, and the similarity the plain Jaccard one.

Texts with the same words are one node.  Nodes that share a band meet in its
bucket.  No bucket is expanded into pairs at once: all members are verified
against the bucket's leader (and random other ones, as long as many rows stay
apart), and only members that are apart from their bucket's largest group are
compared with its other members, in blocks bounded in rows and bytes, by
products of incidence matrices; of the links found a spanning forest is
emitted.  Every link is verified by its exact probability Jaccard similarity;
links form classes.  Shingles are told by 64-bit names: those of a corpus of
10**12 distinct ones have some 10**24 / 2**65 pairs in common by chance, and a
pair changes a similarity only by one shingle.

Two texts of similarity s meet with probability 1 - (1 - s**ROWS)**BANDS, over
0.9999 at the threshold.

Defined results: a text without words is in a class with equal texts only;
null text: as such, an own class an id; rows of one id with the same words are
one document, rows of one id with other words are another; null id: as any
other row, class_id null only in a class of null ids; ties: of rows with the
same id, or without one, the kept one is that of the least SHA-256 of its text;
very long texts: whole, their shingles take some 60 times their bytes in one
task; empty table: empty result; other columns are ignored, whatever their
names (but for _md_name in `deduplicated`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected
from .common import bounded_batches, release, saved, table, tidy
from .words import Words, encoded, mixed, slices

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Texts with fewer shingles take many rounds; they are signed together.
FEW = 64
#: Members left apart, and all members, of a bucket that are compared in one block, and bytes of their shingles.
LEFT_BLOCK, RIGHT_BLOCK = 128, 512
LEFT_BYTES, RIGHT_BYTES = 4 << 20, 16 << 20
#: Copies of a bucket's rows over blocks beyond which another round of leaders comes first.
BLOCK_COPIES = 8
MAX_LEADER_ROUNDS = 6
#: Bytes of texts whose shingles are made at once; the arrays take some 50 times as much.
SLICE_BYTES = 1 << 19


def shingle_names(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(name, text) of every shingle of a slice; repeated ones repeat."""
    n = w.counts
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(text)) - np.repeat(w.first[:-1], n)
    width = np.minimum(n, k)
    start = np.flatnonzero(place <= np.repeat(n - width, n))
    owner = text[start]
    h = np.zeros(len(start), np.uint64)
    for j in range(k):
        inside = j < width[owner]
        at = np.minimum(start + j, len(w.name) - 1)
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, w.name[at], np.uint64(0))
    return mixed(h + width[owner].astype(np.uint64)), owner


def weighted(names: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, with their counts."""
    order = np.lexsort((names, owner))
    names, owner = names[order], owner[order]
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return names[at], owner[at], np.diff(np.append(at, len(names)))


def signatures(names: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """n x m registers: the shingle with the earliest arrival in each."""
    best = np.full(n * m, np.inf)
    kept = np.zeros(n * m, np.uint64)
    latest = np.full(n, np.inf)
    time = np.zeros(len(names))
    step = 0
    while len(names):
        step = (step + 0xD1B54A32D192ED03) % 2**64
        r = mixed(names + np.uint64(step))
        time = time - np.log(((r >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weight
        go = time < latest[owner]
        names, owner, weight, time, r = names[go], owner[go], weight[go], time[go], r[go]
        at = owner * m + (mixed(r) % np.uint64(m)).astype(np.int64)
        np.minimum.at(best, at, time)
        won = best[at] == time
        kept[at[won]] = names[won]
        live = np.unique(owner)
        latest[live] = best.reshape(n, m)[live].max(axis=1)
    return kept.reshape(n, m)


def bands(registers: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """64-bit key of each band of each text."""
    n, m = registers.shape
    parts = registers.reshape(n, m // rows, rows)
    h = np.broadcast_to(np.arange(m // rows, dtype=np.uint64) + np.uint64(1), (n, m // rows)).copy()
    for j in range(rows):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return h.view(np.int64)


def _name(id_col: str, text_col: str):
    """Names a document: its id and its text, either of them perhaps null."""
    text = F.coalesce(F.sha2(F.col(text_col).cast("binary"), 256), F.rpad(F.lit("-"), 64, "-"))
    return F.unhex(F.sha2(F.concat(text, F.coalesce(F.concat(F.lit("+"), F.col(id_col).cast("string")), F.lit("-"))).cast("binary"), 256))


def signed(docs: DataFrame, weights: str = "count", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, name, doc_id, key, n_shingles, bands): name is that of the document, key names the text's words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = encoded(pdf["t"])
            keys: list[bytes] = []
            counts = np.zeros(len(raw), np.int32)
            found = np.zeros((len(raw), BANDS), np.int64)
            few = []
            for a, b in slices([len(x) for x in raw], SLICE_BYTES):
                w = Words(raw[a:b])
                for k in range(b - a):
                    words = w.name[w.first[k] : w.first[k + 1]].tobytes()
                    alone = b"\1%a" % pdf["i"].iloc[a + k] if pdf["t"].iloc[a + k] is None else b"\0" + raw[a + k]
                    keys.append(hashlib.blake2b(words or alone, digest_size=16).digest())
                names, owner, count = weighted(*shingle_names(w))
                n = np.bincount(owner, minlength=b - a)
                counts[a:b] = n
                weight = count.astype(float) if weights == "count" else np.ones(len(names))
                small = n[owner] < FEW
                few.append((names[small], owner[small] + a, weight[small]))
                if not small.all():
                    live, own = np.unique(owner[~small], return_inverse=True)
                    found[a + live] = bands(signatures(names[~small], own, weight[~small], len(live)))
            names, owner, weight = (np.concatenate(x) for x in zip(*few)) if few else (np.zeros(0, np.uint64),) * 3
            if len(names):
                live, own = np.unique(owner, return_inverse=True)
                found[live] = bands(signatures(names, own, weight, len(live)))
            yield pd.DataFrame({"row": pdf["row"], "name": pdf["name"], "doc_id": pdf["i"], "key": keys, "n_shingles": counts, "bands": [list(x) if n else [] for x, n in zip(found, counts)]})

    # ids go through Python as text: beside a null, pandas makes numbers floats
    rows = docs.select(F.monotonically_increasing_id().alias("row"), _name(id_col, text_col).alias("name"), F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    return rows.mapInPandas(tidy(sign), "row long, name binary, doc_id string, key binary, n_shingles int, bands array<long>").withColumn("doc_id", F.col("doc_id").cast(kind))


def shingled(docs: DataFrame, weights: str = "count") -> DataFrame:
    """(node, shingles, counts): the distinct shingles of each text as sorted 64-bit names, and their weights (empty if all are 1)."""

    def shingle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = encoded(pdf["text"])
            for a, b in slices([len(x) for x in raw], SLICE_BYTES):
                names, owner, count = weighted(*shingle_names(Words(raw[a:b])))
                cut = np.searchsorted(owner, np.arange(1, b - a))
                parts, counts = np.split(names, cut), np.split(count.astype(np.uint32), cut)
                plain = [weights == "set" or (c == 1).all() for c in counts]
                yield pd.DataFrame({"node": pdf["node"].iloc[a:b].to_numpy(), "shingles": [x.tobytes() for x in parts], "counts": [b"" if p else c.tobytes() for c, p in zip(counts, plain)]})

    return docs.select("node", "text").mapInPandas(tidy(shingle), f"node {docs.schema['node'].dataType.simpleString()}, shingles binary, counts binary")


def _weights(counts: bytes, n: int) -> np.ndarray:
    return np.frombuffer(counts, np.uint32).astype(float) if counts else np.ones(n)


def probability_jaccard(p: np.ndarray, v: np.ndarray, q: np.ndarray, w: np.ndarray) -> float:
    """Exact similarity of two weighted sets (sorted names, weights): sum over common d of 1 / sum over all e of max(v[e] / v[d], w[e] / w[d])."""
    _, i, j = np.intersect1d(p, q, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    if v.max() == v.min() and w.max() == w.min() and len(p) == len(q):
        return len(i) / (len(p) + len(q) - len(i))
    x, y = v[i], w[j]
    # the larger of both quotients is the first one for all e whose ratio v / w is at least that of d
    ratio, back = np.unique(x / y, return_inverse=True)
    above = v.sum() - x.sum() + np.bincount(back, x)[::-1].cumsum()[::-1]
    by_y = np.bincount(back, y)
    below = w.sum() - y.sum() + by_y.cumsum() - by_y
    return float((1 / (above[back] / x + below[back] / y)).sum())


def similar(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold."""

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, v, y, w in zip(pdf["x"], pdf["v"], pdf["y"], pdf["w"]):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(probability_jaccard(p, _weights(v, len(p)), q, _weights(w, len(q))) >= similarity - 1e-9)
            yield pdf.loc[keep, ["a", "b"]]

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"), F.col("counts").alias("v")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"), F.col("counts").alias("w")), "b")
    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "x", "v", "y", "w").mapInPandas(tidy(verified), f"a {kind}, b {kind}")


def _shared(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]], columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Share of each left set's weight, and of each right one's, that lies on common shingles, as products of incidence matrices."""
    sides = []
    for sets in (left, right):
        part = np.concatenate([w / w.sum() for _, w in sets])
        sides.append((np.concatenate([x for x, _ in sets]), np.repeat(np.arange(len(sets)), [len(x) for x, _ in sets]), part))
    shared = np.intersect1d(sides[0][0], sides[1][0])
    placed = []
    for names, owner, part in sides:
        at = np.searchsorted(shared, names)
        at[at == len(shared)] = 0
        known = shared[at] == names if len(shared) else np.zeros(len(names), bool)
        order = np.argsort(at[known], kind="stable")
        placed.append((at[known][order], owner[known][order], part[known][order]))
    of_left, of_right = (np.zeros((len(left), len(right)), np.float32) for _ in range(2))
    for first in range(0, len(shared), columns):
        (a, v), (b, w) = ([np.zeros((len(sets), columns), np.float32) for _ in range(2)] for sets in (left, right))
        for on, weight, (at, owner, part) in ((a, v, placed[0]), (b, w, placed[1])):
            low, high = np.searchsorted(at, (first, first + columns))
            on[owner[low:high], at[low:high] - first] = 1
            weight[owner[low:high], at[low:high] - first] = part[low:high]
        of_left += v @ b.T
        of_right += a @ w.T
    return of_left, of_right


def _forest(similarity: float):
    """Links of a block of members left apart with a block of all members: a spanning forest, exactly verified."""

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for part in (pdf[pdf["apart"]], pdf[~pdf["apart"]]):
            names = [np.frombuffer(x, np.uint64) for x in part["shingles"]]
            sides.append((part["node"].tolist(), part["comp"].to_numpy(), [(x, _weights(c, len(x))) for x, c in zip(names, part["counts"])]))
        (names, labels, left), (names2, labels2, right) = sides
        out = []
        if names and names2:
            # the similarity is at most either share
            x, y = _shared(left, right)
            fits = (x >= similarity - 1e-4) & (y >= similarity - 1e-4) & (labels[:, None] != labels2)
            parent: dict = {}

            def root(x):
                while parent.setdefault(x, x) != x:
                    parent[x] = x = parent[parent[x]]
                return x

            for k, j in np.argwhere(fits).tolist():
                a, b = root(names[k]), root(names2[j])
                if a != b and probability_jaccard(*left[k], *right[j]) >= similarity - 1e-9:
                    parent[a] = b
                    out.append((max(names[k], names2[j]), min(names[k], names2[j])))
        return pd.DataFrame(out, columns=["a", "b"])

    return link


def links(buckets: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): verified links that connect every class.  buckets: (band, node, n) of the bands with two nodes at least."""
    kind = buckets.schema["node"].dataType.simpleString()
    edges = members = None
    rows = before = 0
    for turn in range(MAX_LEADER_ROUNDS):
        rank = F.col("node") if turn == 0 else F.xxhash64("node", "band", F.lit(turn))
        if turn == 0:  # all members with the least node of their bucket
            lead = buckets.groupBy("band").agg(F.min(F.struct("node", "n")).alias("top"))
            pairs = buckets.join(lead, "band").filter(F.col("node") != F.col("top.node"))
        else:  # those left apart with a random member of the bucket's largest group
            pairs = members.filter("apart").withColumn("top", F.col("lead"))
        pairs = pairs.select(F.col("node").alias("a"), "n", F.col("top.node").alias("b"), F.col("top.n").alias("n2")).select("a", "b").distinct()
        found = similar(pairs, sets, similarity)
        edges = saved(found if edges is None else edges.unionByName(found), "links")
        # groups so far: the least node among a node's links and itself (links within a class may still be split over groups)
        label = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("comp"))
        named = buckets.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        groups = named.groupBy("band", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("w"), F.min_by(F.struct("node", "n"), rank).alias("lead"))
        groups = groups.groupBy("band").agg(F.sum("c").alias("size"), F.sum("w").alias("whole"), F.max(F.struct("c", "comp", "lead", "w")).alias("most")).filter("size > most.c")
        blocks = [F.greatest(F.ceil(rows_ / most), F.ceil(12 * shingles_ / limit)).cast("int") for rows_, most, shingles_, limit in (
            (F.col("size") - F.col("most.c"), LEFT_BLOCK, F.col("whole") - F.col("most.w"), LEFT_BYTES), (F.col("size"), RIGHT_BLOCK, F.col("whole"), RIGHT_BYTES))]
        groups = groups.select("band", "size", blocks[0].alias("n_left"), blocks[1].alias("n_right"), F.col("most.comp").alias("most"), F.col("most.lead").alias("lead"))
        members = named.join(groups, "band")
        members = saved(members.withColumn("apart", F.col("comp") != F.col("most")).drop("most"), "members")
        rows, todo, apart = members.agg(F.count("*"), F.sum(F.when(F.col("apart"), F.col("size"))), F.count_if("apart")).first()
        if not rows:
            return edges
        # blocks copy each row todo / (rows * block) times; another leader is worth a pass only if that is much and the last one helped
        if todo <= BLOCK_COPIES * LEFT_BLOCK * rows or (before and apart > before / 2):
            break
        before = apart
        release(buckets.sparkSession)
    full = members.join(sets, "node")
    full = full.withColumn("left", F.pmod(F.xxhash64("node", F.lit(1)), F.col("n_left")).cast("int")).withColumn("right", F.pmod(F.xxhash64("node", F.lit(2)), F.col("n_right")).cast("int"))
    keep = ("band", "node", "comp", "shingles", "counts")
    one = full.filter("apart").select(*keep, F.lit(True).alias("apart"), "left", F.explode(F.sequence(F.lit(0), F.col("n_right") - 1)).alias("right"))
    two = full.select(*keep, F.lit(False).alias("apart"), F.explode(F.sequence(F.lit(0), F.col("n_left") - 1)).alias("left"), "right")
    found = one.unionByName(two).groupBy("band", "left", "right").applyInPandas(_forest(similarity), f"a {kind}, b {kind}")
    return edges.unionByName(saved(found, "links"))


def classified(docs: DataFrame, similarity: float = SIMILARITY, weights: str = "count", id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(name, doc_id, key, n_shingles) of every row and (key, top) of every key; top is the document its class keeps: that of the least id, then name."""
    spark = docs.sparkSession
    with bounded_batches(spark):
        rows = saved(signed(docs, weights, id_col, text_col), "signed")
        top = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "name"))
        # a node is a key, named by one of its rows
        reps = saved(rows.groupBy("key").agg(F.min("row").alias("node"), top.alias("top")), "keys")
        nodes = rows.filter("n_shingles > 0").join(reps.select("key", "node"), "key").filter("row = node").select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
        shared = nodes.groupBy("band").agg(F.min("node").alias("p"), F.max("node").alias("q")).filter("p <> q").select("band")
        buckets = saved(nodes.join(shared, "band").select("band", "node", "n").distinct(), "buckets")
        ids = buckets.select("node").distinct().join(reps.select("node", "top.name"), "node")
        texts = docs.select(_name(id_col, text_col).alias("name"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
        sets = saved(shingled(texts.join(ids, "name").dropDuplicates(["name"]), weights), "shingles")
        release(spark)
        comps = connected(links(buckets, sets, similarity))
        whole = saved(reps.join(comps, "node", "left").select("key", F.coalesce("comp", "node").alias("comp"), "top"), "classes")
    return rows, whole.select("key", "comp").join(whole.groupBy("comp").agg(F.min("top").alias("top")), "comp").select("key", "top")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, weights: str = "count", id_col: str = "doc_id", text_col: str = "text", kept_col: str | None = None) -> DataFrame:
    """(id, class_id, n_shingles) of every row; class_id is the least id of the class.  kept_col, if given, tells the class's kept document."""
    rows, classes = classified(docs, similarity, weights, id_col, text_col)
    kept = [(F.col("name") == F.col("top.name")).alias(kept_col)] if kept_col else []
    return rows.join(classes, "key").select(F.col("doc_id").alias(id_col), F.col("top.doc_id").alias("class_id"), "n_shingles", *kept)


def deduplicated(docs: DataFrame, null_ids: bool = False, **options) -> DataFrame:
    """docs with one row of each class: that of the least id.  Classes of null ids alone are left out, unless null_ids."""
    _, classes = classified(docs, **options)
    kept = (classes if null_ids else classes.filter("not top.none")).select(F.col("top.name").alias("_md_name")).distinct()
    named = docs.withColumn("_md_name", _name(options.get("id_col", "doc_id"), options.get("text_col", "text")))
    return named.join(kept, "_md_name", "left_semi").dropDuplicates(["_md_name"]).select(*docs.columns)


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"), kept_col="kept")
