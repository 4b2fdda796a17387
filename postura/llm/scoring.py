"""Masked pseudo-likelihood with a bidirectional window network trained in numpy.

Every token is predicted from SIDE tokens on either side; a document's score
is the sum of the log-probabilities of its tokens.  The output is a two-level
softmax (a block of words, then the word in it), so probabilities are
normalised at a cost of about two square roots of the vocabulary.

Vocabulary: the most frequent words of all documents, counted over the whole
corpus; other words fall in hashed classes.  The counts of all words stay a
table that grows with the corpus; a word of a class has the probability of
the class times its share in the class's tokens, joined from that table.
Training: ROUNDS passes; in each every partition starts from the common
parameters, learns from the masked tokens and sends its parameters; their mean
by tokens is taken chunk by chunk, first over TOGETHER partitions each.  The
masks of the rounds partition the places, so every token of the corpus is
learnt from once.  The network has a fixed size.  As partitions learn apart,
scores depend on how the input is cut into partitions.

Defined results: null or empty text: no tokens, log_prob 0, mean null; repeated
rows are scored each; null ids are kept; ties: of words that are as frequent the
one with the lesser name (a 64-bit hash) is in the vocabulary; very long texts:
whole, their words take some 100 times their bytes in one task; an empty table
gives an empty result (the model is then untrained); a word that was not counted
has the share of a word counted once; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, saved, table, texts_of, tidy, with_columns
from .words import Words, encoded, mixed, slices

SIDE = 2
BLOCK = 64
VOCABULARY = 30 * BLOCK
#: Classes of the words beyond the vocabulary.
OTHERS = 2 * BLOCK
WIDTH = 24
ROUNDS = 2
#: Tokens of a step.
BATCH = 16384
#: First place of each neighbour in a run, for its first place with all neighbours.
OFFSETS = [k for k in range(2 * SIDE + 1) if k != SIDE]
#: Text whose rare words are looked up together, and bytes of names that one task looks up.
PART_BYTES, GROUP_BYTES = 8 << 20, 6 << 20
#: Parameters that are added at once, and partitions whose ones are added first.
CHUNK, TOGETHER = 4096, 64
RATE = 0.15
#: Bound of the weights: logits stay below WIDTH * LIMIT + LIMIT.
LIMIT = 3.0
PAD = VOCABULARY + OTHERS
N_BLOCKS = PAD // BLOCK


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(name, c) of every word of the corpus."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = encoded(pdf["t"])
            for a, b in slices([len(x) for x in raw], 16 << 20):
                names, c = np.unique(Words(raw[a:b]).name, return_counts=True)
                yield pd.DataFrame({"name": names.view(np.int64), "c": c})

    return docs.select(F.col(text_col).alias("t")).mapInPandas(tidy(counted), "name long, c long").groupBy("name").agg(F.sum("c").alias("c"))


def vocabulary(docs: DataFrame, text_col: str = "text", size: int = VOCABULARY, counts: DataFrame | None = None) -> np.ndarray:
    """Names of the most frequent words of the corpus, most frequent first."""
    counts = word_counts(docs, text_col) if counts is None else counts
    top = counts.orderBy(F.desc("c"), "name").limit(size).collect()
    return np.array([r["name"] for r in top], np.int64).view(np.uint64)


def _class(name: str):
    return F.pmod(name, F.lit(OTHERS))  # OTHERS divides 2**64, so the sign is of no matter


def others(counts: DataFrame, names: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(name, c) of the words beyond the vocabulary, and (class, total) of their classes."""
    known = counts.sparkSession.createDataFrame(pd.DataFrame({"name": names.view(np.int64)}), "name long")
    rare = counts.join(F.broadcast(known), "name", "left_anti")
    return rare, rare.groupBy(_class("name").alias("class")).agg(F.sum("c").alias("total"))


class Net:
    """Parameters in one vector: embeddings, weights of each offset, block and word outputs."""

    SHAPES = (("embed", (PAD + 1, WIDTH)), ("offset", (2 * SIDE, WIDTH)), ("hidden", (WIDTH,)), ("block", (WIDTH, N_BLOCKS)), ("block_bias", (N_BLOCKS,)), ("word", (N_BLOCKS, WIDTH, BLOCK)), ("word_bias", (N_BLOCKS, BLOCK)))

    def __init__(self, vector: np.ndarray | None = None):
        sizes = [int(np.prod(s)) for _, s in self.SHAPES]
        if vector is None:
            vector = np.random.default_rng(7).normal(0, 0.1, sum(sizes)).astype(np.float32)
        self.vector = vector
        at = 0
        for (name, shape), n in zip(self.SHAPES, sizes):
            setattr(self, name, vector[at : at + n].reshape(shape))
            at += n

    def inputs(self, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings of a run of tokens, and inputs of the hidden layer at all of its places but SIDE at either end."""
        e = np.take(self.embed, run, axis=0)
        n = len(run) - 2 * SIDE
        x = e[OFFSETS[0] : OFFSETS[0] + n] * self.offset[0]
        part = np.empty_like(x)
        for at, weight in zip(OFFSETS[1:], self.offset[1:]):
            x += np.multiply(e[at : at + n], weight, out=part)
        x += self.hidden
        return e, x

    @staticmethod
    def _softmax(z: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each row's target, and exp of the logits over their sum (in place of z)."""
        rows = np.arange(len(target))
        # exp cannot overflow: hidden values are within 1, weights within LIMIT
        p = z[rows, target]
        np.exp(z, out=z)
        total = z.sum(axis=1)
        return p - np.log(total), total

    def _output(self, x: np.ndarray, target: np.ndarray):
        """Log-probability of each target; the rest is for gradient()."""
        h = x / (1 + np.abs(x))
        block, word = np.divmod(target, BLOCK)
        z = h @ self.block
        z += self.block_bias
        p, total = self._softmax(z, block)
        order = np.argsort(block.astype(np.int16), kind="stable")
        cut = np.searchsorted(block[order], np.arange(N_BLOCKS + 1)).tolist()
        sorted_h, sorted_word, q = h[order], word[order], np.empty(len(target), np.float32)
        words = []
        for c in range(N_BLOCKS):
            a, b = cut[c], cut[c + 1]
            if a < b:
                y = sorted_h[a:b] @ self.word[c]
                y += self.word_bias[c]
                q[a:b], sums = self._softmax(y, sorted_word[a:b])
                words.append((c, a, b, y, sums))
        p[order] += q
        return p, h, z, total, block, order, sorted_h, sorted_word, words

    def forward(self, run: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-probability of the tokens at some places of a run (counted from its first SIDE tokens on)."""
        _, x = self.inputs(run)
        return self._output(x[at], run[at + SIDE])[0]

    def gradient(self, run: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the mean of -forward()."""
        e, every = self.inputs(run)
        x, n, size = every[at], np.float32(len(at)), len(run) - 2 * SIDE
        _, h, z, total, block, order, sorted_h, sorted_word, words = self._output(x, run[at + SIDE])
        out = Net(np.zeros_like(self.vector))
        z *= (1 / total)[:, None]
        z[np.arange(len(at)), block] -= 1
        out.block[:] = h.T @ z
        out.block_bias[:] = z.sum(axis=0)
        back = np.empty_like(h)
        for c, a, b, y, sums in words:
            y *= (1 / sums)[:, None]
            y[np.arange(b - a), sorted_word[a:b]] -= 1
            back[a:b] = y @ self.word[c].T
            out.word[c] = sorted_h[a:b].T @ y
            out.word_bias[c] = y.sum(axis=0)
        dh = z @ self.block.T
        dh[order] += back
        dh /= np.square(1 + np.abs(x))
        out.hidden[:] = dh.sum(axis=0)
        dx, de = np.zeros((size, WIDTH), np.float32), np.zeros_like(e)
        dx[at] = dh
        part = np.empty_like(dx)
        for k, first in enumerate(OFFSETS):
            out.offset[k] = np.einsum("ij,ij->j", dh, e[at + first])
            np.multiply(dx, self.offset[k], out=part)
            de[first : first + size] += part
        cell = (run[:, None] * WIDTH + np.arange(WIDTH)).ravel()
        out.embed[:] = np.bincount(cell, de.ravel(), minlength=(PAD + 1) * WIDTH).reshape(-1, WIDTH)
        out.vector /= n
        return out.vector


class Tokens:
    """Classes of the words of a slice, with their contexts."""

    def __init__(self, raw: list[bytes], names: np.ndarray, rank: np.ndarray):
        self.words = w = Words(raw)
        if len(names):
            at = np.searchsorted(names, w.name)
            at[at == len(names)] = 0
            known = names[at] == w.name
            token = np.where(known, rank[at], VOCABULARY + (w.name % np.uint64(OTHERS)).astype(np.int64))
        else:
            token = VOCABULARY + (w.name % np.uint64(OTHERS)).astype(np.int64)
        self.text = np.repeat(np.arange(len(raw)), w.counts)
        self.padded = np.full(len(token) + SIDE * (len(raw) + 1), PAD, np.int64)
        self.place = np.arange(len(token)) + SIDE * (self.text + 1)
        self.padded[self.place] = token
        self.token = token

    def runs(self, places: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, slice]]:
        """(run, places in it, which of the places) for some of the tokens, so many tokens a run."""
        at = self.place[places]
        for first in range(SIDE, len(self.padded) - SIDE, size):
            low, high = np.searchsorted(at, (first, first + size))
            if low < high:
                yield self.padded[first - SIDE : first + size + SIDE], at[low:high] - first, slice(low, high)

    def masked(self, turn: int, rounds: int) -> np.ndarray:
        """Places to learn from in a round; each place has one."""
        local = np.arange(len(self.token)) - np.repeat(self.words.first[:-1], self.words.counts)
        h = mixed(self.words.name + local.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return np.flatnonzero(h % np.uint64(rounds) == turn)


def _index(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(names)
    return names[order], order


def train(docs: DataFrame, names: np.ndarray, text_col: str = "text", rounds: int = ROUNDS) -> np.ndarray:
    """Parameters after some rounds over all documents."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("t"))
    vector = Net().vector
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((names, vector))  # of fixed size

        def learned(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            words, start = shared.value
            ordered, rank = _index(words)
            net, square, n = Net(start.copy()), np.full(len(start), 1e-8, np.float32), 0
            for batch in batches:
                raw = encoded(texts_of(batch, "t"))
                for a, b in slices([len(x) for x in raw]):
                    t = Tokens(raw[a:b], ordered, rank)
                    for run, at, _ in t.runs(t.masked(turn, rounds), BATCH):
                        g = net.gradient(run, at)
                        square += g * g
                        g *= np.float32(RATE)
                        g /= np.sqrt(square)
                        net.vector -= g
                        np.clip(net.vector, -LIMIT, LIMIT, out=net.vector)
                        n += len(at)
            if n:
                first = np.arange(0, len(start), CHUNK)
                part = np.full(len(first), TaskContext.get().partitionId() // TOGETHER)
                sums = [x.astype(float) * n for x in np.split(net.vector, first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(part), pa.array(np.full(len(first), n)), pa.array(sums, pa.list_(pa.float64()))], ["first", "part", "n", "sums"])

        def added(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"first": pdf["first"].iloc[:1], "part": pdf["part"].iloc[:1], "n": [pdf["n"].sum()], "sums": [np.sum(np.stack(pdf["sums"].tolist()), axis=0)]})

        shape = "first long, part long, n long, sums array<double>"
        sent = texts.mapInArrow(tidy(learned), shape)
        # one chunk of the parameters of TOGETHER partitions at a time, then of all
        sent = sent.groupBy("first", "part").applyInPandas(added, shape).withColumn("part", F.lit(0).cast("long"))
        got = sent.groupBy("first").applyInPandas(added, shape).collect()  # the model: a fixed number of parameters
        if got:
            vector = np.concatenate([np.array(r["sums"]) / r["n"] for r in sorted(got, key=lambda r: r["first"])]).astype(np.float32)
    return vector


def _within(scored: DataFrame, counts: DataFrame) -> DataFrame:
    """(part, g, logs): logarithms of the counts of each part's distinct rare words, in the order of their names.

    Names travel packed by part and group; a group of words meets its counts once.
    """
    n_groups = max(1, -(-int(scored.agg(F.sum(F.octet_length("names"))).first()[0] or 0) // GROUP_BYTES))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, names in zip(pdf["part"], pdf["names"]):
                names = np.frombuffer(names, np.uint64)
                ends = _group_ends(names, n_groups)
                live = np.flatnonzero(np.diff(ends))
                yield pd.DataFrame({"part": part, "g": live, "names": [names[ends[g] : ends[g + 1]].tobytes() for g in live]})

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = right["name"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(known)
        known, logs = known[order], np.log(right["c"].to_numpy(float))[order]
        out = []
        for names in left["names"]:
            names = np.frombuffer(names, np.uint64)
            at = np.searchsorted(known, names)
            at[at == len(known)] = 0
            own = np.where(known[at] == names, logs[at], 0.0) if len(known) else np.zeros(len(names))
            out.append(own.astype(np.float32).tobytes())
        return pd.DataFrame({"part": left["part"], "g": left["g"], "logs": out})

    top = F.shiftrightunsigned("name", 32)  # as in _group_ends
    asked = scored.select("part", "names").mapInPandas(tidy(cut), "part string, g int, names binary")
    held = counts.filter("c > 1").select("name", "c", F.shiftrightunsigned(top * n_groups, 32).cast("int").alias("g"))  # a word counted once adds nothing
    return asked.groupBy("g").cogroup(held.groupBy("g")).applyInPandas(answer, "part string, g int, logs binary")


def _group_ends(names: np.ndarray, n: int) -> np.ndarray:
    """First of each of n groups of sorted names, and the end; names are even, so groups are."""
    group = (((names >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)
    return np.searchsorted(group, np.arange(n + 1))


def score(docs: DataFrame, names: np.ndarray, vector: np.ndarray, id_col: str = "doc_id", text_col: str = "text", counts: DataFrame | None = None) -> DataFrame:
    """(id, n_tokens, log_prob, mean_log_prob) of every row.

    Without the counts of all words, log_prob is that of words and classes,
    with no factor for the word in its class.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    totals = np.ones(OTHERS)
    if counts is not None:
        for r in others(counts, names)[1].collect():  # OTHERS rows
            totals[r["class"]] = r["total"]
    shared = spark.sparkContext.broadcast((names, vector, np.log(totals) * (counts is not None)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights, log_total = shared.value
        ordered, rank = _index(words)
        net = Net(weights)
        for batch in batches:
            raw = encoded(texts_of(batch, "t"))
            held, size, first = [], 0, 0
            for a, b in slices([len(x) for x in raw]):
                t = Tokens(raw[a:b], ordered, rank)
                p = np.zeros(len(t.token), np.float32)
                for run, at, which in t.runs(np.arange(len(p)), BATCH):
                    p[which] = net.forward(run, at)
                rare = np.flatnonzero(t.token >= VOCABULARY)
                p[rare] -= log_total[t.token[rare] - VOCABULARY]
                held.append((t.words.counts, np.bincount(t.text, p, minlength=b - a), t.words.name[rare], t.text[rare] + a))
                size += sum(map(len, raw[a:b]))
                if size >= PART_BYTES or b == len(raw):
                    n, log_prob, name, text = (np.concatenate(x) for x in zip(*held))
                    distinct, at = np.unique(name, return_inverse=True)
                    one = lambda x, of: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, of))
                    ids = pa.ListArray.from_arrays(pa.array([0, b - first], pa.int32()), batch.column(0).slice(first, b - first))
                    blob = lambda x: pa.array([x.tobytes()], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([uuid.uuid4().hex]), ids, one(n, pa.int64()), one(log_prob, pa.float64()), blob(distinct), blob(at.astype(np.int32)), blob((text - first).astype(np.int32))],
                        ["part", "ids", "n_tokens", "log_prob", "names", "at", "text"])
                    held, size, first = [], 0, b

    shape = f"part string, ids array<{kind}>, n_tokens array<long>, log_prob array<double>, names binary, at binary, text binary"
    with bounded_batches(spark):
        parts = saved(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(tidy(scored), shape), "scored")
        if counts is None:
            return _rows(parts, id_col)
        logs = _within(parts, counts).groupBy("part").agg(F.sort_array(F.collect_list(F.struct("g", "logs"))).alias("logs"))

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
                out = []
                for k in range(len(batch)):
                    at, text = (np.frombuffer(own[c][k].as_buffer(), np.int32) for c in ("at", "text"))
                    logs = np.frombuffer(b"".join(x["logs"] for x in own["logs"][k].as_py() or ()), np.float32)
                    before = np.array(own["log_prob"][k].as_py())
                    out.append(before + np.bincount(text, logs[at], minlength=len(before)) if len(at) else before)
                yield with_columns(batch, {"log_prob": pa.array(out, pa.list_(pa.float64()))}).select(["ids", "n_tokens", "log_prob"])

        keep = ["part", "ids", "n_tokens", "log_prob", "at", "text"]
        whole = saved(parts.select(*keep).join(logs, "part", "left").mapInArrow(tidy(summed), f"ids array<{kind}>, n_tokens array<long>, log_prob array<double>"), "summed")
    return _rows(whole, id_col)


def _rows(parts: DataFrame, id_col: str) -> DataFrame:
    rows = parts.select(F.inline(F.arrays_zip("ids", "n_tokens", "log_prob"))).toDF("ids", "n_tokens", "log_prob")
    return rows.select(F.col("ids").alias(id_col), "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-log-likelihood of every document under a network trained on all of them."""
    docs = table(spark, sf_dir, "documents")
    with bounded_batches(spark):
        counts = saved(word_counts(docs), "words")
        names = vocabulary(docs, counts=counts)
        vector = train(docs, names)
    return score(docs, names, vector, counts=counts)
