"""Language identification with language-bitmask n-gram filters.

One Bloom filter holds the n-grams of all languages, bit-sliced: a slot is a
mask with one bit a language (a word for each 64 of them), and the AND of an n-gram's slots is the mask of
all languages that contain it.  Per document the masks' bits are counted by
language, the counts are corrected for the filter's false positives, and the
largest share decides.

A language contains the n-grams that make up at least MIN_SHARE of its
training n-grams, so at most 1 / MIN_SHARE of each order: the filter's size
does not depend on the corpus.  It is fitted on labelled rows only, at most
about TRAIN_DOCS of each language (chosen by a hash of the id), whole texts.

Defined results: null text or one without a letter: "und", score 0; ties go to
the first language by name; nothing to learn from: "und"; null id: predicted,
never learned from; repeated rows are judged each by itself; very long texts:
whole, their n-grams take some 100 times their bytes in one task; an empty
table gives an empty result; other columns are kept, but for lang_pred and
score, which are replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table, texts_of, tidy, with_columns

ORDERS = (3, 4)
MIN_SHARE = 2e-5
#: Bound on the labelled rows of a language that the filter is fitted on.
TRAIN_DOCS = 20_000
SLOTS = 1 << 21
SLICE_CHARS = 1 << 20
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
    return _letters


def slices(texts: list[str], size: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts with about so many characters."""
    first = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def grams(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, hash, index of the text) of all n-grams of letters; a space stands for a run of anything else."""
    chars = np.frombuffer(" ".join(["", *(t.lower() for t in texts), ""]).encode("utf-32-le", "replace"), np.uint32)
    sizes = np.array([len(t.lower()) for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    owner = np.concatenate([[0], owner])[: len(chars)]
    letter = _letter_table()[chars]
    keep = letter | np.concatenate([[True], letter[:-1]])
    chars, owner, letter = np.where(letter, chars, 32)[keep].astype(np.uint64), owner[keep], letter[keep]
    for n in ORDERS:
        m = len(chars) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        inside = np.ones(m, bool)
        for k in range(n):
            h = (h ^ chars[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if 0 < k < n - 1:
                inside &= letter[k : k + m]
        yield n, h[inside], owner[1 : 1 + m][inside]


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h & np.uint64(SLOTS - 1), (h >> np.uint64(40)) & np.uint64(SLOTS - 1)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """(languages, slots): the filter of the labelled rows."""
    rows = labelled.select(F.col(id_col).alias("i"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna(subset=["text", "lang"])
    n = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(n)
    if not langs:
        return [], np.zeros((SLOTS, 1), np.uint64)
    share = F.create_map(*[x for g in langs for x in (F.lit(g), F.lit(min(1.0, train_docs / n[g])))])
    rows = rows.filter(F.pmod(F.xxhash64("i"), F.lit(1 << 53)) / float(1 << 53) < share[F.col("lang")])

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                texts = part["text"].tolist()
                for a, b in slices(texts):
                    for order, h, _ in grams(texts[a:b]):
                        g, c = np.unique(h, return_counts=True)
                        yield pd.DataFrame({"lang": lang, "n": order, "gram": g.view(np.int64), "c": c})

    by_gram = rows.select("text", "lang").mapInPandas(counted, "lang string, n int, gram long, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    by_gram = saved(by_gram, "grams")
    totals = by_gram.groupBy("lang", "n").agg(F.sum("c").alias("all"))
    # at most 1 / MIN_SHARE rows of each language and order
    chosen = by_gram.join(F.broadcast(totals), ["lang", "n"]).filter(F.col("c") >= MIN_SHARE * F.col("all")).select("lang", "gram").toPandas()
    bits = np.zeros((SLOTS, -(-len(langs) // 64)), np.uint64)
    for lang, part in chosen.groupby("lang"):
        word, bit = divmod(langs.index(lang), 64)
        for s in _slots(part["gram"].to_numpy(np.int64).view(np.uint64)):
            bits[s, word] |= np.uint64(1 << bit)
    return langs, bits


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """docs' columns but the text, with lang_pred and score (which replace columns of these names)."""
    langs, bits = model
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bits)  # SLOTS words, whatever the corpus
    fill = np.array([float(((bits[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()) for k in range(len(langs))])
    wrong = np.minimum(fill**2, 0.99)
    rest = [f for f in docs.schema.fields if f.name not in (text_col, "lang_pred", "score")]
    schema = type(docs.schema)(list(rest)).add("lang_pred", "string").add("score", "double")

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        for batch in batches:
            texts = [t or "" for t in texts_of(batch, text_col)]
            hits = np.zeros((len(texts), len(langs)))
            total = np.zeros(len(texts))
            for a, b in slices(texts):
                for _, h, owner in grams(texts[a:b]):
                    x, y = _slots(h)
                    masks = slots[x] & slots[y]
                    total[a:b] += np.bincount(owner, minlength=b - a)[: b - a]
                    for k in range(len(langs)):
                        hits[a:b, k] += np.bincount(owner, (masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1), minlength=b - a)[: b - a]
            letters = _letter_table()
            some = np.array([any(letters[ord(c)] for c in t[:64]) or any(letters[ord(c)] for c in t) for t in texts], bool)
            share = np.clip((hits - total[:, None] * wrong) / (1 - wrong), 0, None)
            names, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if langs:
                best = share.argmax(axis=1)
                top, whole = share[np.arange(len(texts)), best], share.sum(axis=1)
                names[some] = np.array(langs, object)[best][some]
                score[some] = (top / np.maximum(whole, 1e-9)).clip(0, 1)[some]
            kept = batch.select([f.name for f in rest]) if rest else batch.select([])
            yield with_columns(kept, {"lang_pred": pa.array(names.tolist(), pa.string()), "score": pa.array(score)})

    return docs.mapInArrow(tidy(predicted), schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents, learned from four fifths of the ids."""
    docs = table(spark, sf_dir, "documents")
    left = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    model = fit(docs.filter(left != 0))
    rows = docs.select("doc_id", F.coalesce(left == 0, F.lit(False)).alias("held_out"), "text")
    return predict(rows, model)
