"""Token counts from an exact length histogram.

Documents are counted by encoded length; the histogram has one row a distinct
length, and suffix sums over it answer totals, quantiles and truncated totals
for every context limit without another look at the texts.

Defined results: a null or empty text has no tokens; repeated rows count each;
ties: documents of one length are one row; very long texts: whole, their tokens
take some 50 times their bytes in one task, and runs of white space of any
length are cut out first, as the encoder's pattern cannot match them; an empty
table has an empty histogram; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table, tidy

BLOCK = 1024
#: White space in a row that the encoder's pattern is not asked to match.
LONG_RUN = 10_000
#: What the pattern takes as white space (Python's own class holds four characters more).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{SPACE}]{{{LONG_RUN},}}")
_encoders: dict = {}


def encoder(path: str):
    """The byte-level BPE of a rank file, built once a worker."""
    if path not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def n_tokens(text: str, encoding) -> int:
    """Tokens of a whole text.

    Of a long run of white space the pattern takes all but the last character
    as one piece, or all of it at the text's end; so the text is cut there, and
    that piece goes to the merges as it is.
    """
    total = at = 0
    for run in _RUN.finditer(text) if len(text) >= LONG_RUN else ():
        end = run.end() - (run.end() < len(text))
        total += len(encoding.encode_ordinary(text[at : run.start()])) + len(encoding._encode_single_piece(text[run.start() : end]))
        at = end
    return total + len(encoding.encode_ordinary(text[at:]))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_lengths(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """One row a document: n_tokens."""
    path = path or default_path()

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = encoder(path)
        for pdf in batches:
            yield pd.DataFrame({"n_tokens": [n_tokens(t, encoding) if isinstance(t, str) else 0 for t in pdf["t"]]}, dtype="int64")

    return docs.select(F.col(text_col).alias("t")).mapInPandas(tidy(counted), "n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs)."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """The histogram with docs_at_least and tokens_at_least of each length.

    Sums run within blocks of BLOCK lengths and over the blocks' totals, so
    no task gets all lengths.
    """
    hist = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # one row a block of lengths
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t"),
        F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("all_tokens"),
    )
    return hist.withColumn("_d", F.sum("n_docs").over(inside)).withColumn("_t", F.sum("tokens").over(inside)).join(blocks, "block").select(
        "n_tokens", "n_docs", (F.col("_d") + F.col("d")).alias("docs_at_least"), (F.col("_t") + F.col("t")).alias("tokens_at_least"), "all_docs", "all_tokens",
    )


def answers(sums: DataFrame) -> DataFrame:
    """For each length as context limit: tokens left after cutting at it, and the share of documents not longer."""
    at_least = F.col("docs_at_least")
    return sums.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * at_least).alias("truncated_total"),
        ((F.col("all_docs") - at_least + F.col("n_docs")) / F.col("all_docs")).alias("share_not_longer"),
        "all_tokens",
    )


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """The least length that a share q of the documents does not exceed (one row)."""
    return answers(sums).filter(F.col("share_not_longer") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of documents with the answers for every context limit."""
    hist = saved(histogram(token_lengths(table(spark, sf_dir, "documents"))), "lengths")  # texts are encoded once
    return answers(suffix_sums(hist))
