"""Corpus preparation in five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written
as Parquet and read again for the next one.  All but the last keep the
columns of documents, whatever their names.

Defined results: a null or empty text fails the quality rules and goes; rows
with a null id are kept or dropped by their texts alone, a class of near copies
keeps the row of the least id and a null one only if it has no other; repeated
rows are copies of each other, so one stays; ties: of rows of one id and text any
one, they are the same; very long texts go through whole, in one task each; an
empty table gives an empty result of every stage, and an empty benchmark leaves
all documents in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postura.llm import decontaminate, minhash, packing, private, quality
from postura.llm.common import saved, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules."""
    return quality.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least id, or one without an id if all are."""
    return minhash.deduplicated(docs, null_ids=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; n_chars follows the text."""
    out = private.pseudonymised(docs, private.session_key(spark))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("surrogates", surrogates),
    ("best_fit_packing", best_fit_packing),
]
#: Near copies, suffix arrays, surrogates and tokens are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
