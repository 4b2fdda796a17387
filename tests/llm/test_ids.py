"""Ids above 2**53 beside null ones, and columns with clashing names, come through every operator unharmed."""

from collections import Counter

import pytest

import corpus_pipeline
from postura.llm import decontaminate, language, minhash, packing, private, repeats, scoring

from . import cases

BIG = 2**60
IDS = [BIG + 1, None, BIG + 3, None, BIG + 5]
CLASH = ["_dc_words", "_DC_Found", "_pii_row", "_pii_found", "_pii_swaps", "lang_pred", "row", "name", "key", "words", "n"]


def docs(spark, extra=True):
    rows = [(i, f"call 743-555-{k:04} " + text + " end", "en", "s", 7) for k, (i, (_, text, *_)) in enumerate(zip(IDS, [r for r in cases.documents() if len(r[1] or "") > 600]))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASH if extra else ():
        df = df.selectExpr("*", f"cast(null as bigint) as `{c}`") if c != "row" else df.selectExpr("*", f"if(doc_id is null, null, {BIG} + 7) as `row`")
    return df


@pytest.mark.parametrize("operator", [
    lambda d: scoring.score(d, scoring.vocabulary(d), scoring.Net().vector),
    lambda d: language.predict(d, language.fit(d)),
    lambda d: decontaminate.matches(d, d.selectExpr("1L as item_id", "'no such words here' as text")),
    lambda d: repeats.without_repeats(d),
    lambda d: minhash.near_duplicates(d),
    lambda d: private.pseudonymised(d, b"k"),
], ids=["op1", "op2", "op4", "op8", "op9", "op10"])
def test_ids_of_every_row(spark, operator):
    assert Counter(r.doc_id for r in operator(docs(spark)).collect()) == Counter(IDS)


def test_packed_ids(spark):
    assert {r.doc_id for r in packing.packed(docs(spark)).collect()} == set(IDS)
    text = docs(spark).selectExpr("concat('x', doc_id) as doc_id", "text")
    assert {r.doc_id for r in packing.packed(text).collect()} == {i and f"x{i}" for i in IDS}


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_ids_and_columns(spark, stage, tmp_path):
    d = docs(spark)
    spark.createDataFrame([(1, "no such words here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = stage(spark, d, str(tmp_path))
    assert out.columns == d.columns
    rows = out.collect()
    assert Counter(r.doc_id for r in rows) == Counter(IDS)
    assert all(r.row == (None if r.doc_id is None else BIG + 7) for r in rows)


def test_words_are_compared_as_bytes(spark, monkeypatch):
    from postura.llm import words

    monkeypatch.setattr(words, "mixed", lambda h: h * 0 + 7)  # every word has the same name
    import numpy as np

    tests = decontaminate.Suffixes([("a", "one two three"), ("b", "four five")], 10)
    w = words.Words(words.encoded(["x one two three y four six"]))
    ranks, text = tests.ranks(w)
    which, at = tests.search(ranks)
    assert len(which) > 1
    got = decontaminate._verified(tests, w, 0, which, at - (w.first[0]))
    assert [tuple(map(int, r)) for r in got] == [(0, 0, 1, 3)] and isinstance(which, np.ndarray)


def test_other_tokenizers_are_encoded_as_they_say(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello world, it's 12 o'clock", "", "a  b\n"]
    t = Tokenizer.from_file(path)
    assert [x.tolist() for x in packing.ChunkEncoder(path).encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
