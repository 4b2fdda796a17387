"""Texts of millions of one character, for operators that cut texts by patterns."""

import random

import pytest

from postura.llm import packing, tokens

N = 2_000_000
RUNS = {"blanks": " " * N, "line feeds": "\n" * N, "letters": "a" * N, "digits": "7" * N, "wide blanks": "　" * (N // 2), "mixed": "a" + " " * N + "b" + "\n" * N + "　c" + "\t" * N, "ends in a word": " " * N + "word"}


@pytest.mark.parametrize("kind", RUNS)
def test_counts_of_long_runs(spark, kind):
    docs = spark.createDataFrame([(RUNS[kind],), ("short text",), (None,)], "text string")
    got = sorted(r.n_tokens for r in tokens.token_lengths(docs).collect())
    assert got[0] == 0 and got[1] == 2 and got[2] > 0


def test_cutting_at_runs_changes_no_count():
    rng = random.Random(1)
    encoding = tokens.encoder(tokens.default_path())
    spaces = [" ", "\n", "\t", "\r\n", " ", "　", "\x1c", "\x85", "  "]
    for _ in range(300):
        text = "".join(rng.choice(spaces) * rng.choice([1, 2, 11_000, 10_001]) if rng.random() < 0.5 else rng.choice(["a", "word", "7", "!", "é", "中", "'s", "\x1d"]) for _ in range(rng.randint(1, 5)))
        assert tokens.n_tokens(text, encoding) == len(encoding.encode_ordinary(text))


@pytest.mark.parametrize("kind", ["blanks", "letters", "mixed"])
def test_packing_of_long_runs(spark, kind):
    docs = spark.createDataFrame([(1, RUNS[kind])], "doc_id long, text string")
    rows = packing.token_pieces(docs).collect()
    ids = packing.encoder(packing.default_path()).tokenizer.encode(RUNS[kind][:1000], add_special_tokens=False).ids
    assert sum(r.length for r in rows) >= 1 + (len(ids) > 0) and {r.start % packing.CAPACITY for r in rows} == {0}
