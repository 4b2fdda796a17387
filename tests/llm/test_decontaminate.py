import hashlib
import random
import re

import duckdb
import numpy as np

from postura.llm import decontaminate as D

from . import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items):
    w, hit, names = split(text), set(), set()
    for name, item in items:
        v = split(item)
        k = min(10, len(v))
        for i in range(len(v) - k + 1 if k else 0):
            for j in range(len(w) - k + 1):
                if w[j : j + k] == v[i : i + k]:
                    hit |= set(range(j, j + k))
                    names.add(str(name))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def fixture(spark):
    rows = cases.documents()
    long = split(rows[1][1] + rows[2][1] + rows[4][1])
    items = [(1, " ".join(long[5:40])), (2, " ".join(long[20:33])), (10, " ".join(long[2:6])), (3, None), (4, ""), (5, "?? !!"), (6, " ".join(long[20:33])), (7, "changed"), (None, "x")]
    rows += [(800, "pre " + " ".join(long[5:18]) + " mid " + " ".join(long[12:40]) + " end", "en", "s", 1, 0.0, 0)]
    return rows, items, spark.createDataFrame(items, "item_id long, text string")


def test_matches_brute_force(spark):
    rows, items, bench = fixture(spark)
    items = [x for x in items if x[0] is not None]
    for block in (1 << 20, 200):  # one block, and several
        got = D.summary(D.matches(cases.frame(spark, rows), bench, block_bytes=block)).collect()
        have = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got)
        assert have == sorted((r[0] if r[0] is not None else -1, *brute(r[1], items)) for r in rows)


def test_longest_match_and_removal(spark):
    rows, items, bench = fixture(spark)
    docs = cases.frame(spark, rows)
    found = {r.doc_id: r._dc_found for r in D.matches(docs, bench).collect()}[800]
    assert max(m.words for m in found if m.item_id == "1") == 28
    clean = D.decontaminated(docs, bench)
    assert clean.columns == docs.columns and 800 not in {r.doc_id for r in clean.select("doc_id").collect()}
    assert D.decontaminated(docs, bench.limit(0)).count() == docs.count()
    assert D.decontaminated(docs.limit(0), bench).count() == 0


def test_items_without_an_id_count_as_in_sql(spark):
    rows, items, _ = fixture(spark)
    long = split(rows[1][1])
    items += [(None, " ".join(long[1:14])), (None, " ".join(split(rows[4][1])[:3]))]
    docs, bench = cases.frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = sorted(map(repr, (tuple(r[c] for c in columns) for r in D.summary(D.matches(docs, bench)).collect())))
    db = duckdb.connect()
    for name, shape, data in (("documents", "doc_id bigint, text varchar", [r[:2] for r in rows]), ("benchmark", "item_id bigint, text varchar", items)):
        db.execute(f"create table {name} ({shape})")
        db.executemany(f"insert into {name} values (?, ?)", data)
    want = db.execute(f"select {', '.join(columns)} from ({D.OP4_SQL})").fetchall()
    assert got == sorted(map(repr, want))
    assert any(r[5] and r[4] == hashlib.sha256(b"").hexdigest() for r in want)
    assert D.decontaminated(docs, bench).count() == sum(not r[5] for r in want)


def test_repeated_words_cost_no_more(spark):
    import time

    same = [(1, "word " * 50_000), (2, "a b " * 1500), (3, "word " * 12)]
    docs = [(1, "word " * 50_000), (2, "x " + "a b " * 5000 + "word " * 9), (3, "word " * 9 + "y " + "b a " * 8)]
    start = time.perf_counter()
    got = {r.doc_id: r for r in D.summary(D.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(same, "item_id long, text string"))).collect()}
    assert time.perf_counter() - start < 30
    assert [(got[k].n_hit, got[k].n_items) for k in (1, 2, 3)] == [(50_000, 2), (10_000, 1), (16, 1)]


def test_random_texts_of_few_words_equal_brute_force(spark):
    rng = random.Random(12)
    make = lambda n: " ".join(rng.choice(["a", "b", "c"]) if rng.random() < 0.8 else rng.choice(["a a", "a b a b a b", "q"]) for _ in range(n))
    items = [(i, make(rng.choice([1, 3, 9, 10, 11, 30, 80]))) for i in range(12)]
    docs = [(i, make(rng.choice([0, 5, 12, 60, 300]))) for i in range(60)]
    found = D.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).cache()
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.summary(found).collect())
    assert got == sorted((i, *brute(t, items)) for i, t in docs)
    texts, known = dict(docs), {str(i): split(t) for i, t in items}
    for r in found.collect():
        words = split(texts[r.doc_id])
        for m in r._dc_found:
            own = known[m.item_id]
            assert words[m.word : m.word + m.words] == own[m.item_word : m.item_word + m.words] and m.words >= min(10, len(own))
            # nothing in the item goes on longer from that place
            longest = max(next((k for k in range(min(len(own) - p, len(words) - m.word)) if own[p + k] != words[m.word + k]), min(len(own) - p, len(words) - m.word)) for p in range(len(own)))
            assert m.words == longest


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 100):
        for kinds in (1, 2, 5):
            v = rng.integers(0, kinds, n)
            assert D.suffix_array(v).tolist() == sorted(range(n), key=lambda i: v[i:].tolist())
