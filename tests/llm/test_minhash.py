import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from postura.llm import minhash as M

from . import cases
from .test_decontaminate import split


def bag(text):
    w = split(text)
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def likeness(x, y):
    """Probability Jaccard by its definition."""
    both = {*x, *y}
    return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in both) for d in x.keys() & y.keys())


def brute(rows):
    """Least id of each id's class."""
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    sets = {r[0]: bag(r[1]) for r in rows if r[0] is not None}
    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        common = x.keys() & y.keys()
        if not x or not y or min(sum(z[d] for d in common) / z.total() for z in (x, y)) < 0.79:  # an upper bound
            continue
        if (len(common) / len(x.keys() | y.keys()) if max(x.values()) == max(y.values()) == 1 else likeness(x, y)) >= 0.8:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in sets}


def variants(rng, n, size, changes):
    """A text, copies with a few words changed, and a chain that drifts away."""
    base = cases.words(rng, "en", size)
    out, drift = [], list(base)
    for _ in range(n):
        v = list(base)
        for _ in range(rng.randint(0, changes)):
            v[rng.randrange(size)] = "x" + str(rng.random())
        out.append(" ".join(v))
        drift[rng.randrange(size)] = "y" + str(rng.random())
        out.append(" ".join(drift))
    return out


def test_classes_match_brute_force(spark):
    rng = random.Random(4)
    texts = variants(rng, 60, 120, 6) + variants(rng, 8, 40, 2) + [cases.text(rng, "fr", 80) + "shared passage of some words here to see " * 3 for _ in range(20)]
    rows = cases.documents() + [(1000 + i, t, "en", "s", 1, 0.0, 0) for i, t in enumerate(rng.sample(texts, len(texts)))]
    got = M.near_duplicates(cases.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want


def test_blocks_and_more_leaders_give_the_same(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, t, "en", "s", 1, 0.0, 0) for i, t in enumerate(variants(rng, 50, 100, 7))]
    want = brute(rows)
    monkeypatch.setattr(M, "LEFT_BLOCK", 3)
    monkeypatch.setattr(M, "RIGHT_BLOCK", 5)
    monkeypatch.setattr(M, "BLOCK_COPIES", 0)
    assert {r.doc_id: r.class_id for r in M.near_duplicates(cases.frame(spark, rows)).collect()} == want


def test_weights_count(spark):
    rng = random.Random(12)
    line, other = " ".join(cases.words(rng, "en", 9)), " ".join(cases.words(rng, "en", 60))
    texts = [f"{(line + ' ') * k}{other}" for k in (1, 2, 3, 8, 9, 10, 40, 44, 200)] + [other, f"{other} {other}", line, f"{line} {line}"]
    texts += variants(rng, 10, 60, 4) + [t + " " + t for t in variants(rng, 10, 60, 4)]
    rows = [(i, t, "en", "s", 1, 0.0, 0) for i, t in enumerate(texts)]
    want = brute(rows)
    assert len(set(want.values())) < len(rows) - 5 and want[3] != want[8]  # how often a line is there makes a difference
    assert {r.doc_id: r.class_id for r in M.near_duplicates(cases.frame(spark, rows)).collect()} == want
    x, y = bag(texts[3]), bag(texts[4])
    names = {d: k for k, d in enumerate({*x, *y})}
    side = lambda z: tuple(np.array(c) for c in zip(*sorted((names[d], float(n)) for d, n in z.items())))
    assert abs(M.probability_jaccard(*side(x), *side(y)) - likeness(x, y)) < 1e-9


def test_recall_of_every_fiftieth_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bags = {r.doc_id: bag(r.text) for r in docs.collect() if r.text}
    got = {r.doc_id: r.class_id for r in M.near_duplicates(docs).collect()}
    links = found = 0
    for a in (i for i in bags if i % 50 == 0):
        for b in bags:
            x, y = bags[a], bags[b]
            common = x.keys() & y.keys()
            if a != b and common and min(sum(z[d] for d in common) / z.total() for z in (x, y)) > 0.79 and likeness(x, y) >= 0.8:
                links += 1
                found += got[a] == got[b]
    assert links and found >= 0.9 * links


def test_deduplicated_keeps_one_of_each(spark):
    docs = cases.frame(spark)
    kept = M.deduplicated(docs)
    assert kept.columns == docs.columns
    classes = defaultdict(set)
    for i, c in brute(cases.documents()).items():
        classes[c].add(i)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(classes)
    assert M.deduplicated(docs.limit(0)).count() == 0


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    names = rng.integers(1, 2**63, 900).astype(np.uint64)
    a, b = names[:700], names[100:]
    wa, wb = rng.integers(1, 6, 700).astype(float), np.ones(800)
    wb[:600] = wa[100:]
    sig = M.signatures(np.concatenate([a, b]), np.repeat([0, 1], [700, 800]), np.concatenate([wa, wb]), 2, m=4000)
    x, y = dict(zip(a, wa)), dict(zip(b, wb))
    want = sum(1 / sum(max(x.get(k, 0) / x[d], y.get(k, 0) / y[d]) for k in {*x, *y}) for d in x.keys() & y.keys())
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_every_class_keeps_a_row_whatever_its_ids(spark):
    rng = random.Random(6)
    base = cases.words(rng, "en", 80)
    near = " ".join(["changed", *base[1:]])
    big = 2**60 + 1
    texts = [(1, "one text"), (1, "quite another text"), (None, "without an id"), (None, "without an id"), (None, "also without"), (2, " ".join(base)), (None, near), (2, "third, under two"), (7, near), (big, "large id"), (None, None), (3, None)]
    docs = cases.frame(spark, [(i, t, "en", "s", 1, 0.0, 0) for i, t in texts])
    kept = sorted(((r.doc_id or 0, r.text or "") for r in corpus_pipeline.near_dedup(spark, docs, "").collect()))
    assert kept == sorted([(1, "one text"), (1, "quite another text"), (0, "without an id"), (0, "also without"), (2, " ".join(base)), (2, "third, under two"), (big, "large id"), (0, ""), (3, "")])
    got = M.near_duplicates(docs, kept_col="kept").collect()
    assert len(got) == len(texts) and sum(r.kept for r in got) == len(kept) + 1  # of the equal rows both
    assert sorted((r.doc_id or 0) for r in got if r.class_id == 2) == [0, 2, 2, 7]
