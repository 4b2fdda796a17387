import numpy as np

from postura.llm import scoring
from postura.llm.words import Words, encoded

from . import cases


def test_distributions_are_normalised_and_gradients_right():
    net = scoring.Net()
    rng = np.random.default_rng(3)
    net.vector += rng.normal(0, 0.3, len(net.vector)).astype(np.float32)
    around = rng.integers(0, scoring.PAD, 4)
    runs = [np.array([*around[:2], k, *around[2:]]) for k in range(scoring.PAD)]
    p = np.array([net.forward(run, np.array([0]))[0] for run in runs])
    assert abs(np.exp(p.astype(float)).sum() - 1) < 1e-3
    run, at = rng.integers(0, scoring.PAD, 14), np.array([0, 1, 4, 7, 9])
    g = net.gradient(run, at)
    for i in np.argsort(-np.abs(g))[:8]:
        old, h = net.vector[i], 1e-2
        loss = []
        for x in (old + h, old - h):
            net.vector[i] = x
            loss.append(-net.forward(run, at).astype(float).mean())
        net.vector[i] = old
        assert abs((loss[0] - loss[1]) / (2 * h) - g[i]) < 0.05 * abs(g[i]) + 1e-3


def test_trained_model_beats_word_frequencies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = scoring.vocabulary(docs)
    vector = scoring.train(docs, names, rounds=3)
    rows = scoring.score(docs, names, vector).toPandas()
    before = scoring.score(docs, names, scoring.Net().vector).toPandas()
    assert rows["log_prob"].sum() > before["log_prob"].sum() + 0.5 * rows["n_tokens"].sum()


def test_scores_sum_each_token_from_both_sides(spark):
    docs = cases.frame(spark)
    names = scoring.vocabulary(docs)
    net = scoring.Net()
    rows = scoring.score(docs, names, net.vector).collect()
    ordered, rank = scoring._index(names)
    for r, text in ((r, t) for r in rows for d, t, *_ in cases.documents()[:8] if r.doc_id == d):
        t = scoring.Tokens(encoded([text]), ordered, rank)
        ids = [scoring.PAD] * 2 + t.token.tolist() + [scoring.PAD] * 2
        want = sum(float(net.forward(np.array(ids[k : k + 5]), np.array([0]))[0]) for k in range(len(t.token)))
        assert abs(r.log_prob - want) < 1e-2 * max(1, r.n_tokens) ** 0.5 and r.n_tokens == len(Words(encoded([text])).name)
    odd = {r.doc_id: r for r in rows}
    assert odd[62].n_tokens == 0 and odd[62].log_prob == 0 and odd[62].mean_log_prob is None
    assert scoring.score(docs.limit(0), names, net.vector).count() == 0


def test_words_of_a_class_share_its_probability(spark):
    docs = cases.frame(spark)
    counts = scoring.word_counts(docs)
    names = scoring.vocabulary(docs, size=50, counts=counts)
    net = scoring.Net()
    plain = sorted(scoring.score(docs, names, net.vector).toPandas().astype({"doc_id": float}).fillna(-1).values.tolist())
    whole = sorted(scoring.score(docs, names, net.vector, counts=counts).toPandas().astype({"doc_id": float}).fillna(-1).values.tolist())
    n = {}
    texts = {d if d is not None else -1: Words(encoded([t])).name.tolist() for d, t, *_ in cases.documents()}
    for _, t, *_ in cases.documents():
        for w in Words(encoded([t])).name.tolist():
            n[w] = n.get(w, 0) + 1
    total = {}
    known = set(names.tolist())
    for w in n.keys() - known:
        total[w % scoring.OTHERS] = total.get(w % scoring.OTHERS, 0) + n[w]
    assert len(total) > 1 and len(whole) == len(plain) == len(cases.documents())
    for a, b in zip(plain, whole):
        want = sum(np.log(n[w] / total[w % scoring.OTHERS]) for w in texts[a[0]] if w not in known) if a[1] and a[1] < 1000 else None
        assert a[:2] == b[:2] and (want is None or abs(b[2] - a[2] - want) < 1e-3 * max(1, a[1]))
    assert scoring.score(docs.limit(0), names, net.vector, counts=scoring.word_counts(docs.limit(0))).count() == 0


def test_rounds_learn_from_every_token_once():
    t = scoring.Tokens(encoded(["a b c d e f g " * 30, "", "x y z"]), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    seen = np.concatenate([t.masked(turn, 3) for turn in range(3)])
    assert sorted(seen.tolist()) == list(range(len(t.token)))
