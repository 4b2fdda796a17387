import pytest
import hashlib
import random

from postura.llm import repeats

from . import cases


def brute(rows, w=50):
    first, out = {}, []
    key = lambda r: float("inf") if r[0] is None else r[0]
    for r in rows:
        b = (r[1] or "").encode()
        for k in range(len(b) - w + 1):
            s = b[k : k + w]
            first[s] = min(first.get(s, key(r)), key(r))
    for r in rows:
        b = (r[1] or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - w + 1):
            if first[b[k : k + w]] < key(r):
                gone[k : k + w] = [True] * w
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((-1 if r[0] is None else r[0], len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def rows():
    rng = random.Random(6)
    out = [r for r in cases.documents() if len(r[1] or "") < 20_000]
    passage = cases.text(rng, "fr", 20)
    out += [(300 + i, cases.text(rng, "en", 12) + passage[: 60 + 7 * i] + cases.text(rng, "en", 5), "en", "s", 1, 0.0, 0) for i in range(12)]
    out += [(400, "ab" * 400, "en", "s", 1, 0.0, 0), (401, "x" + "ab" * 300, "en", "s", 1, 0.0, 0), (402, passage[:49], "fr", "s", 1, 0.0, 0), (399, "y" * 50, "", "", 1, 0.0, 0), (398, "y" * 50, "", "", 1, 0.0, 0)]
    return out


def digest(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 3000)
    assert digest(repeats.without_repeats(cases.frame(spark, rows()))) == brute(rows())


def test_parts_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 500)
    assert digest(repeats.without_repeats(cases.frame(spark, rows()), part_bytes=170)) == brute(rows())


def test_strings_of_thousands_of_bytes(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 6000)
    monkeypatch.setattr(repeats, "ROW_BYTES", 20_000)
    rng = random.Random(15)
    long = "".join(rng.choice("abcdé \0") for _ in range(3000))
    period = "xyzzy" * 300
    docs = []
    for i in range(14):
        cut = sorted(rng.sample(range(len(long)), 2))
        docs.append((i, "-" * rng.randint(0, 40) + long[cut[0] : cut[1]] + str(i) * rng.randint(0, 60) + period[rng.randint(0, 9) : rng.randint(40, 400)], "", "", 1, 0.0, 0))
    docs.append((None, long, "", "", 1, 0.0, 0))
    docs.append((7, long, "", "", 1, 0.0, 0))
    rng.shuffle(docs)
    assert digest(repeats.without_repeats(cases.frame(spark, docs))) == brute(docs)
    assert digest(repeats.without_repeats(cases.frame(spark, docs), width=64, part_bytes=900)) == brute(docs, 64)


def test_names_decide_nothing(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(repeats, "_mixed", lambda h: h * np.uint64(0))  # all strings have one name
    rng = random.Random(16)
    rows = [r[1].encode()[:400] for r in cases.documents()[:12] if r[1]]
    b = {"ids": [np.arange(len(rows)).tobytes()], "sizes": [np.array([len(x) for x in rows]).tobytes()], "starts": [np.zeros(len(rows), np.int64).tobytes()],
         "wholes": [np.array([len(x) for x in rows]).tobytes()], "rows": [np.arange(len(rows)).tobytes()], "data": [b"".join(rows)]}
    block = repeats.Block(b, 0, 50)
    mask = np.packbits(np.ones(len(block.data), bool)).tobytes()
    (e,) = block.entries(mask, [np.ones(256, bool)])
    assert len(e.names) >= len(set(map(bytes, e.around))) and rng
    bits = repeats.ranked(e.around, e.room[:, 0], e.room[:, 1], e.least, 50)
    strings: dict = {}
    for a, (x, y), d in zip(e.around, e.room, e.least):
        for shift in range(31):
            if x >= shift and y >= 50 - shift:
                key = bytes(a[30 - shift : 80 - shift])
                strings[key] = min(strings.get(key, d), d)
    for a, (x, y), d, bit in zip(e.around, e.room, e.least, bits):
        for shift in range(31):
            want = x >= shift and y >= 50 - shift and strings[bytes(a[30 - shift : 80 - shift])] < d
            assert bool(bit >> shift & 1) == want


def test_empty(spark):
    assert repeats.without_repeats(cases.frame(spark).limit(0)).count() == 0


def test_ids_of_any_type(spark):
    text = "a passage of more than fifty bytes that several documents share, word for word. "
    rows = [("a2", text), ("a0", text), ("a1", "x" + text), (None, text), ("é", text * 2), ("Z", None), ("a0", text)]
    df = spark.createDataFrame(rows, "name string, t string")
    got = {(r.name, r.n_bytes, r.n_removed) for r in repeats.without_repeats(df, id_col="name", text_col="t").collect()}
    order = {n: k for k, n in enumerate(sorted({n for n, _ in rows if n is not None}, key=lambda n: n.encode()))}
    whole = [(order.get(n), t) for n, t in rows]
    plain = spark.createDataFrame(whole, "doc_id long, text string")
    names = {k: n for n, k in order.items()} | {None: None}
    assert got == {(names[r.doc_id], r.n_bytes, r.n_removed) for r in repeats.without_repeats(plain).collect()}
    assert ("a0", len(text), 0) in got and ("a1", len(text) + 1, len(text)) in got and (None, len(text), len(text)) in got
    dates = df.selectExpr("date_add(date'2020-01-01', length(coalesce(name, ''))) as day", "t")
    assert repeats.without_repeats(dates, id_col="day", text_col="t").schema["day"].dataType.simpleString() == "date"


def test_blocks_are_dropped_if_it_fails(spark, monkeypatch):
    before = {t.name for t in spark.catalog.listTables()}
    monkeypatch.setattr(repeats, "_sorted_bucket", lambda *a: 1 / 0)
    df = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    with pytest.raises(ZeroDivisionError):
        repeats.without_repeats(df)
    assert {t.name for t in spark.catalog.listTables()} == before
