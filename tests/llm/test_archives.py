import base64
import glob
import gzip
import hashlib
import random

import pytest

from postura.llm import archives as A

SHAPE = "page_id long, url string, html string, digest string, at string, top string, bytes string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SHAPE)


def pages():
    rng = random.Random(2)
    odd = ["", "\r\n\r\n", "\r\n", "\n", "a\r\n\r\nb", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "é\n\n\n", "x" * 300_000, "\r\n\r\r\n\r\n" * 20_000, "<p>\n" * 5000, "\x00\x01", None]
    rows = [(i, f"http://h{i % 7}.example.org/p?{i % 11}#f", rng.choice(odd) if i % 3 else f"text {rng.random()}\n") for i in range(200)]
    rows += [(300 + i, "http://hot.example.org/", "the same") for i in range(150)]
    rows += [(5, "http://x.org/a b\n\t", "once"), (5, "http://x.org/a b\n\t", "once"), (5, "http://x.org/a b\n\t", "once"), (None, "http://x.org", "nobody's"), (None, "http://x.org", "nobody's"), (None, None, "no url"), (900, None, "no url"), (901, "no scheme", "z"), (902, "", "y"), (1 << 60, "http://big.org", "the same"), (-4, "http://neg.org", "n")]
    return rows


def brute(rows, least=0):
    """Responses and revisits, group by group."""
    groups, out = {}, []
    for i, url, html in rows:
        groups.setdefault(html or "", []).append((i, url))
    for html, own in groups.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""), reverse=True)
        raw = html.encode()
        for k, (i, _) in enumerate(own):
            again = k > 0 and len(raw) >= least
            out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", own[0][0] if again else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "out")
    A.write_archives(frame(spark, pages()).repartition(5), path)
    return path


@pytest.mark.parametrize("least", [0, 1, 9])
def test_round_trip_equals_brute_force(spark, tmp_path, least):
    path = str(tmp_path / "out")
    A.write_archives(frame(spark, pages()).repartition(3), path, min_bytes=least)
    got = A.read_archives(spark, path)
    assert got.filter("error is not null").count() == 0
    assert sorted(((None if r.page_id is None else int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, None if r.refers_to is None else int(r.refers_to)) for r in got.collect()), key=str) == brute(pages(), least)


def test_files_are_plain_warc(spark, written):
    ids, responses = [], {}
    for name in glob.glob(f"{written}/*.gz"):
        data, at = gzip.open(name).read(), 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
            assert data[at : at + 10] == b"WARC/1.1\r\n"
            size = int(head["Content-Length"])
            block = data[end + 4 : end + 4 + size]
            assert data[end + 4 + size :][:4] == b"\r\n\r\n"
            ids.append(head["WARC-Record-ID"])
            if head["WARC-Type"] == "response":
                payload = block.split(b"\r\n\r\n", 1)[1]
                assert head["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
                responses[head["WARC-Record-ID"]] = payload
            at = end + 4 + size + 4
    assert len(ids) == len(set(ids)) == len(pages())
    assert sorted(responses.values()) == sorted({(h or "").encode() for _, _, h in pages()})


def test_histories_are_in_order(spark, written):
    entries = A.read_archives(spark, written)
    got = sorted(A.histories(entries).collect(), key=lambda r: r.place)
    assert [r.place for r in got] == list(range(len(pages())))
    keys = [(r.url_key.encode(), r.at, r.file, r.offset) for r in got]
    assert keys == sorted(keys)
    assert {r.url_key for r in got} >= {"", "org.example.hot.)/", "org.x.)/a%20b%0A%09", "org.example.h1.)/p?1"}
    hot = [int(r.page_id) for r in got if r.url_key == "org.example.hot.)/"]
    assert hot == list(range(300, 450))


def test_damaged_archives_give_errors(spark, written, tmp_path):
    data = gzip.open(sorted(glob.glob(f"{written}/*.gz"), key=lambda n: len(gzip.open(n).read()))[-1]).read()
    whole = len(list(A.entries_of(("f", x) for x in data.split(b"\n"))))
    cut = list(A.entries_of(("f", x) for x in data[: len(data) // 2].split(b"\n")))
    assert cut[-1]["error"] and len(cut) < whole and not any(x["error"] for x in cut[:-1])
    noise = list(A.entries_of(("f", x) for x in b"garbage\nWARC/1.1\r\nWARC-Type: response\r\n\r\n".split(b"\n")))
    assert [x["error"] for x in noise] == ["no record starts here", "no length"]
    at = data.index(b"HTTP/1.1 200 OK")
    changed = next(x for x in A.entries_of(("f", x) for x in (data[:at] + data[at:].replace(b"text ", b"tExt ", 1)).split(b"\n")) if x["error"])
    assert changed["error"] == "payload differs from its digest"
    # a file of several gzip members, as archives are kept elsewhere
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(gzip.compress(data[: len(data) // 3]) + gzip.compress(data[len(data) // 3 :]))
    assert A.read_archives(spark, str(tmp_path / "in")).filter("error is null").count() == whole


def test_text_ids_dates_and_empty(spark, tmp_path):
    rows = [("", "http://a.org/", "x", "2020-01-02 03:04:05"), ("%", "http://a.org/", "y", None), ("a:b >é", "http://a.org/", "x", "2019-01-02 03:04:05"), (None, "http://a.org/", "z", None)]
    df = spark.createDataFrame(rows, "name string, link string, body string, day string")
    A.write_archives(df, str(tmp_path / "a"), id_col="name", url_col="link", payload_col="body", date_col="day")
    got = A.histories(A.read_archives(spark, str(tmp_path / "a"))).orderBy("place").collect()
    assert [(r.page_id, r.at, r.record_type, r.refers_to) for r in got][2:] == [("a:b >é", "2019-01-02T03:04:05Z", "response", None), ("", "2020-01-02T03:04:05Z", "revisit", "a:b >é")]
    assert {r.page_id for r in got[:2]} == {"%", None}
    A.write_archives(frame(spark, []), str(tmp_path / "b"))
    assert A.histories(A.read_archives(spark, str(tmp_path / "b"))).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 64])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(rng.randint(0, 50) for _ in range(rng.choice([0, 1, 5, 40]))) for _ in range(k)]
    got = list(A.LoserTree(runs))
    assert [runs[r][i] for r, i in got] == sorted(x for run in runs for x in run)
    assert got == sorted(got, key=lambda x: (runs[x[0]][x[1]], x[0], x[1]))  # ties go by run
