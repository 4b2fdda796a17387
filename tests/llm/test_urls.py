import random

from postura.llm import urls


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        after = url.split("://", 1)[1]
        end = min((after.find(c) for c in "/?#" if c in after), default=len(after))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in after[:end])
        rest = after[end:]
        if rest.startswith("/"):
            path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_matches_brute_force(spark):
    rng = random.Random(3)
    hosts = ["org", "example.org", "a.example.org", "b.a.example.org", "xample.org", "com", "x.com", "org.com", "net", "EXAMPLE.org"]
    rows = [(i, f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/es/', '/es/1', '/en/1', '/en/12?x=/es/', '/fr/a#b', '?q=/fr/', '#/de/', '/de/x'])}") for i in range(400)]
    rows += [(400, None), (401, ""), (402, "no scheme"), (403, "://"), (404, "x:///es/"), (None, "http://org/")] + [(500 + i, "http://hot.example.org/es/") for i in range(200)]
    rules = [*urls.GIVEN_RULES, ("block", "a.example.org", "/"), ("allow", "example.org", "/es/1")]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    got = sorted(((r.page_id if r.page_id is not None else -1), r.host, r.path, r.rule or "", r.verdict) for r in urls.judged(pages, rules).collect())
    want = sorted(((i if i is not None else -1), *(x or "" for x in brute(u, rules))) for i, u in rows)
    assert got == want


def test_many_rules_and_a_row_repeated_often(spark):
    rules = [("block" if i % 3 else "allow", f"{'a.' * (i % 3)}h{i}.org", "/x/" if i % 2 else "/") for i in range(25_000)]
    rows = [(1, "http://a.h7.org/x/1")] * 2000 + [(i, f"http://a.a.h{i}.org/x/") for i in range(0, 25_000, 50)] + [(3, "http://z.net/")]
    by_host = {h: (v, p) for v, h, p in rules}
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(4)
    got = urls.judged(pages, spark.createDataFrame(rules, "verdict string, host string, path string"))
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        h = r.host
        fits = [h[k:] for k in range(len(h)) if (k == 0 or h[k - 1] == ".") and h[k:] in by_host and r.path.startswith(by_host[h[k:]][1])]
        want = max(fits, key=lambda x: len(x) + len(by_host[x][1]), default=None)
        assert (r.rule, r.verdict) == ((want + by_host[want][1], by_host[want][0]) if want else (None, "allow"))
    assert got.groupBy("rule").count().filter("rule is null").count() <= 1
    assert urls.judged(pages, []).filter("verdict <> 'allow' or rule is not null").count() == 0


def test_empty(spark):
    assert urls.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_many_nested_rules_of_one_host(spark):
    import time

    rng = random.Random(4)
    paths = ["/" + "/".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) + rng.choice(["", "/", "x"]) for _ in range(30_000)]
    rules = [(rng.choice(["allow", "block"]), rng.choice(["one.org", "a.one.org", "org"]), p) for p in paths]
    best = {}
    for v, h, p in rules:
        best[h, p] = max(v, best.get((h, p), ""))
    urls_ = [f"http://{rng.choice(['a.one.org', 'one.org', 'z.a.one.org', 'two.org', 'org'])}/" + "/".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(20_000)]
    pages = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string").repartition(4)
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    start = time.perf_counter()
    got = urls.judged(pages, table).collect()
    took = time.perf_counter() - start
    assert took < 60 and len(got) == len(urls_)
    for r in got:
        fits = [(len(h + r.path[:n]), len(h), h + r.path[:n], best[h, r.path[:n]]) for h in ("one.org", "a.one.org", "org") if r.host == h or r.host.endswith("." + h) for n in range(len(r.path) + 1) if (h, r.path[:n]) in best]
        assert (r.rule, r.verdict) == (max(fits)[2:] if fits else (None, "allow"))
