from pyspark.sql import functions as F

from postura.functions import labels as L


def test_links_paths_and_counts(spark):
    links = {"/activity": "/activity", "/activity#ev%201": "/activity#ev%201", "/captures?x=1": "/captures?x=1", "/activityx": "#", "https://x": "#", "javascript:1": "#", "/activity/ x": "#", "//activity": "#", None: "#", "/activity\n": "#"}
    got = spark.createDataFrame([(k, v) for k, v in links.items()], "h string, want string").select("want", L.safe_link("h").alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    paths = {"/srv/data/a/b.xml": "a/b.xml", "/srv/data": "data", "/srv/database/x": "x", "/srv/data/../etc/p": "p", "C:\\x\\y.txt": "y.txt", "/srv/data//a//": "a/", "": ""}
    got = spark.createDataFrame([(k, v) for k, v in paths.items()], "p string, want string").select("p", "want", L.client_path("p", "/srv/data/").alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    groups = spark.sql("select map('ports', array('/srv/data/a', '/b/c'), 'none', array()) as g").select(L.client_paths("g", "/srv/data").alias("g")).first().g
    assert groups == {"ports": ["a", "c"], "none": []}
    row = spark.sql("select 1 as one, 12345 as many, timestamp'2026-03-04 23:00:00' as at").select(L.count_noun("one", "host").alias("a"), L.count_noun("many", "host").alias("b"), L.was_were("one").alias("c"), L.file_date("at").alias("d")).first()
    assert tuple(row) == ("1 host", "12,345 hosts", "was", "2026-03-04")


def test_hidden_columns_and_names(spark):
    rows = spark.sql("select * from values ('1.2.3.4', 'nas', 80), ('1.2.3.5', '', 22), (null, null, 1) as t(ip, hostname, port)")
    assert [tuple(r) for r in L.hidden(rows).collect()] == [("[REDACTED]", "[REDACTED]", 80), ("[REDACTED]", None, 22), ("[REDACTED]", None, 1)]
    assert L.hidden(rows.select("port")).columns == ["port"]
    names = spark.sql("select * from values (' A ', 'h'), ('', 'h1, h2'), (null, ';x'), (null, null) as t(d, h)").select(L.inventory_name("d", "h")).collect()
    assert [r[0] for r in names] == ["A", "h1", None, None]
    nodes = spark.createDataFrame([("a",), ("e",), ("o",), ("broadcast",), ("x",)], "node string")
    devices = spark.createDataFrame([("a", None, None, "02:00:00:00:ab:cd")], "id string, name string, role string, mac string")
    ends = spark.createDataFrame([("e", "203.0.113.9", False), ("o", "(12 more)", True)], "id string, ip string, is_aggregate boolean")
    got = {r.node: r.label for r in L.node_labels(nodes, devices, ends).collect()}
    assert got == {"a": "Device …ab:cd", "e": "203.0.•.•", "o": "Other internet endpoints (12 more)", "broadcast": "Everyone (broadcast)", "x": "Unknown"}
    assert L.node_labels(nodes, devices, ends, reveal=True).filter("node = 'e'").first().label == "203.0.113.9"
