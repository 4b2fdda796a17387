"""URL filters as two sort-merge range joins (built-in functions only).

The canonical key of a host is its labels reversed, each followed by a stop:
m.example.org is "org.example.m.".  A host with rules then covers exactly the
interval of keys that start with its own, and a rule covers, among the URLs at
or below its host, the interval of paths that start with its path.  Intervals
of prefixes nest or are apart, so a sweep over sorted keys needs one stack of
active intervals:

1. over host keys, the stack holds the hosts with rules at or above a URL's host
   (a few labels at most, however many rules a host has);
2. over keys of host and path, one for each host of that stack, the stack holds
   the rules of the host whose paths are prefixes of each other.

Of each stack the deepest interval that still holds the key is the longest rule
of its host; of a URL's hosts the longest rule wins.  Each opening of an
interval carries the stack that is active from there on.  Keys are range-dealt
over buckets; within a bucket a sorted window carries the last opening's stack
forward, and each bucket is seeded with the stack active at its lower end.  Keys
that hold many rows are repeated among the splitters; their rows are spread over
all buckets in between, repeated rows too.  Rules are a table of any length (or
a list of rows); only the last stack of each bucket, so one a shuffle partition,
comes to the driver.

Defined results: null URL or one without "://": empty host and path, no rule,
allowed; repeated rows are judged each by itself; ties: of two fitting rules of
the same length the one on the longer host wins, of two with the same host and
path the greater verdict; very long URLs: whole; empty table: empty result; no
rules: all get the default; a rule without a host fits nothing; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

#: (verdict, host, path), given.
GIVEN_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DEFAULT_VERDICT = "allow"
HOSTS, RULES = "array<string>", "array<struct<path:string,prefix:string,rule:string,verdict:string>>"
#: Keys looked at, about, to choose splitters (they balance buckets, results don't depend on them).
SPLITTER_KEYS = 4096


def host_of(url: Column) -> Column:
    after = F.substring_index(F.substring_index(F.substring_index(_after(url), "/", 1), "?", 1), "#", 1)
    return F.coalesce(F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ? or #."""
    after = F.substring_index(F.substring_index(_after(url), "?", 1), "#", 1)
    at = F.instr(after, "/")
    return F.coalesce(F.when(at > 0, F.substr(after, at)), F.lit(""))


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def key_of(host: Column) -> Column:
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def host_openings(rules: DataFrame) -> DataFrame:
    """(key, stack): of each host with rules, those at or above it, found by an equi-join on each of the key's leading label runs; rules: (prefix, path, rule, verdict)."""
    own = rules.select("prefix").distinct()
    labels = F.split(F.expr("left(key, length(key) - 1)"), r"\.")
    runs = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit(".")))
    keys = own.select(F.col("prefix").alias("key")).select("key", F.explode(runs).alias("prefix"))
    return keys.join(own, "prefix").groupBy("key").agg(F.array_sort(F.collect_list("prefix")).alias("stack"))


def path_openings(rules: DataFrame) -> DataFrame:
    """(key, stack): of each rule, the rules of its host whose path begins it, the shortest first."""
    one = rules.groupBy("prefix", "path").agg(F.max(F.struct("verdict", "rule")).alias("r")).select("prefix", "path", "r.rule", "r.verdict")
    starts = one.select("prefix", F.col("path").alias("own"), F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substr("path", F.lit(1), n))).alias("path"))
    met = starts.join(one, ["prefix", "path"])
    return met.groupBy(place_key("prefix", "own").alias("key")).agg(F.array_sort(F.collect_list(F.struct("path", "prefix", "rule", "verdict"))).alias("stack"))


def place_key(prefix: str, path: str) -> Column:
    """Key of a path at a host; hosts hold no such control character."""
    return F.concat(F.col(prefix), F.lit("\x01"), F.col(path))


def _splitters(keys: DataFrame, n: int) -> list[str]:
    """n - 1 ascending keys that cut the rows into n about even parts; equal ones mark a key with many rows."""
    share = min(1.0, SPLITTER_KEYS / max(1, keys.count()))
    rows = keys.filter(F.pmod(F.xxhash64("_row"), F.lit(1 << 30)) < int(share * (1 << 30))).select("key").collect()
    got = sorted((r["key"] for r in rows), key=lambda k: k.encode())
    return [got[len(got) * i // n] for i in range(1, n)] if got else []


def _bucket(cuts: list[str], spread: Column | None = None) -> Column:
    """Number of cuts at or below the key, found in a list of lists; with spread, rows of a key that is several cuts go to all their buckets."""
    if not cuts:
        return F.lit(0)
    size = max(1, round(len(cuts) ** 0.5))
    lists = [cuts[i : i + size] for i in range(0, len(cuts), size)]
    literal = lambda x: F.array(*[F.lit(c) for c in x])
    below = lambda a: F.size(F.filter(a, lambda c: c <= F.col("key")))
    first = below(literal([x[0] for x in lists]))
    found = F.when(first == 0, 0).otherwise((first - 1) * size + below(F.get(F.array(*[literal(x) for x in lists]), first - 1)))
    often = {c: n for c, n in Counter(cuts).items() if n > 1}
    if not often or spread is None:
        return found.cast("int")
    equal = F.coalesce(F.try_element_at(F.create_map(*[x for c, n in often.items() for x in (F.lit(c), F.lit(n))]), F.col("key")), F.lit(1))
    return (found - F.pmod(spread, equal)).cast("int")


def swept(rows: DataFrame, opened: DataFrame, kind: str) -> DataFrame:
    """rows (key, _row, ...) with the stack of the last opening (key, stack) at or before their key; null before the first one."""
    spark = rows.sparkSession
    cuts = _splitters(rows, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    opened = opened.withColumn("bucket", _bucket(cuts))
    # what is active at the lower end of each bucket: the last opening of those before, or one at the very end
    last = {r["bucket"]: r["last"] for r in opened.groupBy("bucket").agg(F.max_by(F.struct("key", "stack"), "key").alias("last")).collect()}
    exact = {r["key"]: r["stack"] for r in opened.filter(F.col("key").isin(cuts)).select("key", "stack").collect()} if cuts else {}
    seeds, active = [(0, "", [])], []
    for b, low in enumerate(cuts, 1):
        active = last[b - 1]["stack"] if b - 1 in last else active
        seeds.append((b, low, exact.get(low, active)))
    events = opened.select("bucket", "key", "stack").unionByName(spark.createDataFrame(seeds, f"bucket int, key string, stack {kind}"))
    rows = rows.withColumn("bucket", _bucket(cuts, F.xxhash64("_row", F.lit(7))))
    both = rows.withColumn("stack", F.lit(None).cast(kind)).unionByName(events, allowMissingColumns=True)
    order = Window.partitionBy("bucket").orderBy("key", F.col("stack").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("event", F.col("stack").isNotNull()).withColumn("stack", F.last("stack", ignorenulls=True).over(order))
    return both.filter("not event").drop("event", "bucket")


def judged(pages: DataFrame, rules=GIVEN_RULES, default: str = DEFAULT_VERDICT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row of pages; rules: rows or a table of (verdict, host, path)."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    own = rules.filter("host <> ''").select(key_of(F.col("host")).alias("prefix"), F.coalesce("path", F.lit("")).alias("path"), F.concat("host", F.coalesce("path", F.lit(""))).alias("rule"), "verdict")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    # rows go through a table, so that the numbers they get are the same in all that follows
    rows = saved(rows.withColumn("_row", F.monotonically_increasing_id()), "urls")
    at = swept(rows.select("_row", "path", key_of(F.col("host")).alias("key")), host_openings(own), HOSTS)
    places = at.select("_row", "path", F.explode(F.filter("stack", lambda h: F.col("key").startswith(h))).alias("prefix"))
    found = swept(places.select("_row", "path", "prefix", place_key("prefix", "path").alias("key")), path_openings(own), RULES)
    # the last stack may be that of another host
    deepest = F.try_element_at(F.filter("stack", lambda r: (r["prefix"] == F.col("prefix")) & F.col("path").startswith(r["path"])), F.lit(-1))
    best = F.max(F.struct(F.length("d.rule").alias("n"), F.length("prefix").alias("m"), F.col("d.rule").alias("rule"), F.col("d.verdict").alias("verdict"))).alias("best")
    longest = found.withColumn("d", deepest).filter("d is not null").groupBy("_row").agg(best)
    return rows.join(longest, "_row", "left").select(F.col("page_id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given rules over every page."""
    return judged(table(spark, sf_dir, "pages"))


OP3_SQL = r"""
with u as (
  select row_number() over () as rid, page_id,
         case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as a from pages),
p as (
  select rid, page_id, coalesce(translate(regexp_extract(a, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(a, '^[^/?#]*(/[^?#]*)', 1), '') as path from u),
r(verdict, rh, rp) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m as (
  select rid, rh || rp as rule, verdict, row_number() over (partition by rid order by length(rh || rp) desc, length(rh) desc) as k
  from p join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join (select * from m where k = 1) using (rid)
"""
