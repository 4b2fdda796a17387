import random
import re
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

from pyspark.sql import functions as F

from postura.llm import prefixes as T

SHAPE = "conv_id long, turn long, role string, text string, depth string, path string"


def brute(rows):
    """The stated nodes by plain prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "").encode(), (text or "").encode()))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 4
        block = c - int(c / 20) * 20
        whole[c] = own.get(c - block, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for n in members:
        if n:
            children[n[:-1]] += 1
    words = lambda n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1].decode())) if n else 0
    leaves, saved = defaultdict(int), defaultdict(int)
    for n in members:
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in children
            saved[n[:d]] += (len(members[n]) - 1) * words(n)
    ends = lambda n: sha256(",".join(str(c) for c in sorted(members[n]) if len(whole[c]) == len(n)).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), children.get(n, 0), leaves[n], saved[n], ends(n)) for n, m in members.items())


def result(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SHAPE)


def test_matches_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for c in [*range(80), 95, 101, 102, -3, -20, -41, 1 << 40]:
        for turn in range(rng.choice([1, 1, 2, 3, 5])):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["a", "b c", "b  c d"])))
    rows += [(c, t, "user", "the same") for c in range(200, 320) for t in range(4)]  # a very common conversation
    rows += [(400, i, "user", f"word {i % 3}") for i in range(700)]  # one of very many turns
    rows += [(401, i, "user", f"word {i % 3}") for i in range(300)]
    rows += [(None, 1, "user", "nobody's"), (403, None, None, None), (403, None, "user", ""), (403, 1, "user", "x"), (403, 1, "assistant", "é"), (403, 1, "assistant", "z"), (403, 1, "assistant", "z"), (404, 0, "user", "long " * 50_000), (404, 1, "ab", "c"), (405, 0, "user", "long " * 50_000), (405, 1, "a", "bc")]
    rng.shuffle(rows)
    assert result(T.trie(frame(spark, rows).repartition(5))) == brute(rows)


def test_many_ends_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 40)
    rows = [(c * 20, 0, "user", "hello") for c in range(300)] + [(7, 0, "user", "bye")]
    assert result(T.trie(frame(spark, rows))) == brute(rows)


def test_empty(spark):
    assert T.trie(frame(spark, [])).count() == 0
    assert result(T.trie(frame(spark, [(11, 0, "user", "alone")]))) == brute([(11, 0, "user", "alone")])


def test_running_sums_over_parts(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 800, F.lit(1)).otherwise(F.col("id") % 7).cast("long").alias("g"), "id")
    got = T.numbered(rows, "g", ["id"], F.col("id"), "total").collect()
    sums = defaultdict(int)
    for r in sorted(got, key=lambda r: (r.g, r.id)):
        sums[r.g] += r.id
        assert r.total == sums[r.g]
    assert len(got) == 1000


def test_names_join():
    values = [int.from_bytes(sha256(bytes([i])).digest()[:16], "big") for i in range(9)]

    def name(part):
        h = 0
        for v in part:
            h = (h * T.BASE + v) % T.P
        return h

    for cut in range(10):
        assert T.joined_name(name(values[:cut]), name(values[cut:]).to_bytes(16, "big"), 9 - cut) == name(values).to_bytes(16, "big")
