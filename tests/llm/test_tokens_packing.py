import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from postura.llm import packing, tokens

from . import cases


def test_histogram_answers(spark):
    docs = cases.frame(spark)
    lengths = [r.n_tokens for r in tokens.token_lengths(docs).collect()]
    enc = tokens.encoder(tokens.default_path())
    assert sorted(lengths) == sorted(len(enc.encode_ordinary(r[1])) if r[1] else 0 for r in cases.documents())
    sums = tokens.suffix_sums(tokens.histogram(tokens.token_lengths(docs)))
    for r in tokens.answers(sums).collect():
        n = r.n_tokens
        assert (r.docs_at_least, r.tokens_at_least, r.truncated_total, r.all_tokens) == (
            sum(x >= n for x in lengths), sum(x for x in lengths if x >= n), sum(min(x, n) for x in lengths), sum(lengths))
    assert tokens.quantile(sums, 0.5).first()[0] == sorted(lengths)[(len(lengths) - 1) // 2]
    assert tokens.answers(tokens.suffix_sums(tokens.histogram(tokens.token_lengths(docs.limit(0))))).count() == 0


def test_chunks_encode_like_the_tokenizer():
    e, t, rng = packing.encoder(packing.default_path()), Tokenizer.from_file(packing.default_path()), random.Random(5)
    letters = "aAbB'stdlm .,!\n\tÉéßµº½²0 9#&\u00ad\u0301\x1f中İΣ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(1500)] + ["", "it's I'LL 'S", "<|endoftext|> x"]
    for text, ids in zip(texts, e.encode(texts)):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_plan_fills_sequences():
    rng = random.Random(2)
    for capacity in (12, 100):
        for _ in range(40):
            hist = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 400)))
            used, seen = defaultdict(int), Counter()
            ranks = defaultdict(set)
            runs = sorted(packing.plan(hist, capacity))
            for k, (n, rank, each, first, offset) in enumerate(runs):
                end = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == n else hist[n]
                for r in range(rank, end):
                    used[first + (r - rank) // each] += n
                    seen[n] += 1
                    ranks[n].add(r)
            assert seen == hist and max(used.values()) <= capacity
            large = sum(c for n, c in hist.items() if 3 * n > capacity)
            assert len(used) >= -(-sum(n * c for n, c in hist.items()) // capacity) and len(used) <= max(large, 1.3 * sum(n * c for n, c in hist.items()) / capacity + 2)


def test_pieces_hold_every_token_once(spark):
    docs = cases.frame(spark)
    rows = packing.packed(docs, capacity=256, keep_ids=True).collect()
    t = Tokenizer.from_file(packing.default_path())
    want = Counter()
    for r in cases.documents():
        ids = [*(t.encode(r[1], add_special_tokens=False).ids if r[1] else []), 1]
        for k, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want[r[0], k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 256
    assert packing.packed(docs.limit(0)).count() == 0


def test_equal_rows_are_spread_evenly(spark):
    n = 1_000_000
    pieces = spark.range(n).selectExpr("1L as doc_id", "0 as piece", "0L as start", "4096L as length", "7L as ids_crc32", "id as row")
    groups = packing.salted(pieces, "row", {4096: n}).groupBy("salt").count()
    least, most, k = groups.selectExpr("min(count)", "max(count)", "count(*)").first()
    assert k == n // packing.GROUP_ROWS and 150 < least and most < 400
    few = packing.numbered(pieces.limit(5000).drop("row"), "row")
    got = packing.pack(few, "row").select("sequence_id", "offset").distinct()
    assert got.count() == 5000 and "row" not in packing.pack(few, "row").columns
