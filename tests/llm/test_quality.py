import re
from collections import Counter

from postura.llm import quality

from . import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_measurements_match_brute_force(spark):
    rows = cases.documents()
    rows += [(900, "a b c a b c a b", "en", "s", 1, 0.0, 0), (901, "x\ny\nx\n\n#|x", "en", "s", 1, 0.0, 0), (902, "a a a a", "en", "s", 1, 0.0, 0)]
    got = quality.measured(cases.frame(spark, rows)).collect()
    have = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert have == sorted((r[0] if r[0] is not None else -1, *brute(r[1])) for r in rows)


def test_policies_and_ablation(spark):
    book = quality.ledger(cases.frame(spark)).cache()
    kept = book.filter(quality.passes("v2")).count()
    table = {r.rule: r for r in quality.ablation(book, "v2").collect()}
    assert table["too_short"].n_kept == kept
    for rule, row in table.items():
        rest = quality.mask([r for r in quality.POLICIES["v2"] if r != rule])
        assert book.filter(book.failed.bitwiseAND(rest) == 0).count() == kept + row.n_only


def test_accepted_keeps_columns_and_empty_tables(spark):
    docs = cases.frame(spark)
    assert quality.accepted(docs).columns == docs.columns
    assert quality.accepted(docs.limit(0)).count() == 0
