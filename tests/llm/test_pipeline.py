from collections import defaultdict

import corpus_pipeline
from postura.llm import quality
from postura.llm.common import saved
from postura.llm.packing import default_path

from . import cases
from .test_decontaminate import brute as leaks
from .test_minhash import brute as classes

D = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = saved(stage(spark, docs, D), name)
        after = docs.collect()
        ids = sorted(r.doc_id for r in after)
        if name == "quality_rules":
            book = {r.doc_id: r.failed for r in quality.ledger(spark.createDataFrame(before)).collect()}
            assert ids == sorted(i for i, f in book.items() if not f) and len(ids) < len(before)
        elif name == "near_dedup":
            assert ids == sorted(set(classes([(r.doc_id, r.text) for r in before]).values()))
        elif name == "decontamination":
            assert ids == sorted(r.doc_id for r in before if not leaks(r.text, items)[4])
        elif name == "surrogates":
            assert ids == sorted(r.doc_id for r in before) and all(r.n_chars == len(r.text) for r in after)
        else:
            from tokenizers import Tokenizer

            t, total = Tokenizer.from_file(default_path()), defaultdict(int)
            for r in after:
                total[r.doc_id] += r.length
            assert total == {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in before}
        if name != "best_fit_packing":
            assert docs.columns == columns


def test_empty_tables_and_odd_rows(spark, tmp_path):
    odd = cases.frame(spark).withColumnsRenamed({"score": "_dc_found", "n_words": "salt"})
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs, d in ((odd.limit(0), D), (odd, str(tmp_path))):
        columns, empty = docs.columns, docs.isEmpty()
        for name, stage in corpus_pipeline.STAGES:
            before = docs
            docs = saved(stage(spark, docs, d), name)
            assert docs.isEmpty() == empty
            if name != "best_fit_packing":
                assert docs.columns == columns
            if name == "quality_rules":
                assert docs.filter("text is null or text = ''").isEmpty()
            if name == "decontamination" and d != D:
                assert docs.count() == before.count()
