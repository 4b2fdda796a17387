from pyspark.sql import functions as F

from postura.llm import language

from . import cases


def test_languages_and_odd_rows(spark):
    docs = cases.frame(spark)
    model = language.fit(docs.filter("doc_id % 2 = 0"))
    assert model[0] == ["en", "fr"]
    got = language.predict(docs.select("doc_id", "text", "lang", "score"), model).collect()
    assert all(0 <= r.score <= 1 for r in got)
    long = [r for r in got if r.doc_id is not None and r.doc_id < 60]
    assert sum(r.lang == r.lang_pred for r in long) >= 0.95 * len(long)
    odd = {r.doc_id: r.lang_pred for r in got if r.doc_id is not None and r.doc_id >= 60}
    assert odd[62] == odd[63] == odd[64] == odd[65] == "und"


def test_masks_hold_every_language(spark):
    langs, bits = language.fit(spark.createDataFrame([(1, "abcabc", "x"), (2, "abcabc", "y"), (3, "zzzz", "y")], "doc_id long, text string, lang string"))
    (_, h, _), *_ = language.grams(["abc"])
    a, b = language._slots(h)
    assert ((bits[a] & bits[b]) == 3).all() and bits.shape[1] == 1 and langs == ["x", "y"]


def test_more_than_64_languages(spark):
    letters = [chr(0x4E00 + 40 * k + j) for k in range(70) for j in range(40)]
    texts = [(k, "".join(letters[40 * k : 40 * k + 40]) * 3, f"l{k:02}") for k in range(70)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model[1].shape[1] == 2
    assert all(r.lang == r.lang_pred for r in language.predict(docs, model).collect())


def test_nothing_to_learn(spark):
    docs = cases.frame(spark)
    got = language.predict(docs.select("doc_id", "text"), language.fit(docs.limit(0)))
    assert {r.lang_pred for r in got.collect()} == {"und"}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.001"
    got = language.op2_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    ok, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert ok >= 0.95 * n
