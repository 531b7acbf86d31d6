import zlib

import numpy as np
from pyspark.sql import functions as F

from sluice.llm import langid


def test_grams_are_those_of_the_folded_text():
    seen = np.zeros(langid.SPACE, np.uint8)
    same = [langid.grams(t.encode(), seen) for t in ("Ab, c", "aB  c!", " ab c")]
    assert (same[0] == same[1]).all() and (same[0] == same[2]).all() and not seen.any()
    assert len(langid.grams(b"", seen)) <= 4 and len(langid.grams(b"abc", seen)) > len(langid.grams(b"a", seen))


def test_kernel_and_ridge_against_plain_algebra(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs, sample_per_lang=20, landmarks_per_lang=4)
    texts = [r["text"].encode() for r in docs.limit(30).collect()]
    seen = np.zeros(langid.SPACE, np.uint8)
    columns = {int(g): int(k) for g, k in enumerate(model.place) if k >= 0}
    marks = [{k for k in range(model.landmarks.shape[0]) if model.landmarks[k, j]} for j in range(model.landmarks.shape[1])]
    for text, got in zip(texts, model.scores(texts)):
        own = langid.grams(text, seen)
        kernel = [len({columns[int(g)] for g in own if int(g) in columns} & m) / np.sqrt(max(1, len(own)) * s) for m, s in zip(marks, model.sizes)]
        assert np.allclose(np.array(kernel) @ model.weights, got, atol=1e-3)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert out > 0.97


def test_labels_of_the_held_fold_are_not_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    turned = docs.withColumn("lang", F.when(crc == 0, "xx").otherwise(F.col("lang")))
    a, b = (langid.identify(d).orderBy("doc_id").collect() for d in (docs, turned))
    assert a == b and {r["doc_id"] for r in a if r["held_out"]} == {r["doc_id"] for r in a if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}


def test_awkward_rows(awkward, nothing):
    out = langid.identify(awkward).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == 9 and by[2]["lang_pred"] == by[3]["lang_pred"] == by[5]["lang_pred"] == "und" and by[4]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in out)
    assert langid.identify(nothing).count() == 0
    assert {r["lang_pred"] for r in langid.identify(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_repeated_ids_and_texts_without_letters(spark):
    """Rows of one id and different texts all may be learned from; repeated rows and texts of signs take no place in the sample."""
    rows = [(1, "der die das und nicht", "de"), (1, "the and of not with", "en")] + [(2, "1234 !!", "fr")] * 500 + [(3, "le la les et pas", "fr")] * 500 + [(4, "el la los y no", "es")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, sample_per_lang=2)
    assert model.langs == ["de", "en", "es", "fr"] and model.landmarks.shape[1] == 4
    assert {(r["doc_id"], r["lang_pred"]) for r in langid.predict(df, model).collect()} == {(1, "de"), (1, "en"), (2, "und"), (3, "fr"), (4, "es")}


def test_the_sample_of_a_large_language_is_full(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "concat('wort nummer ', id) as text", "'de' as lang").union(spark.range(900).selectExpr("id", "concat('word number ', id)", "'en'"))
    model = langid.train(df, sample_per_lang=100, landmarks_per_lang=100)
    assert model.landmarks.shape[1] == 200
