"""Language ID: the algebra, held-out accuracy and odd rows."""

from __future__ import annotations

import numpy as np

from plumbline.llm import language, queries


def test_bound_vectors_depend_on_order_and_letters():
    grams = language.trigrams("abc cba")
    matrix = language.trigram_matrix(grams).astype(float)
    cos = matrix @ matrix.T / language.DIM
    first, last = grams.tolist().index(language.trigrams("abc")[1]), grams.tolist().index(language.trigrams("cba")[1])
    assert first != last and abs(cos[first, last]) < 0.2
    assert np.allclose(np.diag(cos), 1)


def test_trigrams_fold_case_and_runs():
    assert (language.trigrams("Ab  1!c") == language.trigrams("ab c")).all()
    assert len(language.trigrams("")) == 0 and len(language.trigrams("a")) == 1


def test_prediction_is_the_cosine_of_bundles(spark, rows):
    docs = spark.createDataFrame([(1, "the cat sat on the mat", "x"), (2, "der hund und die katze", "y"), (3, "the dog sat on the mat", "x")], "doc_id long, text string, lang string")
    prototypes = language.learn_prototypes(docs)
    vector = lambda t: language.trigram_matrix(language.trigrams(t)).astype(float).sum(axis=0)
    bundle = vector("the cat sat on the mat") + vector("the dog sat on the mat")
    assert np.allclose(prototypes["x"], bundle / np.linalg.norm(bundle))
    got = rows(language.predict_language(spark.createDataFrame([(1, "the cat on the dog")], "doc_id long, text string"), prototypes))[0]
    v = vector("the cat on the dog")
    assert got["lang_pred"] == "x"
    assert abs(got["score"] - v @ prototypes["x"] / np.linalg.norm(v)) < 1e-5


def test_held_out_accuracy(spark, duck, rows):
    folder = "/root/testdata/sf0.01"
    lang = dict(duck(folder).execute("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL AND length(text) >= 40 AND regexp_matches(text, '[a-z]{3}')").fetchall())
    got = [r for r in rows(queries.op8_language_id(spark, folder)) if r["held_out"] and r["doc_id"] in lang]
    assert len(got) > 200
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_labels_of_held_out_rows_are_not_used(spark, small, rows, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs.withColumn("lang", F.when(queries._bucket(3) == 1, F.lit("wrong")).otherwise(F.col("lang"))).withColumn("source", F.lit("other")).write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (r["doc_id"], r["lang_pred"], round(r["score"], 9))
    assert sorted(map(key, rows(queries.op8_language_id(spark, str(tmp_path))))) == sorted(map(key, rows(queries.op8_language_id(spark, small))))


def test_odd_rows(spark, rows):
    docs = spark.createDataFrame([(1, "the cat", "x", 0.5), (2, None, "x", 0.5), (3, "12 !?", None, 0.5), (None, "the cat " * 50_000, None, 0.5), (1, "the cat", "x", 0.5)], "doc_id long, text string, lang string, score double")
    prototypes = language.learn_prototypes(docs)
    got = sorted(((r["doc_id"], r["lang_pred"], round(r["score"], 3)) for r in rows(language.predict_language(docs, prototypes))), key=str)
    assert got[-2:] == [(3, "und", 0.0), (None, "x", got[-1][2])] and got[0] == got[1] and got[2] == (2, "und", 0.0)
    assert language.learn_prototypes(docs.limit(0)) == {}
    assert {r["lang_pred"] for r in rows(language.predict_language(docs, {}))} == {"und"}
    assert language.predict_language(docs.limit(0), prototypes).count() == 0


def test_columns_of_any_name(spark, rows):
    docs = spark.createDataFrame([(1, "the cat", "x", "a", "b")], "doc_id long, text string, lang string, _p string, predicted string")
    (r,) = rows(language.predict_language(docs, language.learn_prototypes(docs)))
    assert (r["_p"], r["predicted"], r["lang_pred"]) == ("a", "b", "x")
