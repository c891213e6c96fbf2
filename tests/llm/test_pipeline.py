"""The corpus pipeline: each stage's decisions take effect on small planted tables."""

from __future__ import annotations

import ast
from pathlib import Path

import corpus_pipeline
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ENGLISH = "the river runs past the old harbour and the people of the town walk along it every evening when the weather is kind number {}"
ITEM = "which of the following bridges was finished first and by whom was the design of its arches drawn up"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    distinct = lambda i: " ".join(f"{w}{'' if k % 3 else i}" for k, w in enumerate((ENGLISH.format(i) + " " + ENGLISH[::-1]).split()))
    texts = {i: distinct(i * 7919) for i in range(40)}
    texts |= {100: texts[1], 101: texts[1].upper(), 102: None, 103: "", 104: "123 456", 105: f"{texts[5][:60]} {ITEM} {texts[6][:60]}", 106: "short password=hunter2hunter2 text here with seven words"}
    rows = [(i, t, "en", "web" if i % 2 else None, len(t or "")) for i, t in texts.items()]
    rows.append((107, "0123456789 " + "中文" * 400, None, "web", 811))
    rows.append((None, "a document without an id but with its own words in it", "en", "web", 52))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_are_the_five_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "benchmark decontamination", "secret scans", "mixing sources to target weights"]
    assert not [n for n in ast.walk(ast.parse(Path(corpus_pipeline.__file__).read_text())) if isinstance(n, ast.Try)]


def test_each_stage_takes_effect(spark, folder):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        docs = corpus_pipeline.write_stage(out, "test")
        kept.append({r["doc_id"]: r for r in docs.collect()})
    language, near, clean, masked = kept
    assert not {102, 103, 104, 107} & set(language) and set(range(40)) <= set(language) and None in language
    assert not {100, 101} & set(near) and set(language) - set(near) == {100, 101}
    assert set(near) - set(clean) == {105}
    assert masked[106]["text"] == "short [SECRET] text here with seven words" and masked[106]["n_chars"] == len(masked[106]["text"])
    assert all(masked[i]["text"] == clean[i]["text"] for i in clean if i != 106)


def test_run_equals_the_stages_and_keeps_every_document(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in got} == {*range(40), 106, None}
    assert {"n_tokens", "epoch", "block", "slot"} <= set(got[0].asDict())
    assert {r["source"] for r in got} == {"web", None}


def test_stages_on_empty_tables_and_extra_columns(spark, folder):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = {"score": F.lit(7.5), "lang_pred": F.lit("mine"), "spans": F.lit("own"), "n_hex": F.lit(-1), "_hit": F.lit(True), "hit": F.lit(3), "a.b": F.col("doc_id") * 2, "in1": F.lit("x"), "fp": F.lit(1), "cls": F.lit(2), "row": F.lit(0),
             "item_id": F.lit("i"), "slot": F.lit(9), "cell": F.lit(1), "n_tokens": F.lit(1), "root": F.lit(5), "near": F.lit(6)}
    docs = docs.withColumns(extra)
    for rows in (docs, docs.limit(0)):
        before = {r.doc_id: r for r in rows.collect()}
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, folder)
            assert out.schema.simpleString() == rows.schema.simpleString()
            found = out.collect()
            assert (not found) == rows.isEmpty()
            for r in found:
                own = before[r.doc_id]
                assert all(r[c] == own[c] for c in rows.columns if name != "secret scans" or c not in ("text", "n_chars")), name
        assert (corpus_pipeline.STAGES[-1][1](spark, rows, folder).count() == 0) == rows.isEmpty()


def test_query_on_the_given_tables(spark, small):
    from plumbline.llm import queries

    found = queries.pipeline(spark, small)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = found.select("doc_id").distinct()
    assert 0.5 * docs.count() < kept.count() <= docs.count()
    assert kept.join(docs, "doc_id", "left_anti").count() == 0
