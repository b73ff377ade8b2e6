"""Registered queries against their SQL, and the pipeline stage by stage against plain versions."""

from __future__ import annotations

import os

import pytest
from oracle import compare, connect

import corpus_pipeline
from outlay.llm.ngram_join import keep_one_of_each, ngram_jaccard_join
from outlay.llm.pieces import MODEL
from outlay.llm.queries import QUERIES
from outlay.llm.quality import score_quality

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_equals_its_sql(spark, name):
    run, sql = QUERIES[name]
    ok, text = compare(spark, connect(SF), SF, run, sql)
    assert ok, text


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "PII", "mixing sources", "SentencePiece"]


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no public tokenizers")
def test_stages(spark, tmp_path):
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    tables = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], SF).write.parquet(f"{tmp_path}/{i}")
        tables.append(spark.read.parquet(f"{tmp_path}/{i}"))
        assert i == 4 or tables[-1].columns == docs.columns
    start, rated, single, clean, mixed, ids = [t.toPandas() for t in tables]
    scores = score_quality(docs, labels).toPandas()
    assert sorted(rated.doc_id) == sorted(scores.doc_id[scores.predicted == 1])
    found = ngram_jaccard_join(tables[1]).toPandas()
    assert sorted(single.doc_id) == sorted(found.doc_id[found.doc_id == found.component_id])
    assert sorted(clean.doc_id) == sorted(single.doc_id) and (clean.n_chars == clean.text.str.len()).all()
    assert not clean.text.str.contains(r"[a-z]@mail\d*\.example").any()
    before = single[single.text.str.contains(r"[a-z]@mail\d*\.example")]
    assert clean[clean.doc_id.isin(before.doc_id)].text.str.contains("<EMAIL>").all()
    words = clean.text.str.split().str.len()
    assert mixed.text.str.split().str.len().sum() == pytest.approx(1.5 * words.sum(), rel=0.05)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = sorted((d, library.encode(t)) for d, t in zip(mixed.doc_id, mixed.text, strict=True))
    assert sorted((d, list(x)) for d, x in zip(ids.doc_id, ids.ids, strict=True)) == want
    assert (ids.n_ids == ids.ids.str.len()).all()


def test_repeated_ids_in_the_near_duplicate_stage(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (2, "a b c d e f", "x"), (None, "a b c d e f", "x"), (3, None, "x"), (4, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string")
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "4", "None"]
    assert corpus_pipeline.near_duplicates(spark, docs.where("false"), "").collect() == []


def test_the_same_row_is_kept_however_rows_are_dealt_out(spark):
    rows = [(i % 3, "a b c d e f" if i % 3 else "q r s t u v w", f"src{i}") for i in range(24)] + [(7, "g h i j k l", None), (7, "g h i j k l", "x"), (7, "g h i j k l", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {tuple(sorted(map(str, keep_one_of_each(docs.repartition(n)).collect()))) for n in (1, 3, 7)}
    assert len(kept) == 1 and len(next(iter(kept))) == 3


def test_rows_that_share_an_id_are_decided_by_their_own_text(spark):
    copied, other, third = "a b c d e f g h i j", "k l m n o p q r s t", "u v w x y z one two three four"
    rows = [(1, copied), (2, copied), (2, other), (3, third), (3, other + " v"), (4, third + " v")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    # 2/copied is a copy of 1; 2/other stays and 3/other is its near copy; 4 is one of 3/third
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, copied), (2, other), (3, third)]
