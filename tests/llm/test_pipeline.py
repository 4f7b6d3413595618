"""Stages of the pipeline, each on the rows of the one before."""

from collections import defaultdict

import corpus_pipeline


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, held = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), "test")
        rows = docs.collect()
        assert docs.columns == columns and len({r.doc_id for r in rows}) == len(rows) <= len(held)
        assert all(len(r.text or "") <= len(held[r.doc_id] or "") for r in rows)
        if name == "language ID":
            assert len(rows) >= 0.9 * len(held)
        held = {r.doc_id: r.text for r in rows}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    total = defaultdict(int)
    for p in pieces:
        total[p.doc_id] += p.length
    assert set(total) == set(held) and all(total[p.doc_id] == p.doc_tokens for p in pieces)


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), "test")
        assert docs.count() == 0


def test_odd_texts(spark, odd_docs, sf_dir):
    docs = odd_docs.select("doc_id", "text", "row", "n_lines")
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), "test")
    assert docs.count() > 0
