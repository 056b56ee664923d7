"""The pipeline against the plain versions of its stages."""

from __future__ import annotations

import plain
import sentencepiece

import corpus_pipeline
from lorekeep.llm import language_id, sentencepieces

SF_DIR = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_edge_rows(spark, edges, nothing):
    for docs in (edges, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF_DIR)
            assert out.columns == docs.columns, name
            assert out.schema.simpleString() == docs.schema.simpleString(), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() == docs.count()


def test_run_matches_plain_stages(spark, small):
    model = language_id.train(language_id.labelled_rows(small))
    marked = language_id.identify(small.select("doc_id", "text"), model).collect()
    ids = {r.doc_id for r in marked if r.lang_pred != "und" and r.score >= 0.5}
    docs = sorted((r.doc_id, r.text) for r in small.collect() if r.doc_id in ids)
    docs = [(i, text) for i, _, _, text in plain.line_dedup(docs)]
    groups = plain.components([(i, plain.fingerprint(t, 2)) for i, t in docs], 7)
    docs = [(i, t) for i, t in docs if groups[i] == i]
    bare = lambda t: " ".join("".join(c.lower() if c.isalnum() else " " for c in t).split())
    items = [bare(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    docs = [(i, t) for i, t in docs if not any(f" {x} " in f" {bare(t)} " for x in items)]
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    found = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted((r.doc_id, r.ids) for r in found) == [(i, library.encode(t)) for i, t in docs]
    assert 100 < len(docs) < small.count()


def test_registered():
    import __spark_entry__ as entry

    assert set(corpus_pipeline.queries()) <= set(entry.queries())
    assert sum(name.startswith("op") for name in entry.queries()) == 13
