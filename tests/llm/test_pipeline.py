"""The corpus pipeline, stage by stage."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from tablewright.llm import minhash, mixing, quality, sentencepieces
from tablewright.llm.common import stored
from tests.llm.fixtures import documents, empty


def test_stages(spark):
    docs = documents(spark)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "source_mix", "token_ids"]
    after = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, ""), f"test-{name}")
        after.append(docs)
        if name != "token_ids":
            assert docs.columns == before.columns
    good = {r.doc_id for r in quality.judged(documents(spark)).where("kept").collect()}
    assert {r.doc_id for r in after[0].collect()} == good
    kept = {r.doc_id for r in minhash.near_duplicates(after[0]).where("kept").collect()}
    assert {r.doc_id for r in after[1].collect()} - {None} == kept - {None}
    copies = Counter()
    for r in mixing.mix(after[1]).collect():
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in after[2].collect()) == +copies
    own = sentencepieces.Encoder(sentencepieces.Pieces(sentencepieces.model_path()))
    texts = {r.doc_id: r.text for r in after[2].collect()}
    for r in after[3].collect():
        assert r.ids == own.encode(texts[r.doc_id]).tolist() and r.n_ids == len(r.ids)


def test_no_documents(spark):
    docs = empty(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, ""), f"test-{name}")
    assert docs.count() == 0


def test_run(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.columns == ["doc_id", "n_ids", "ids"] and out.count() > 0


def test_near_duplicates_take_five_words(spark):
    """Two scattered edits: similar by 0.83 on four words, by 0.79 on five."""
    import random

    from tests.llm.fixtures import words

    base = words(random.Random(4), 90).split(" ")
    other = ["changed" if i in (30, 60) else w for i, w in enumerate(base)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(base))], "doc_id long, text string")
    assert {r.doc_id for r in minhash.distinct_documents(docs).collect()} == {1}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 2}
