import corpus_pipeline
from glyphmill.llm.common import staged


def test_stages_stand_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "source_mix", "packing"]


def test_every_stage_takes_what_the_one_before_kept(spark, sf, documents):
    docs, names = documents, documents.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = staged(stage(spark, docs, sf), f"test-{name}")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == names
        assert {r[0] for r in docs.select("doc_id").distinct().collect()} <= {r[0] for r in before.select("doc_id").distinct().collect()}
        if k < 2:
            assert docs.count() < before.count()
    assert {"sequence_id", "offset", "length"} <= set(docs.columns)


def test_stages_on_odd_documents(spark, odd, odd_tables):
    docs = odd
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = staged(stage(spark, docs, odd_tables[0]), f"odd-{name}")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == odd.columns
    assert docs.count() > 0


def test_empty_documents(spark, odd, odd_tables):
    docs = odd.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, odd_tables[1]), f"none-{name}")
    assert docs.count() == 0
