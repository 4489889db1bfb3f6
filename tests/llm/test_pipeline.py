"""The pipeline's stages against what each should leave, stage by stage."""

from collections import Counter

import corpus_pipeline
from tidemark.llm import binslack, common, fertility, neardup, suffix
from tidemark.scratch import table


def test_stages_take_effect(spark, small):
    docs = common.documents(spark, small)
    kept = {r["doc_id"] for r in fertility.quality_rules(docs).collect() if r["kept"]}
    one = table(corpus_pipeline.quality(spark, docs, small), "t")
    assert {r["doc_id"] for r in one.select("doc_id").collect()} == kept and one.columns == docs.columns
    single = {r["doc_id"] for r in neardup.near_duplicates(one).collect() if r["kept"]}
    two = table(corpus_pipeline.near_duplicates(spark, one, small), "t")
    assert {r["doc_id"] for r in two.select("doc_id").collect()} == single and two.columns == docs.columns
    three = table(corpus_pipeline.repeats(spark, two, small), "t")
    removed = {r["doc_id"]: r["n_removed"] for r in suffix.remove_repeats(two.select("doc_id", "text"), output="digest").collect()}
    before = {r["doc_id"]: r["text"] for r in two.collect()}
    for r in three.collect():
        assert len(before[r["doc_id"]].encode()) - len(r["text"].encode()) >= removed[r["doc_id"]] and r["n_chars"] == len(r["text"])
        assert removed[r["doc_id"]] or r["text"] == before[r["doc_id"]]
    four = table(corpus_pipeline.mix(spark, three, small), "t")
    assert four.columns == docs.columns and set(Counter(r["doc_id"] for r in four.collect()).values()) <= {1, 2}
    five = corpus_pipeline.pack(spark, four, small).collect()
    assert Counter(r["doc_id"] for r in five if r["piece"] == 0) == Counter(r["doc_id"] for r in four.collect())


def test_run_is_the_stages(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    full = binslack.pack(common.documents(spark, small)).collect()
    assert rows and all(r["length"] <= 2048 for r in rows) and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in full}


def test_stages_on_odd_and_empty_tables(spark, odd, empty, small):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            after = table(stage(spark, docs, small), "t")
            if name != "best-fit packing":
                assert after.columns == docs.columns
                docs = after
            assert after.count() >= 0
