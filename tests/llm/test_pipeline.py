import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyrisk.llm import decontaminate, neardup
from tallyrisk.llm.common import table

SMALL = "/root/testdata/sf0.001"


def test_stages_in_order_keep_columns_and_take_effect(spark):
    docs = table(spark, SMALL, "documents").withColumn("score", docs_extra()).withColumn("row_key", docs_extra())
    before, columns = docs.count(), docs.columns
    bench = {r["text"] for r in table(spark, SMALL, "benchmark").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SMALL)
        docs = corpus_pipeline.land(docs, "test-stage")
        after = docs.count()
        assert 0 < after <= before, name
        if k < 4:
            assert docs.columns == columns
        before = after
    rows = docs.collect()
    assert docs.columns == [*columns, "copies"] and {r["copies"] for r in rows} <= {1, 2}
    assert not any(b.lower() in r["text"].lower() for r in rows for b in bench)
    sets = [neardup.shingle_set(neardup.split_words(r["text"].encode()), 5) for r in rows]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            both = len(a & b)
            assert not a or 100 * both < 80 * (len(a) + len(b) - both)


def docs_extra():
    from pyspark.sql import functions as F
    return F.lit("beside")


def test_clean_documents_stay(spark):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SMALL, "labels").collect()}
    docs = table(spark, SMALL, "documents")
    kept = {r["doc_id"] for r in corpus_pipeline.quality_classifier(spark, docs, SMALL).select("doc_id").collect()}
    good = {i for i, q in labels.items() if q == 1}
    assert len(good & kept) >= 0.97 * len(good)


def test_odd_rows(spark, documents, prose):
    rows = [(1, None), (2, ""), (3, prose(1, 40)), (3, prose(1, 40)), (4, prose(1, 40)), (None, prose(2, 40)), (5, 'token = "abcdef123456"')]
    docs = documents(rows)
    near = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert sorted(str(r["doc_id"]) for r in near.collect()) == ["1", "2", "3", "5", "None"] and near.columns == docs.columns
    clean = corpus_pipeline.benchmark_decontamination(spark, docs, SMALL)
    assert clean.count() == len(rows)
    assert [r["text"] for r in corpus_pipeline.secret_scans(spark, docs, SMALL).filter("doc_id = 5").collect()] == ['[secret]"']
    empty = documents([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


@pytest.mark.parametrize("key", ["doc_id", "item_id"])
def test_leaks_carry_ids(spark, key):
    assert dict(decontaminate.leaks(table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark")).dtypes)[key] == "bigint"


def test_stages_keep_columns_of_any_name(spark, documents, prose):
    rows = [(i, prose(i, 30) + (' token = "abcdef1"' if i % 3 == 0 else "")) for i in range(30)]
    docs = documents(rows).withColumns({n: F.lit(i) for i, n in enumerate(["copies", "mix_copies", "secret_spans", "a.b", "row_key", "held"])})
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.secret_scans):
        assert stage(spark, docs, "").columns == docs.columns and stage(spark, docs, "").count() == 30
    mixed = corpus_pipeline.mixing_sources(spark, docs, "")
    assert mixed.columns == [*docs.columns, "copies_"] and 0 < mixed.count() <= 30
