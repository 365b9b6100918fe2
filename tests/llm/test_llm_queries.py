"""The registered corpus queries against their SQL, and the pipeline against its stages."""

import pytest

import corpus_pipeline
from dev.oracle_check import compare, duck
from scriptorium.llm import common, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    found = compare(spark, duck(sf_dir), name, queries.QUERIES[name], queries.ORACLE[name], sf_dir)
    assert found["status"] == "match" and not found.get("type_diff")


def test_pipeline_stages_take_effect(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.checkpointed(stage(spark, docs, sf_dir))
        seen[name] = (before, docs)
        if name != "sentencepiece":
            assert docs.columns == columns
    assert seen["near_dedup"][1].count() == queries.QUERIES["op7_minhash_neardup"](spark, sf_dir).select("class_id").distinct().count()
    assert seen["secret_scan"][1].where("text rlike 'AKIA[A-Z0-9]{16,}'").count() == 0 and seen["secret_scan"][1].count() == seen["near_dedup"][1].count()
    assert seen["sentencepiece"][1].count() == seen["mixing"][1].count()
    one = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, one.collect())) == sorted(map(str, docs.collect()))
