"""Registered queries against SQL and the pipeline against its parts."""

import corpus_pipeline
import pytest
from compare import differences, duck
from corpusloom.llm import queries
from corpusloom.llm.simhash import fingerprint
from corpusloom.tables import table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(spark, duck(SF), SF, name, queries.QUERIES[name], queries.ORACLES[name]) is None


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs.write.mode("overwrite").parquet(f"/tmp/corpusloom-test/{name}")
        docs = spark.read.parquet(f"/tmp/corpusloom-test/{name}")
        kept[name] = docs
        if name != "byte_bpe":
            assert docs.columns == columns
    ids = {n: [r["doc_id"] for r in d.collect()] for n, d in kept.items()}
    assert 0 < len(ids["toxicity"]) <= 200
    assert set(ids["line_dedup"]) <= set(ids["toxicity"])
    near = kept["simhash_near_dedup"].collect()
    fps = [fingerprint(r["text"]) for r in near]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(fps) for b in fps[:i])
    assert set(ids["mix_sources"]) <= set(ids["simhash_near_dedup"]) and max(map(ids["mix_sources"].count, set(ids["mix_sources"]))) <= 2
    assert sorted(ids["byte_bpe"]) == sorted(ids["mix_sources"])
    assert sorted(r["ids_sha256"] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r["ids_sha256"] for r in kept["byte_bpe"].collect())
