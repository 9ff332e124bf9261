"""The registered queries against DuckDB, and the pipeline against its operators."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from tapline.llm import queries
from tapline.llm.scratch import documents
from tapline.plans.check import compare

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("key", sorted(queries.SQL))
def test_query_matches_duckdb(spark, duck, key):
    r = compare(spark, duck, key, queries.QUERIES[key], queries.SQL[key], SF)
    assert r["status"] == "ok", r


def test_all_are_registered():
    assert {f"op{n}_" for n in range(1, 14)} == {k.split("_")[0] + "_" for k in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language ID", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]


def test_stages_apply_their_operators(spark):
    docs = documents(spark, SF)
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    stages = dict(corpus_pipeline.STAGES)
    labelled = {r.doc_id: r.toxic for r in documents(spark, SF, "labels").collect()}
    stay = stages["toxicity"](spark, docs, SF)
    assert stay.columns == docs.columns
    gone = ids(docs) - ids(stay)
    assert len([d for d in gone if labelled.get(d) == 0]) <= 0.02 * len(labelled)
    junk = docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(-1).cast("long"), "text": F.lit("12 34 !!")}))
    assert ids(docs) - ids(stages["language ID"](spark, junk, SF)) == set() and -1 not in ids(stages["language ID"](spark, junk, SF))
    kept = queries.QUERIES["op3_minhash_near_dedup"](spark, SF).where("kept")
    assert ids(stages["MinHash near-dedup"](spark, docs, SF)) == ids(kept)
    leaked = queries.QUERIES["op2_benchmark_containment"](spark, SF)
    assert ids(stages["benchmark decontamination"](spark, docs, SF)) == ids(docs) - ids(leaked)


def test_pipeline_packs_what_the_stages_keep(spark):
    docs, path = documents(spark, SF), corpus_pipeline.STAGES
    for _, stage in path[:-1]:
        docs = stage(spark, docs, SF).checkpoint()
    packed = corpus_pipeline.run(spark, SF)
    assert {r[0] for r in packed.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()}
