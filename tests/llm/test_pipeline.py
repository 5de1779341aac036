"""Registered corpus queries: against their SQL, and the pipeline against brute force."""

import pytest

import corpus_pipeline
from tests import compare
from tests.llm.test_operators import check_packed, groups, slow_code
from urnstat.llm import boosting, packing, quality, queries
from urnstat.llm.common import table


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_its_sql(spark, sf_dir, name):
    assert compare.compare(queries.QUERIES[name](spark, sf_dir), compare.oracle(sf_dir), queries.ORACLE_SQL[name]) == ""


def test_there_is_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 4


def slow_stages(spark, docs, sf_dir):
    """Ids and texts that each stage leaves."""
    kept = {}
    for r in docs.collect():
        judged = quality.judge(r["text"] or "")
        if judged[-2]:
            kept[r["doc_id"]] = judged[-1]
    yield dict(kept)
    left = spark.createDataFrame(list(kept.items()), "doc_id bigint, text string")
    trees = boosting.train(left, table(spark, sf_dir, "labels"))
    scores = trees.score([boosting.statistics(t) for t in kept.values()] @ boosting.np.eye(len(boosting.STATISTICS)))
    kept = {i: t for (i, t), s in zip(kept.items(), scores) if s >= boosting.THRESHOLD}
    yield dict(kept)
    codes = {i: slow_code(t) for i, t in kept.items()}
    near = [(a, b) for a in codes for b in codes if a < b and (codes[a] ^ codes[b]).bit_count() <= 4]
    of = groups(sorted(codes), near)
    yield {i: t for i, t in kept.items() if of[i] == i}


def test_pipeline_equals_brute_force(spark, sf_dir, tmp_path):
    documents = table(spark, sf_dir, "documents")
    docs = documents
    for (name, stage), want in zip(corpus_pipeline.STAGES, slow_stages(spark, documents, sf_dir)):
        left = stage(spark, docs, sf_dir)
        assert left.columns == documents.columns, name
        left.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == want, name
        assert docs.count() == len(want)
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    check_packed(rows, docs.collect(), packing.CAPACITY)


def test_every_stage_takes_an_empty_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
