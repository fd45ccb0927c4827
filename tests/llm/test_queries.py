"""Registered queries: SQL twins, and the pipeline."""

import pytest

import corpus_pipeline
from riftsplit.llm.queries import QUERIES, SQL
from tools.check_oracles import compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    rel = duck.execute(SQL[name])
    assert compare(rows, df.columns, rel.fetchall(), [d[0] for d in rel.description]) == ""


def test_queries_and_their_columns(spark, sf_dir):
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    shards = QUERIES["op9_sharding"](spark, sf_dir)
    assert shards.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_pipeline_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[2] < counts[1] and counts[4] == counts[3] > 0
    packed = corpus_pipeline.packing_stage(spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == counts[4]


def test_run_equals_its_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).filter("length > 2048").isEmpty()
