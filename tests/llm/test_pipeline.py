"""The pipeline and the registered queries."""

import os

import pytest
from conftest_llm import sentence
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tablewright.llm import queries


def test_every_operator_has_a_query():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and set(queries.ORACLES) <= set(names)


def test_stages_keep_clean_documents_and_columns(spark, tmp_path, prose, odd):
    passage = sentence("en", 900, 70)
    item = sentence("de", 901, 30)
    planted = [(300, passage, "en", "s", 1), (301, sentence("en", 902) + "\n" + passage, "en", "s", 1), (302, sentence("fr", 903, 20) + " " + item, "fr", "s", 1), (303, "1234 5678", "en", "s", 1)]
    near = [(400 + i, sentence("fr", 904, 400).replace(" ", " " * (i + 1)), "fr", "s", 1) for i in range(2)]
    docs = prose.unionAll(spark.createDataFrame(planted + near, prose.schema)).withColumn("extra", F.lit("x"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    gone = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in kept.select("doc_id").collect()}
        kept = stage(spark, kept, str(tmp_path))
        kept.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        gone.append(before - {r["doc_id"] for r in kept.select("doc_id").collect()})
        if name != "packing":
            assert kept.columns == docs.columns
    assert gone == [{303}, set(), {401}, {302}, set()]
    cleaned = spark.read.parquet(str(tmp_path / "line_dedup")).where("doc_id = 301").first()
    assert cleaned["text"] == sentence("en", 902) and cleaned["n_chars"] == len(cleaned["text"])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {*range(150), 300, 301, 400}


def test_stages_take_odd_and_empty_tables(spark, tmp_path, odd, empty):
    spark.createDataFrame([(None, None), (1, "x")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for frame in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, frame, str(tmp_path)).count() >= 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_queries_agree_with_sql(spark, key):
    import duckdb

    connection = duckdb.connect()
    for name in ("documents", "benchmark", "pages"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    frame = queries.QUERIES[key](spark, "/root/testdata/sf0.001")
    answer = connection.sql(queries.ORACLES[key])
    order = [answer.columns.index(c) for c in frame.columns]
    assert sorted(tuple(map(str, r)) for r in frame.collect()) == sorted(tuple(str(r[i]) for i in order) for r in answer.fetchall())
