"""The registered queries and the pipeline, over the smallest tables."""

from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
import corpus_pipeline
from nearfield.llm import exact_dedup, queries, toxicity

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in check.TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(queries.SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_agrees_with_sql(spark, db, name):
    assert check.compare(spark, db, name, FOLDER).startswith("ok")


def test_language_of_held_out_rows(spark):
    got = queries.op2_compression_language(spark, FOLDER)
    known = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    both = got.where("held_out").join(known, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in both) >= 0.9 * len(both)


def test_pipeline(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, sizes = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stored(stage(spark, docs, FOLDER), name)
        sizes[name] = docs.count()
        if name == "drop_toxic":
            labels = spark.read.parquet(f"{FOLDER}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
            bad = {r.doc_id for r in toxicity.toxicity(before, labels).where("score >= 0.5").collect()}
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()} - bad
        elif name == "drop_copies":
            last = defaultdict(int)
            for r in before.collect():
                last[r.text] = max(last[r.text], r.doc_id)
            assert {r.doc_id for r in docs.collect()} == set(last.values())
        elif name == "drop_near_copies":
            assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before.collect()}
            assert exact_dedup.dedup(docs).where("not kept").count() == 0
        elif name == "mix_sources":
            assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before.collect()}
        if name != "pack_sequences":
            assert docs.columns == columns
    kept = {r.doc_id for r in before.collect()}
    assert {r.doc_id for r in docs.collect()} == kept
