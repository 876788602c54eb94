"""Bulk syncs into the points table: emptied documents, what changed, and texts embedded before."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators.embedding import EmbeddingCache, HashingProvider, embed_texts
from nearfield.plans.ingest import compare_documents, run_sync
from nearfield.sources.tables import PointTable

DOC = "doc_id long, text string, lang string"
LONG = "words that are long enough to make a chunk of their own, "


def counting(spark, **options):
    """A factory of providers that count their texts and calls."""
    texts, calls = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    class Counting(HashingProvider):
        def embed_batch(self, some):
            texts.add(len(some))
            calls.add(1)
            if any("refused" in text for text in some):
                raise ValueError("text refused")
            return super().embed_batch(some)

    def factory():
        made = Counting(8)
        for name, value in options.items():
            setattr(made, name, value)
        return made

    return factory, texts, calls


def sync(docs, table, factory, **more):
    stats, failed = run_sync(docs, table, factory, synced_at=F.lit(more.pop("at", "now")), embedding=None, **more)
    return stats.first().asDict(), [r.doc_id for r in failed.collect()]


def docs_of(table):
    return {(r.doc_id, r.synced_at) for r in table.read().collect()}


def test_a_document_that_became_blank_loses_its_points(spark, tmp_path):
    table, (factory, _, _) = PointTable(spark, str(tmp_path / "points"), buckets=4), counting(spark)
    sync(spark.createDataFrame([(1, LONG, "en"), (2, LONG + "two", "en"), (3, LONG, "en")], DOC), table, factory, at="first")
    again = [(1, " " * 80, "en"), (2, LONG + "refused", "en"), (3, None, "en"), (4, "a new one", "en")]
    stats, failed = sync(spark.createDataFrame(again, DOC), table, factory, at="second")
    # 1 is blank, 2 failed, 3 was skipped for want of a text.
    assert docs_of(table) == {(2, "first"), (3, "first"), (4, "second")}
    assert failed == [2] and stats["documents_processed"] == 2 and stats["chunks_created"] == 1


def test_all_documents_blank(spark, tmp_path):
    table, (factory, _, _) = PointTable(spark, str(tmp_path / "points"), buckets=4), counting(spark)
    blank = spark.createDataFrame([(1, " " * 80, "en")], DOC)
    assert sync(blank, table, factory)[0]["chunks_created"] == 0 and table.spec() is None
    sync(spark.createDataFrame([(1, LONG, "en")], DOC), table, factory)
    sync(blank, table, factory)
    assert table.read().count() == 0


def test_only_what_changed(spark, tmp_path):
    table, (factory, texts, _) = PointTable(spark, str(tmp_path / "points"), buckets=8), counting(spark)
    first = [(i, LONG + str(i), "en") for i in range(20)]
    sync(spark.createDataFrame(first, DOC), table, factory, at="first", metadata=["lang"], only_changed=True)
    assert texts.value == 20
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "points" / "points").rglob("*.parquet")}
    stats, _ = sync(spark.createDataFrame(first, DOC), table, factory, at="again", metadata=["lang"], only_changed=True)
    assert texts.value == 20 and stats["documents_unchanged"] == 20 and stats["documents_processed"] == 0
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "points" / "points").rglob("*.parquet")} == files  # nothing rewritten
    later = [(0, LONG + "0", "fr"), (1, LONG + "changed", "en"), *first[2:18], (30, LONG, "en")]
    stats, _ = sync(spark.createDataFrame(later, DOC), table, factory, at="later", metadata=["lang"], only_changed=True, drop_gone=True)
    assert texts.value == 23 and stats["documents_dropped"] == 2 and stats["documents_unchanged"] == 16
    assert docs_of(table) == {(0, "later"), (1, "later"), (30, "later")} | {(i, "first") for i in range(2, 18)}


def test_states(spark):
    docs = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (5, 50)], "doc_id long, h long")
    points = spark.createDataFrame([(1, 10), (1, 10), (2, 21), (4, 40), (5, None)], "doc_id long, content_hash long")
    found = compare_documents(docs, points, F.col("h")).collect()
    assert {r.doc_id: r.state for r in found} == {1: "same", 2: "changed", 3: "new", 4: "gone", 5: "changed"}
    old = compare_documents(docs, points.drop("content_hash"), F.col("h")).collect()
    assert {r.doc_id: r.state for r in old} == {1: "changed", 2: "changed", 3: "new", 4: "gone", 5: "changed"}


def test_cache_sends_a_text_once(spark, tmp_path):
    cache, (factory, texts, _) = EmbeddingCache(spark, str(tmp_path / "cache")), counting(spark)
    rows = [(i, t) for i, t in enumerate(["one", "two", "one", None, "", "refused", "three"])]
    table = spark.createDataFrame(rows, "id long, text string").repartition(4)
    first = cache.embed(table, factory, error="error").orderBy("id").collect()
    sent = texts.value
    plain = embed_texts(table, lambda: HashingProvider(8)).orderBy("id").collect()
    assert [r.vector for r in first if r.id != 5] == [r.vector for r in plain if r.id != 5]
    assert first[5].vector is None and first[5].error == "text refused" and first[3].vector is None and first[3].error is None
    cache.embed(table.where("id <> 5"), factory, error="error").collect()
    assert texts.value == sent  # no call at all
    again = cache.embed(table, factory, error="error").orderBy("id").collect()
    assert texts.value == sent + 1 and again == first  # only the text that failed
    other = counting(spark)[0]
    assert cache.known(other()).count() == 4
    with pytest.raises(Exception, match="text refused"):
        cache.embed(table, factory).collect()


def test_a_failing_slice_is_halved(spark):
    factory, _, calls = counting(spark, slice_size=256)
    rows = [(i, "refused" if i == 77 else f"text {i}") for i in range(256)]
    found = embed_texts(spark.createDataFrame(rows, "id long, text string").coalesce(1), factory, error="error").collect()
    assert [r.id for r in found if r.error] == [77] and all(r.vector for r in found if not r.error)
    assert calls.value <= 2 * 8 + 1  # not one call per text


def test_calls_that_fail_for_a_while_are_tried_again(spark):
    class Shaky(HashingProvider):
        retries, retry_wait, left = 2, 0.0, 2

        def embed_batch(self, some):
            if self.left:
                self.left -= 1
                raise ConnectionError("not now")
            return super().embed_batch(some)

    table = spark.createDataFrame([(1, "a text")], "id long, text string")
    assert np.isfinite(embed_texts(table, lambda: Shaky(4)).first().vector).all()
    Shaky.left = 3
    with pytest.raises(Exception, match="not now"):
        embed_texts(table, lambda: Shaky(4)).collect()


def test_a_document_is_one_bucket(spark, tmp_path, monkeypatch):
    from nearfield.sources import tables

    monkeypatch.setattr(tables, "FILE_POINTS", 10)
    table = PointTable(spark, str(tmp_path / "points"), buckets=8)
    rows = [(f"{d}-{i}", d, [float(d), float(i)]) for d in range(30) for i in range(6)]
    table.upsert(spark.createDataFrame(rows, "id string, doc_id long, vector array<double>"))
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "points" / "points").rglob("*.parquet")}
    assert len(files) > 8  # as many as their sizes ask for
    plan = table._scan({"doc_id": 7})._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    assert {p.split("bucket=")[1].split("/")[0] for p in table._scan({"doc_id": 7}).inputFiles()} != set()
    assert table.delete(doc_id=7) == ("doc_id", 6)
    untouched = {p.parent for p, at in files.items() if p.exists() and p.stat().st_mtime_ns == at}
    assert len(untouched) == 7
    # A point that comes under another document leaves its old bucket.
    table.upsert(spark.createDataFrame([("3-0", 4, [0.0, 0.0])], "id string, doc_id long, vector array<double>"))
    assert [(r.doc_id, r.vector) for r in table.read().where("id = '3-0'").collect()] == [(4, [0.0, 0.0])]
    table.replace(spark.createDataFrame([("new", 5, [1.0, 1.0])], "id string, doc_id long, vector array<double>"), spark.createDataFrame([(5,), (6,)], "doc_id long"))
    assert [r.id for r in table.read().where("doc_id in (5, 6)").collect()] == ["new"]
    assert table.delete(ids=["new", "3-0"]) == ("ids", 2)


def test_a_sync_stores_its_points_once(spark, tmp_path):
    """Beside the table itself only what the provider returned is written, and not again for every step."""
    from nearfield import session

    docs = spark.createDataFrame([(i, f"Some text of document {i}. " * 20) for i in range(30)], "doc_id long, text string")
    table, before = PointTable(spark, str(tmp_path / "points"), buckets=4), len(session._stored)
    for again in range(2):
        run_sync(docs, table, lambda: HashingProvider(8), synced_at=F.lit(str(again)), embedding=None)
    wide = [p for p in session._stored[before:] if "vector" in spark.read.parquet(p).columns]
    assert len(wide) == 2
    assert table.read().select("synced_at").distinct().collect() == [("1",)] and table.read().select("doc_id").distinct().count() == 30
