import random

import pytest
from pyspark.sql import functions as F

from nearfield.operators.embedding import provider_factory
from nearfield.plans.ingest import ChunkOptions
from nearfield.streaming.changes import (
    ChangeLog, ChangeSettings, apply_changes, classify_changes, effective_changes, follow_sheet,
)

SCHEMA = "seq bigint, op string, doc_id string, full_document struct<text: string, category: string, source: string>"
SETTINGS = ChangeSettings(provider_factory("hashing", dimensions=8), ChunkOptions(chunk_tokens=50))


def random_changes(n=400, docs=25, seed=2):
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        op = rng.choice(["insert", "update", "update", "delete", "replace"])
        text = rng.choice([None, "", " " * 70, "short", "One sentence here. " * rng.randint(3, 60)])
        doc = None if op == "delete" or rng.random() < 0.1 else (text, f"c{seq}", rng.choice([None, "own"]))
        hot = "d0" if rng.random() < 0.33 else f"d{rng.randrange(docs)}"  # one document gets a third of all changes
        out.append((seq, op, None if rng.random() < 0.02 else hot, doc))
    return out


def one_by_one(changes):
    """What applying the changes in order leaves: document -> (seq, text, category, source)."""
    docs = {}
    for seq, op, doc_id, doc in changes:
        if doc_id is None or op not in ("insert", "update", "delete"):
            continue
        if op == "delete":
            docs.pop(doc_id, None)
        elif doc is not None:
            docs.pop(doc_id, None)
            if doc[0] and doc[0].strip():
                docs[doc_id] = (seq, *doc)
    return docs


def summary(points):
    rows = points.groupBy("doc_id", "category", "source").agg(F.count("*").alias("n"), F.countDistinct("id").alias("u")).collect()
    assert all(r.n == r.u for r in rows)
    return sorted((r.doc_id, r.category, r.source) for r in rows)


def expected(changes):
    return sorted((d, category, source or "mongo") for d, (_, _, category, source) in one_by_one(changes).items())


@pytest.fixture(scope="module")
def changes():
    return random_changes()


def test_classify(spark):
    doc = ("text", "c", None)
    rows = [
        (1, "insert", "a", doc), (2, "update", "a", None), (3, "update", "a", ("", "c", None)), (4, "delete", "a", None),
        (5, "insert", None, doc), (6, "replace", "a", doc), (7, None, "a", doc), (8, "insert", "a", (" ", "c", None)),
    ]
    got = classify_changes(spark.createDataFrame(rows, SCHEMA)).orderBy("seq").collect()
    assert [r.action for r in got] == ["upsert", "ignore", "delete", "delete", "ignore", "ignore", "ignore", "upsert"]


def test_last_change_per_document_is_picked_before_the_shuffle(spark, changes):
    plan = effective_changes(spark.createDataFrame(changes, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    before = plan[plan.index("Exchange"):]
    assert "WindowGroupLimit" in before and "Partial" in before


def test_batch_equals_one_by_one(spark, changes):
    empty = spark.createDataFrame([], "doc_id string, id string, category string, source string, text string")
    assert summary(apply_changes(empty, spark.createDataFrame(changes, SCHEMA), SETTINGS)) == expected(changes)
    half = apply_changes(empty, spark.createDataFrame(changes[:200], SCHEMA), SETTINGS)
    whole = apply_changes(half, spark.createDataFrame(changes[200:], SCHEMA), SETTINGS)
    assert summary(whole) == expected(changes)


def test_untouched_documents_stay(spark):
    points = spark.createDataFrame([("keep", "1", "t"), ("go", "2", "t")], "doc_id string, id string, text string")
    change = spark.createDataFrame([(1, "delete", "go", None)], SCHEMA)
    assert [r.doc_id for r in apply_changes(points, change, SETTINGS).collect()] == ["keep"]


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_in_any_file_order_and_after_a_restart(spark, changes, tmp_path, seed):
    rng = random.Random(seed)
    shuffled = list(changes)
    rng.shuffle(shuffled)  # late changes: order comes from seq alone
    source = str(tmp_path / "in")
    log = ChangeLog(spark, str(tmp_path / "out"))

    def put(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        log.follow(stream, str(tmp_path / "state"), SETTINGS, once=True).awaitTermination()

    put(shuffled[:100])
    put(shuffled[100:250])
    run()
    put(shuffled[250:])
    run()  # a new query goes on from the checkpoint
    assert summary(log.points()) == expected(changes)
    # a batch written again, and changes seen twice, change nothing
    log.write_batch(spark.createDataFrame(shuffled[250:], SCHEMA), 2, SETTINGS)
    log.write_batch(spark.createDataFrame(shuffled[:300], SCHEMA), 7, SETTINGS)
    assert summary(log.points()) == expected(changes)


def test_failed_embedding_keeps_old_points(spark, tmp_path):
    class Broken:
        name, dimensions, max_input_tokens = "broken", 2, 10

        def embed_batch(self, texts):
            raise RuntimeError("no model")

    log = ChangeLog(spark, str(tmp_path / "log"))
    log.write_batch(spark.createDataFrame([(1, "insert", "a", ("first", "c", None))], SCHEMA), 0, SETTINGS)
    again = spark.createDataFrame([(2, "update", "a", ("second", "c", None))], SCHEMA)
    with pytest.raises(Exception, match="no model"):
        log.write_batch(again, 1, ChangeSettings(Broken))
    assert [r.text for r in log.points().collect()] == ["first"]


def test_compaction(spark, changes, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"))
    log.write_batch(spark.createDataFrame(changes, SCHEMA), 0, SETTINGS)
    base = spark.createDataFrame(
        [("d0", "x", "old", "base"), ("other", "y", "kept", "base")], "doc_id string, id string, category string, source string"
    )
    assert summary(log.applied_to(base)) == sorted([*expected(changes), ("other", "kept", "base")])


def test_sheet_exports_are_taken_in_one_after_the_other(spark, tmp_path):
    folder, log = tmp_path / "in", ChangeLog(spark, str(tmp_path / "log"))
    folder.mkdir()
    settings = ChangeSettings(
        provider_factory("hashing", dimensions=8), metadata=["row_key", "sheet_name", "tag"], source="google_sheets"
    )

    def run():
        follow_sheet(
            log, str(folder), ["q", "a", "tag"], str(tmp_path / "state"), settings,
            spreadsheet="id", sheet="S", key="q", text_columns=["q", "a"], metadata_columns=["tag"],
        ).awaitTermination()

    (folder / "1.csv").write_text("q,a,tag\nk1,old,x\nk1,older row,\nk2,\"two\nlines\",y\n")
    run()
    (folder / "2.csv").write_text("q,a,tag\nk1,new,z\n")
    run()
    run()
    got = {r.doc_id: (r.text, r.tag, r.source, r.sheet_name) for r in log.points().collect()}
    assert got == {
        "sheet_S_k1": ("q: k1\na: new", "z", "google_sheets", "S"),
        "sheet_S_k2": ("q: k2\na: two\nlines", "y", "google_sheets", "S"),
    }
