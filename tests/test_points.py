import pytest
from pyspark.sql import functions as F

from nearfield.functions import filters as flt
from nearfield.operators import points as pt
from nearfield.sources.tables import PointTable


@pytest.fixture
def old(spark):
    return spark.createDataFrame(
        [("a", "d1", [1.0, 0.0], "x"), ("b", "d1", [0.0, 1.0], None), ("c", "d2", [1.0, 1.0], "y")],
        "id string, doc_id string, vector array<double>, tag string",
    )


def state(df):
    return sorted((r.id, r.doc_id, tuple(r.vector), r.tag) for r in df.collect())


def new_points(spark, rows):
    return spark.createDataFrame(rows, "id string, doc_id string, vector array<double>, turn int")


def test_upsert_replaces_whole_points_and_the_last_wins(spark, old):
    new = new_points(spark, [("a", "d9", [2.0, 2.0], 1), ("a", "d8", [3.0, 3.0], 2), ("z", "d3", [4.0, 4.0], 1)])
    got = pt.upsert_points(old, new, order="turn", dim=2)
    assert state(got) == [
        ("a", "d8", (3.0, 3.0), None), ("b", "d1", (0.0, 1.0), None), ("c", "d2", (1.0, 1.0), "y"), ("z", "d3", (4.0, 4.0), None)
    ]
    assert state(pt.upsert_points(got, new, order="turn")) == state(got)
    # Without an order the content decides, the same way however the rows are dealt.
    unordered = state(pt.upsert_points(old, new.coalesce(1).drop("turn")))
    assert state(pt.upsert_points(old, new.orderBy("turn").repartition(3).drop("turn"))) == unordered


def test_upsert_of_a_hot_id(spark, old):
    many = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise(F.concat(F.lit("n"), "id")).alias("id"),
        F.lit("d").alias("doc_id"),
        F.array(F.col("id").cast("double"), F.lit(0.0)).alias("vector"),
        F.col("id").alias("turn"),
    )
    got = pt.upsert_points(old, many, order="turn")
    assert got.count() == 2 + 1 + 13333
    assert got.where("id = 'a'").first().vector == [19998.0, 0.0]


def test_upsert_rejects_a_wrong_size(spark, old):
    new = new_points(spark, [("q", "d", [1.0, 2.0, 3.0], 1)])
    with pytest.raises(Exception, match="expected 2 values in the vector of point q"):
        pt.upsert_points(old, new, order="turn", dim=2).collect()
    assert [r.id for r in pt.check_dims(new, 2).collect()] == ["q"]
    nothing = new_points(spark, [("q", "d", None, 1)])
    assert pt.check_dims(nothing, 2).count() == 1


def test_delete_criteria_in_order(spark, old):
    by_id = pt.delete_points(old, ids=["a"], doc_id="d2", where=flt.match("tag", "y"))
    assert (by_id.deleted_by, by_id.count(), {r.id for r in by_id.remaining.collect()}) == ("ids", 1, {"b", "c"})
    by_doc = pt.delete_points(old, ids=[], doc_id="d1", where=flt.match("tag", "y"))
    assert (by_doc.deleted_by, {r.id for r in by_doc.remaining.collect()}) == ("doc_id", {"c"})
    by_filter = pt.delete_points(old, where=flt.match("tag", "x"))
    assert (by_filter.deleted_by, {r.id for r in by_filter.remaining.collect()}) == ("filter", {"b", "c"})
    table = pt.delete_points(old, ids=spark.createDataFrame([("a",), ("a",), ("nobody",)], "id string"))
    assert (table.count(), {r.id for r in table.remaining.collect()}) == (1, {"b", "c"})
    with pytest.raises(ValueError):
        pt.delete_points(old, ids=[])
    with pytest.raises(ValueError):
        pt.delete_points(old, where={"must": [{"key": "a"}]})


def test_delete_undoes_upsert(spark, old):
    new = new_points(spark, [("q", "d", [1.0, 2.0], 1)])
    assert state(pt.delete_points(pt.upsert_points(old, new, order="turn"), ids=["q"]).remaining) == state(old)


def test_replace_docs(spark, old):
    new = new_points(spark, [("n", "d1", [5.0, 5.0], 1)]).drop("turn")
    docs = spark.createDataFrame([("d1",), ("d2",)], "doc_id string")
    assert state(pt.replace_docs(old, new, docs)) == [("n", "d1", (5.0, 5.0), None)]


def test_shuffled_anti_join_agrees(spark, old):
    keys = spark.createDataFrame([("a",), ("c",)], "id string")
    assert state(pt.without_keys(old, keys, "id", small=1)) == state(pt.without_keys(old, keys, "id"))


def test_info_and_ids(spark, old):
    assert pt.points_info(old).first().asDict() == {"points": 3, "min_dim": 2, "max_dim": 2}
    ids = spark.createDataFrame([("550e8400-e29b-41d4-a716-446655440000",), ("doc_1#0",), (None,)], "id string")
    assert {r.id for r in pt.check_ids(ids).collect()} == {"doc_1#0", None}


def test_point_table(spark, old, tmp_path):
    table = PointTable(spark, str(tmp_path / "points"))
    with pytest.raises(ValueError, match="no points table"):
        table.ensure(2, create_if_missing=False)
    assert table.ensure(2) is True and table.ensure(2) is False
    with pytest.raises(ValueError):
        table.ensure(3)
    assert table.read().count() == 0
    table.upsert(old)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "points" / "points").rglob("*.parquet")}
    assert len(files) == 2  # one bucket for each document
    table.upsert(new_points(spark, [("z", "d", [9.0, 9.0], 1), ("a", "d", [7.0, 7.0], 1)]), order="turn")
    kept = [p for p, at in files.items() if p.exists() and p.stat().st_mtime_ns == at]
    assert len(kept) >= 1  # buckets of other documents are left alone
    assert {tuple(r.vector) for r in table.read().where("id in ('a', 'z')").collect()} == {(7.0, 7.0), (9.0, 9.0)}
    assert {r.id for r in table.read().collect()} == {"a", "b", "c", "z"}


def test_point_table_requests(spark, old, tmp_path):
    table = PointTable(spark, str(tmp_path / "points"))
    new = new_points(spark, [("a", "d1", [1.0, 2.0], 1), ("b", "d1", [3.0, 4.0], 1), ("a", "d2", [5.0, 6.0], 2)])
    with pytest.raises(ValueError, match="no points table"):
        table.upsert(new, create_if_missing=False)
    assert table.upsert(new, order="turn") == (3, True)
    assert table.upsert(new, order="turn") == (3, False)
    assert table.read().columns == ["id", "doc_id", "vector"]
    assert table.info().first().asDict() == {"points": 2, "dim": 2, "metric": "cosine"}
    assert table.delete(ids=["nobody"]) == ("ids", 0)
    with pytest.raises(ValueError, match="UUID"):
        table.upsert(new_points(spark, [("c", "d", [1.0, 1.0], 1)]), uuids=True)
    fresh = PointTable(spark, str(tmp_path / "fresh"))
    with pytest.raises(ValueError, match="expected 1 values"):
        fresh.upsert(new_points(spark, [("c", "d", [1.0], 1), ("e", "d", [1.0, 2.0], 1)]))
    with pytest.raises(ValueError, match="no vector"):
        fresh.upsert(new_points(spark, [("c", "d", None, 1)]))
    assert fresh.spec() is None
    with pytest.raises(Exception, match="expected 2 values"):
        table.upsert(new_points(spark, [("c", "d", [1.0], 1)]))
    assert table.info().first().points == 2  # the failed write left the old state
    table.replace(new_points(spark, [("n", "d1", [0.0, 1.0], 1)]).drop("turn"), spark.createDataFrame([("d1",)], "doc_id string"))
    assert {r.id for r in table.read().collect()} == {"a", "n"}
    assert table.delete(doc_id="d2") == ("doc_id", 1)
    assert table.delete(ids=["nobody"]) == ("ids", 0)
    assert {r.id for r in table.read().collect()} == {"n"}


def test_info_comes_from_footers(spark, old, tmp_path):
    from nearfield.session import settings
    from nearfield.sources.tables import FOOTERS

    table = PointTable(spark, str(tmp_path / "points"))
    table.upsert(old)
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    with settings(spark, FOOTERS):
        plan = table.totals()._jdf.queryExecution().toString()
        assert "PushedAggregation: [COUNT(*), MIN(vector_size), MAX(vector_size)]" in plan
        assert table.totals().first().asDict() == {"points": 3, "min_dim": 2, "max_dim": 2}
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    assert table.info().first().asDict() == {"points": 3, "dim": 2, "metric": "cosine"} and table.fits()
    assert "vector_size" not in table.read().columns
    assert PointTable(spark, str(tmp_path / "none")).info().first().points == 0
