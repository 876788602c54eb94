import numpy as np
import pytest

from nearfield.functions import filters as flt
from nearfield.operators.index import build_index, recall, search_index
from nearfield.operators.search import search
from nearfield.operators.topk import BestK
from nearfield.plans.query import QueryOptions, query_summary, query_vectors, run_queries
from nearfield.session import scratch_path


def brute(points, queries, k, metric, threshold=None):
    out = []
    for qid, q in queries:
        scored = []
        for pid, p in points:
            q_, p_ = np.asarray(q, float), np.asarray(p, float)
            if metric == "euclid":
                score = float(np.sqrt(((p_ - q_) ** 2).sum()))
                keep, order = threshold is None or score <= threshold, score
            else:
                score = float((p_ * q_).sum())
                if metric == "cosine":
                    norm = np.sqrt((p_ * p_).sum()) * np.sqrt((q_ * q_).sum())
                    score = score / norm if norm else 0.0
                keep, order = threshold is None or score >= threshold, -score
            if keep:
                scored.append((order, pid, score))
        scored.sort()
        out += [(qid, i + 1, pid, round(score, 9)) for i, (_, pid, score) in enumerate(scored[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def data():
    """A third of all points are copies of one vector; some have no length."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 8))
    hot = rng.normal(size=8)
    vectors = [hot if i % 3 == 0 else (np.zeros(8) if i % 40 == 1 else base[i]) for i in range(120)]
    points = [(f"p{i:03d}", v.tolist()) for i, v in enumerate(vectors)]
    queries = [(i, rng.normal(size=8).tolist()) for i in range(12)] + [(98, hot.tolist()), (99, [0.0] * 8)]
    return points, queries


@pytest.fixture(scope="module")
def frames(spark, data):
    points, queries = data
    return (
        spark.createDataFrame(points, "id string, vector array<double>").repartition(5).cache(),
        spark.createDataFrame(queries, "query_id int, vector array<double>").cache(),
    )


def listed(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("metric, threshold", [("cosine", None), ("cosine", 0.2), ("dot", None), ("euclid", None), ("euclid", 3.0)])
@pytest.mark.parametrize("broadcast_rows", [100, 0])
def test_exact_search(data, frames, metric, threshold, broadcast_rows):
    got = search(*frames, 7, metric=metric, threshold=threshold, broadcast_rows=broadcast_rows)
    assert listed(got) == brute(*data, 7, metric, threshold)


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid"])
def test_many_small_batches(data, frames, metric, monkeypatch):
    from nearfield.operators import search as module

    monkeypatch.setattr(module, "BROADCAST_BYTES", 400)
    got = search(*frames, 7, metric=metric, broadcast_rows=0)
    assert "Exchange hashpartitioning(id" not in got._jdf.queryExecution().executedPlan().toString()
    assert listed(got) == brute(*data, 7, metric)


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid"])
def test_one_bad_point_or_query_spoils_no_other(spark, metric):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(40)]
    bad = [(50, [float("nan"), 1.0, 2.0]), (51, [None, 1.0, 2.0]), (52, [float("inf"), 1.0, 2.0]), (53, [0.0, 1.0, 2.0])]
    points = spark.createDataFrame(rows + bad, "id long, vector array<double>").coalesce(1)
    got = search(points, points.withColumnRenamed("id", "query_id"), 5, metric=metric).collect()
    assert len(got) == 44 * 5
    of = lambda q: sorted((r.rank, r.id, r.score) for r in got if r.query_id == q)
    assert of(50) == of(51) == of(52) == of(53)


def test_more_hits_than_points(data, frames):
    assert listed(search(*frames, 500)) == brute(*data, 500, "cosine")


@pytest.mark.parametrize("metric", ["cosine", "euclid"])
def test_index_search_is_exact(spark, data, frames, metric):
    points, queries = frames
    path = scratch_path(spark, "ix")
    build_index(points, path, 8, metric=metric)
    assert listed(search_index(spark, path, queries, 7, probes=None)) == brute(*data, 7, metric)
    threshold = 0.3 if metric == "cosine" else 2.5
    assert listed(search_index(spark, path, queries, 7, probes=8, threshold=threshold)) == brute(*data, 7, metric, threshold)
    near = search_index(spark, path, queries, 7, probes=1)
    # The same queries find the same, alone or among others.
    few = queries.limit(3)
    alone, among = listed(search_index(spark, path, few, 7, probes=1)), listed(search_index(spark, path, queries, 7, probes=1, broadcast_rows=4))
    assert among == listed(near) and all(row in among for row in alone)
    share = recall(near, search(points, queries, 7, metric=metric)).first()[0]
    assert 0 < share <= 1


def test_blocks_in_any_order_give_the_same():
    rng = np.random.default_rng(1)
    points = np.round(rng.normal(size=(5000, 4)), 1)  # many ties
    ids = np.arange(5000)
    queries = np.round(rng.normal(size=(30, 4)), 1)
    results = []
    for seed in (1, 2):
        order = np.random.default_rng(seed).permutation(5000)
        best = BestK(queries, 20, "cosine")
        for part in np.array_split(order, 7):
            best.offer(ids[part], points[part])
        results.append([x.tolist() for x in best.result()])
    assert results[0] == results[1]


def test_bad_requests(frames):
    with pytest.raises(ValueError):
        search(*frames, 0)
    with pytest.raises(ValueError):
        search(*frames, 1001)
    with pytest.raises(ValueError):
        search(*frames, 5, metric="manhattan")
    for options in ({"top_k": 0}, {"fetch_k": 1001}, {"mmr_lambda": 1.1}, {"threshold": 2}, {"where": {"x": []}}):
        with pytest.raises(ValueError):
            QueryOptions(**options)


def test_wrong_vector_size_fails(spark, frames):
    odd = spark.createDataFrame([("x", [1.0])], "id string, vector array<double>")
    with pytest.raises(Exception, match="expected vectors of 8 values"):
        search(frames[0].unionByName(odd), frames[1], 3).collect()


def test_run_queries_filters_then_projects(spark, frames):
    points, queries = frames
    tagged = points.selectExpr("*", "case when id < 'p060' then 'low' end as half")
    options = QueryOptions(top_k=4, where=flt.none_of("half", ["low"]), payload=["half"], with_vectors=True)
    rows = run_queries(tagged, queries, options).collect()
    assert {r.half for r in rows} == {None} and all(r.id >= "p060" and len(r.vector) == 8 for r in rows)
    assert len(rows) == 4 * queries.count()


def test_mmr_wins_and_fetch_limits(frames):
    both = QueryOptions(top_k=5, fetch_k=3, mmr=True, diversity=True)
    assert both.fetch == 5
    rows = run_queries(*frames, both)
    # the re-ranker looks at fetch_k hits only, so fewer than top_k come back
    assert {r["count"] for r in rows.groupBy("query_id").count().collect()} == {3}
    flags = query_summary(rows, frames[1], both).collect()
    assert {(r.actual_k, r.mmr_applied, r.diversity_applied) for r in flags} == {(3, True, False)}
    none = QueryOptions(top_k=5, threshold=1.0, mmr=True, where=flt.match("id", "nobody"))
    flags = query_summary(run_queries(*frames, none), frames[1], none).collect()
    assert {(r.actual_k, r.mmr_applied) for r in flags} == {(0, False)}


def test_a_query_vector_beats_its_text(spark):
    from nearfield.operators.embedding import provider_factory

    make = provider_factory("hashing", dimensions=4, normalize=False)
    queries = spark.createDataFrame(
        [(1, "some words", [1.0, 0.0, 0.0, 0.0]), (2, "some words", None)], "query_id int, text string, vector array<double>"
    )
    rows = {r.query_id: r.vector for r in query_vectors(queries, make).collect()}
    assert rows[1] == [1.0, 0.0, 0.0, 0.0]
    assert rows[2] == make().embed_batch(["some words"])[0].tolist()
    with pytest.raises(ValueError):
        query_vectors(queries)


def test_points_and_queries_without_vectors_take_no_part(spark, data, frames):
    points, queries = frames
    more_points = points.unionByName(spark.createDataFrame([("none", None)], "id string, vector array<double>"))
    more_queries = queries.unionByName(spark.createDataFrame([(7777, None)], "query_id int, vector array<double>"))
    for rows in (100, 0):
        assert listed(search(more_points, more_queries, 3, broadcast_rows=rows)) == brute(*data, 3, "cosine")
    assert search(points.limit(0), queries, 3).count() == 0
    assert search(points, queries.limit(0), 3).count() == 0


def test_single_precision_points(spark, data, frames):
    points, queries = frames
    single = points.selectExpr("id", "cast(vector as array<float>) as vector")
    kept = [(r.id, r.vector) for r in single.collect()]
    assert listed(search(single, queries, 5)) == brute(kept, data[1], 5, "cosine")


def test_values_beyond_single_precision():
    """Vectors far from the origin, and very small or large ones, still rank exactly."""
    rng = np.random.default_rng(4)
    for metric, move, scale in (("euclid", 1e7, 1.0), ("dot", 0.0, 1e-15), ("euclid", 0.0, 1e9), ("cosine", 0.0, 1e-30)):
        points = (rng.normal(size=(3000, 6)) + move) * scale
        queries = (rng.normal(size=(9, 6)) + move) * scale
        best = BestK(queries, 8, metric)
        for part in np.array_split(np.arange(3000), 5):
            best.offer(part, points[part])
        q, ids, _ = best.result()
        for i in range(9):
            if metric == "euclid":
                order = np.sqrt(((points - queries[i]) ** 2).sum(axis=1))
            else:
                order = -(points * queries[i]).sum(axis=1)
                if metric == "cosine":
                    order = order / np.sqrt((points**2).sum(axis=1)) / np.sqrt((queries[i] ** 2).sum())
            assert ids[q == i].tolist() == np.argsort(order, kind="stable")[:8].tolist(), metric


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid"])
def test_blocks_of_queries_meet_blocks_of_points(data, frames, metric, monkeypatch):
    """More queries than go to every task: none is fetched, and nothing depends on how the blocks are cut."""
    from nearfield.operators import blockjoin

    monkeypatch.setattr(blockjoin, "PACK_ROWS", 7)
    monkeypatch.setattr(blockjoin, "BLOCK_POINTS", 20)
    points, queries = frames
    hits = search(points, queries, 7, metric=metric, broadcast_rows=3)
    assert listed(hits) == brute(*data, 7, metric)
    plan = hits._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("most", [3, 100])
def test_points_travel_once_for_each_block_of_queries(data, frames, most, monkeypatch):
    """A block holds what fits a task, not just what would be sent to every task, and many blocks find the same."""
    from nearfield.operators import blockjoin
    from nearfield.operators import search as module

    monkeypatch.setattr(blockjoin, "BLOCK_QUERIES", most)
    seen = []
    monkeypatch.setattr(module, "meet", lambda points, queries, parts, *more: seen.append(parts) or blockjoin.meet(points, queries, parts, *more))
    assert listed(search(*frames, 7, broadcast_rows=2)) == brute(*data, 7, "cosine")
    [(_, q_parts, _)] = seen[0]
    assert q_parts == -(-len(data[1]) // most)


def test_many_copies_of_one_point_and_one_query(spark):
    points = [(i, [1.0, 0.0]) for i in range(3000)] + [(5000 + i, [0.0, float(i + 1)]) for i in range(5)]
    queries = [(i, [1.0, 0.001 * i]) for i in range(50)]
    frames = [spark.createDataFrame(rows, f"{name} long, vector array<double>") for rows, name in ((points, "id"), (queries, "query_id"))]
    hits = search(*frames, 4, broadcast_rows=5)
    assert listed(hits) == brute(points, queries, 4, "cosine")


@pytest.fixture(scope="module")
def payload_index(spark):
    """Points around eight far apart centres, the payload telling them apart in part."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 6)) * 10
    rows = [
        (i, (centres[i % 8] + rng.normal(size=6)).tolist(), f"kind{i % 8 // 2}", int(i % 50), None if i % 3 else "rare") for i in range(400)
    ]
    points = spark.createDataFrame(rows, "id long, vector array<double>, kind string, n int, tag string")
    path = scratch_path(spark, "index")
    build_index(points, path, 8, metric="euclid", keep=["kind", "n", "tag"], centres=centres)
    queries = spark.createDataFrame([(i, v) for i, v, *_ in rows[:40]], "query_id long, vector array<double>")
    return points, path, queries


FILTERS = [
    {"must": [{"key": "kind", "match": {"value": "kind2"}}]},
    {"must": [{"key": "n", "range": {"gte": 40}}], "must_not": [{"key": "tag", "match": {"value": "rare"}}]},
    {"should": [{"key": "kind", "match": {"value": "kind0"}}, {"key": "n", "range": {"lt": 2}}]},
    {"must": [{"key": "kind", "match": {"value": "nowhere"}}]},
    {"must": [{"key": "n", "match": {"value": 3.5}}]},
    {"must": [{"key": "n", "match": {"value": "3"}}]},
]


def test_all_cells_are_one_for_many_queries(spark, data, frames, monkeypatch):
    """Queries that read every cell are not sent to each of them."""
    from nearfield.operators import index as module

    path, seen = scratch_path(spark, "index"), []
    build_index(frames[0], path, cells=5)
    whole = module.meet
    monkeypatch.setattr(module, "meet", lambda points, queries, parts, *more: seen.append(parts) or whole(points, queries, parts, *more))
    assert listed(search_index(spark, path, frames[1], 7, probes=None, broadcast_rows=3)) == brute(*data, 7, "cosine")
    assert [cell for cell, _, _ in seen[0]] == [0]


@pytest.mark.parametrize("where", FILTERS)
@pytest.mark.parametrize("broadcast_rows", [1000, 7])
def test_filtered_index_search(payload_index, spark, where, broadcast_rows):
    points, path, queries = payload_index
    exact = listed(search(points, queries, 5, metric="euclid", where=where))
    every = search_index(spark, path, queries, 5, probes=None, where=where, broadcast_rows=broadcast_rows)
    assert listed(every) == exact
    # One probe goes on until five points pass, so no query comes back with fewer than there are.
    some = search_index(spark, path, queries, 5, probes=1, where=where, broadcast_rows=broadcast_rows)
    assert some.count() == len(exact)


def test_a_filter_leaves_out_cells_unread(payload_index, spark):
    from nearfield.operators.index import Cells

    _, path, _ = payload_index
    assert (Cells(spark, path, {"must": [{"key": "kind", "match": {"value": "kind2"}}]}).counts > 0).sum() == 2
    assert (Cells(spark, path, {"must": [{"key": "n", "range": {"gt": 49}}]}).counts > 0).sum() == 0
    assert len(Cells(spark, path, {"must": [{"key": "kind", "match": {"value": "kind2"}}]}).points.inputFiles()) > 0


def test_a_request_on_the_index(payload_index, spark):
    points, path, queries = payload_index
    options = QueryOptions(top_k=3, fetch_k=8, metric="euclid", where=FILTERS[1], threshold=30.0, mmr=True, payload=["kind"], probes=None)
    by_index, exact = (run_queries(p, queries, options, index=i).orderBy("query_id", "rank").collect() for p, i in ((None, path), (points, None)))
    assert by_index == exact and exact


def test_measured_recall(payload_index, spark):
    from nearfield.operators.index import fit_recall, fitted_probes

    points, path, queries = payload_index
    table = {r.probes: r for r in fit_recall(spark, path, 10, queries=queries).collect()}
    assert sorted(table) == list(range(1, 9)) and table[8].recall == 1 and table[8].points_read == pytest.approx(1)
    exact = search(points, queries, 10, metric="euclid")
    for probes in (1, 3):
        found = search_index(spark, path, queries, 10, probes=probes)
        assert recall(found, exact).first()[0] == pytest.approx(table[probes].recall)
    wanted = fitted_probes(spark, path, table[3].recall)
    assert table[wanted].recall >= table[3].recall
    assert listed(search_index(spark, path, queries, 10, wanted_recall=1.0)) == listed(exact)
    drawn = fit_recall(spark, path, 10).collect()
    assert len(drawn) == 8 and all(a.recall <= b.recall for a, b in zip(drawn, drawn[1:]))
