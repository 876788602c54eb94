import math

import numpy as np
import pytest

from nearfield.operators.rerank import rerank_diversity, rerank_mmr


def cos(a, b):
    dot = sum(x * y for x, y in zip(a, b))
    norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return dot / norm if norm else 0.0


def greedy(hits, top_k, value):
    picked, left = [], list(hits)
    while left and len(picked) < top_k:
        values = [value(h, [p for p, _ in picked]) for h in left]
        at = max(range(len(left)), key=lambda i: (values[i], -i))
        picked.append((left.pop(at), values[at]))
    return [(h["id"], round(v, 9)) for h, v in picked]


def mmr(hits, query, top_k, lam, fetch):
    hits = [h for h in hits[:fetch] if h["vector"]]
    return greedy(
        hits, top_k,
        lambda h, done: lam * cos(query, h["vector"])
        - (1 - lam) * (max(cos(h["vector"], d["vector"]) for d in done) if done else 0),
    )


def diverse(hits, top_k, w):
    hits = [h for h in hits if h["vector"]]

    def value(h, done):
        if not done:
            return h["score"] if h is hits[0] else -math.inf
        return h["score"] * (1 - w) - w * sum(cos(h["vector"], d["vector"]) for d in done) / len(done)

    return greedy(hits, top_k, value)


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(11)
    queries, hits = {}, {}
    for q in range(40):
        query = rng.normal(size=6).tolist()
        found = [{"id": f"h{i}", "vector": rng.normal(size=6).tolist()} for i in range(int(rng.integers(1, 60)))]
        if q % 4 == 0 and len(found) > 5:  # copies tie; the earlier hit wins
            for i in range(2, len(found), 2):
                found[i]["vector"] = found[0]["vector"]
        if q % 5 == 0:
            found[-1]["vector"] = None
        for h in found:
            h["score"] = cos(query, h["vector"]) if h["vector"] else 0.1
        found.sort(key=lambda h: -h["score"])
        queries[q], hits[q] = query, found
    rows = [(q, r, h["id"], h["score"], h["vector"], queries[q]) for q, hs in hits.items() for r, h in enumerate(hs, 1)]
    schema = "query_id int, rank int, id string, score double, vector array<double>, query_vector array<double>"
    return queries, hits, spark.createDataFrame(rows, schema).repartition(6).cache()


def picks(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.mmr_rank)):
        found.setdefault(r.query_id, []).append((r.id, round(r.mmr_score, 9)))
    return found


@pytest.mark.parametrize("lam, fetch", [(0.7, 50), (0.3, 20), (1.0, 50), (0.0, 50)])
def test_mmr(case, lam, fetch):
    queries, hits, df = case
    got = picks(rerank_mmr(df, top_k=10, lambda_=lam, fetch_k=fetch))
    for q in queries:
        want = mmr(hits[q], queries[q], 10, lam, fetch)
        if want:
            assert [i for i, _ in got[q]] == [i for i, _ in want] or got[q] == pytest.approx(want), q
            assert [v for _, v in got[q]] == pytest.approx([v for _, v in want], abs=1e-8)


def test_lambda_one_keeps_search_order(case):
    queries, hits, df = case
    got = picks(rerank_mmr(df, top_k=10, lambda_=1.0, fetch_k=50))
    for q in queries:
        kept = [h["score"] for h in hits[q][:50] if h["vector"]][:10]
        assert [v for _, v in got.get(q, [])][: len(kept)] == pytest.approx(kept)


def test_diversity(case):
    queries, hits, df = case
    got = picks(rerank_diversity(df.drop("query_vector"), top_k=10))
    for q in queries:
        want = diverse(hits[q], 10, 0.3)
        if want:
            assert [v for _, v in got[q]] == pytest.approx([v for _, v in want], abs=1e-8)


def test_no_vectors_returns_hits_as_they_are(spark):
    schema = "query_id int, rank int, id string, score double, vector array<double>, query_vector array<double>"
    df = spark.createDataFrame([(1, i, f"h{i}", 1.0 / i, None, [1.0]) for i in range(1, 6)], schema)
    for out in (rerank_mmr(df, top_k=3), rerank_diversity(df, top_k=3)):
        rows = out.orderBy("mmr_rank").collect()
        assert [(r.id, r.mmr_score, r.original_score, r.mmr_rank) for r in rows] == [
            (f"h{i}", 1.0 / i, 1.0 / i, i) for i in (1, 2, 3)
        ]


def test_known_numbers(spark):
    """Two points of 1536 values: one all 0.1, one rising from 0.1 by 0.01."""
    flat, rising = [0.1] * 1536, [0.1 + i * 0.01 for i in range(1536)]
    rows = [(1, 1, "q1", cos(flat, flat), flat, flat), (1, 2, "q2", cos(flat, rising), rising, flat)]
    schema = "query_id int, rank int, id string, score double, vector array<double>, query_vector array<double>"
    out = rerank_mmr(spark.createDataFrame(rows, schema), top_k=2, lambda_=0.5, fetch_k=10).orderBy("mmr_rank").collect()
    assert [(r.id, round(r.mmr_score, 9), round(r.original_score, 9)) for r in out] == [
        ("q1", 0.5, 1.0), ("q2", 0.0, 0.868666737)
    ]


def test_unequal_lengths_fail(spark):
    schema = "query_id int, rank int, id string, score double, vector array<double>, query_vector array<double>"
    df = spark.createDataFrame([(1, 1, "a", 1.0, [1.0], [1.0]), (1, 2, "b", 1.0, [1.0, 2.0], [1.0])], schema)
    with pytest.raises(Exception, match="same length"):
        rerank_mmr(df, top_k=2).collect()
