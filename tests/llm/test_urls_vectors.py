"""Host reputation and nearest neighbours."""

import random

import numpy as np
import pytest

from nearfield.llm import neighbours, reputation

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "b.example.org", ""))


def test_urls(spark):
    urls = [
        ("http://WWW.Example.ORG/es/x?q=1", "www.example.org", "/es/x", "example.org/es/", "block"),
        ("http://example.org/en", "example.org", "/en", "org/", "allow"),
        ("http://b.example.org/en", "b.example.org", "/en", "b.example.org", "block"),
        ("http://xexample.org/es/", "xexample.org", "/es/", "org/", "allow"),
        ("http://a.net", "a.net", "", None, "allow"),
        ("x://É.net#a/b", "É.net", "", None, "allow"),
        ("x://a.net?u=http://b.org/", "a.net", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
    ]
    bad = [("http://bad.spam.com/" + str(i), "bad.spam.com", f"/{i}", None, "block") for i in range(60)]
    rows = [(i, *u) for i, u in enumerate(urls + bad)]
    pages = spark.createDataFrame([(r[0], r[1], 1, 2) for r in rows] + [(None, None, 1, 2)], "page_id long, url string, host int, n int").repartition(3)
    known = [(i, i >= len(urls)) for i in range(len(rows))]
    outcomes = spark.createDataFrame([*known, (None, True), (3, None), (10_000, True)], "page_id long, bad boolean")
    got = {r.page_id: tuple(r)[1:5] for r in reputation.judge(pages, outcomes, RULES).collect()}
    assert got == {r[0]: r[2:] for r in rows} | {None: ("", "", None, "allow")}
    assert reputation.judge(pages.limit(0), outcomes, RULES).count() == 0
    assert {r.verdict for r in reputation.judge(pages, outcomes.limit(0), ()).collect()} == {"allow"}


def test_shrinkage_follows_the_counts(spark):
    """A host of one bad page is held by its good domain; one with many bad pages is not."""
    hosts = [("x.good.com", 1, 1, 1), ("y.good.com", 200, 200, 2), ("z.other.com", 200, 200, 190), ("w.co.uk", 5, 0, 0), ("1.2.3.4", 5, 0, 0)]
    table = spark.createDataFrame(hosts, "host string, pages long, n long, bad long")
    got = {r.host: r for r in reputation.reputations(table, 0.3, 1.645).collect()}
    assert got["x.good.com"].by_host == "allow" and got["z.other.com"].by_host == "block"
    assert got["y.good.com"].rate < got["x.good.com"].rate < 0.9
    assert all(r.bound <= r.rate for r in got.values())


@pytest.fixture(scope="module")
def vectors():
    random_ = np.random.default_rng(3)
    centres = random_.normal(size=(12, 16))
    return (centres[random_.integers(0, 12, 3000)] + 0.4 * random_.normal(size=(3000, 16))).astype(np.float32)


def plain(data, q, k=10):
    x = np.array([v for _, v in data], float)
    ids = np.array([i for i, _ in data])
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    keep = ids != ids[q]
    order = np.lexsort((ids[keep], d[keep]))[:k]
    return list(zip(ids[keep][order].tolist(), d[keep][order].tolist()))


def test_recall(spark, vectors):
    data = list(enumerate(vectors.tolist()))
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in neighbours.search(table, lambda i: i % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    assert set(got) == set(range(0, 3000, 100))
    hits = 0
    for q, found in got.items():
        assert [r for *_, r in found] == list(range(1, 11))
        want = plain(data, q)
        hits += len({i for i, _ in want} & {i for i, *_ in found})
        exact = {i: float(np.sqrt(((vectors[i].astype(float) - vectors[q].astype(float)) ** 2).sum())) for i, *_ in found}
        assert all(abs(exact[i] - s) < 1e-12 for i, s, _ in found)
    assert hits >= 0.9 * 10 * len(got)


def test_ties_bad_rows_and_hot_vectors(spark, vectors, monkeypatch):
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 64)  # lists are split
    rows = [(i, vectors[i].tolist()) for i in range(300)]
    rows += [(1000 + i, vectors[0].tolist()) for i in range(150)]  # a third of all is one vector
    good = list(rows)
    rows += [(400, None), (500, [0.0] * 16), (600, [float("nan")] * 16), (700, [None] * 16), (800, [1.0]), (None, [1.0] * 16), (900, [float("inf")] * 16), (901, [])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, list int").repartition(3)
    got = {}
    for r in neighbours.search(table, lambda i: i % 100 == 0, recall=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == {0, 100, 200, 1000, 1100}
    for q in (0, 1000, 1100):
        want = [i for i, _ in plain(good, [i for i, _ in good].index(q))]
        assert got[q] == want
    assert neighbours.search(table.limit(0), lambda i: i % 100 == 0).count() == 0
    few = neighbours.search(table.where("vec_id in (0, 1, 2)"), lambda i: i == 0).collect()
    assert len(few) == 2


@pytest.mark.parametrize("copies", [1, 40])
def test_an_id_with_many_rows_is_one_candidate(spark, vectors, monkeypatch, copies):
    """Id 7 stands in 40 rows beside query 0, equal or not; it must not crowd out the others, nor fill one group."""
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 64)
    near = [(vectors[0] + np.float32(1e-4) * (i % (41 - copies))).tolist() for i in range(1, 41)]
    rows = [(i, vectors[i].tolist()) for i in range(300) if i != 7] + [(7, v) for v in near]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in neighbours.search(table, lambda i: i % 100 == 0, recall=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q in (0, 100, 200):
        least = {}
        for i, v in rows:
            if i != q:
                d = ((np.array(v) - vectors[q].astype(float)) ** 2).sum()
                least[i] = min(d, least.get(i, d))
        assert got[q] == sorted(least, key=lambda i: (least[i], i))[:10]


def test_limit_of_a_block_is_over_ids(vectors):
    x = vectors[:100].astype(float)
    ids = np.array([7] * 50 + list(range(100, 150)))
    x[:50] = x[0] + 1e-6 * np.arange(50)[:, None]
    _, c, _ = neighbours._best(np.array([0]), x[:1], ids, x, 10)
    d = ((x - x[0]) ** 2).sum(axis=1)
    assert c.tolist() == [7, *(100 + np.argsort(d[50:], kind="stable")[:9]).tolist()]


def test_graph_finds_the_nearest(vectors):
    graph = neighbours.Graph(neighbours.balanced_centroids(vectors, 200))
    ids, distance = graph.nearest(vectors[:200], 8)
    d = np.sqrt(((vectors[:200, None].astype(float) - graph.centroids[None]) ** 2).sum(axis=2))
    want = np.sort(d, axis=1)[:, :8]
    assert np.mean(np.isclose(distance, want, atol=1e-3)) > 0.95
    sizes = [len(p) for p in np.array_split(vectors, 200)]
    assert max(sizes) <= 2 * min(sizes)


def test_registered_domains_by_a_table_of_suffixes(spark):
    rules = spark.createDataFrame([(s,) for s in ("com", "co.uk", "*.ck", "!www.ck", "github.io", "b.c.example")], "suffix string")
    want = {
        "a.b.com": ("b.com", "com"), "com": ("com", "com"), "x.co.uk": ("x.co.uk", "co.uk"), "y.x.co.uk": ("x.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"),
        "a.b.foo.ck": ("b.foo.ck", "foo.ck"), "www.ck": ("www.ck", "ck"), "z.www.ck": ("www.ck", "ck"), "me.github.io": ("me.github.io", "github.io"),
        "a.unknown.zz": ("unknown.zz", "zz"), "a.b.c.example": ("a.b.c.example", "b.c.example"), "127.0.0.1": ("127.0.0.1", "1"), "": ("", ""), "u@m.x.com:80": ("x.com", "com"),
    }
    hosts = spark.createDataFrame([(h, 1) for h in want], "host string, pages int")
    got = {r.host: (r.domain, r.suffix) for r in reputation.registered(hosts, rules).collect()}
    assert got == want
    short = {r.host: (r.domain, r.suffix) for r in reputation.registered(hosts).collect()}
    assert short["y.x.co.uk"] == ("x.co.uk", "co.uk") and short["me.github.io"] == ("github.io", "io")
    assert reputation.registered(hosts, rules.limit(0)).count() == len(want)
