"""Exact deduplication, mixing and what they share, against plain Python."""

import hashlib
import math
from collections import Counter, defaultdict

import pytest

from nearfield.llm import exact_dedup, mixing, shared

ODD = [
    (1, "a", "s", 1), (2, "a", "s", 1), (3, "", None, 1), (4, None, "t", 1), (5, "a ", "s", None), (5, "a ", "s", None),
    (None, "a", "s", 2), (None, "lonely", None, 2), (None, "lonely", None, 2), (6, "b" * 200_000, "t", 3), (7, "é\n x", "t", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    # The last columns bear names that the operators use themselves.
    rows = [(i, t, None, s, None, n, "x", "y") for i, t, s, n in ODD * 1]
    rows += [(100 + i, "hot", None, "s", None, 0, "x", "y") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, sha string, key string").repartition(3)


def test_dedup(odd):
    rows = odd.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    got = exact_dedup.dedup(odd).collect()
    assert len(got) == len(rows)
    kept = Counter()
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(groups[text])
        assert r.keep_id == max((i for i in groups[text] if i is not None), default=None)
        kept[text] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert all(kept[t] == 1 for t in groups)


def test_deduplicated(odd):
    got = exact_dedup.deduplicated(odd)
    assert got.columns == odd.columns
    assert sorted((r.text or "") for r in got.collect()) == sorted({(r.text or "") for r in odd.collect()})
    assert exact_dedup.deduplicated(odd.limit(0)).count() == 0
    assert exact_dedup.dedup(odd.limit(0)).count() == 0


def _mix(rows):
    size = [len((t or "").encode().split()) for _, t, _ in rows]
    by = Counter()
    for n, (_, _, s) in zip(size, rows):
        by[s] += n
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    target, left, open_ = {}, float(sum(by.values())), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * by[s] < level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 3.0 * by[s] for s in full}
        left, open_ = left - sum(3 * by[s] for s in full), open_ - full
    return size, by, target


def test_mix(odd, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 7)  # several slices even here
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    size, by, target = _mix(rows)
    got = mixing.mix(odd).collect()
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(i), n) for (i, _, _), n in zip(rows, size))
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    totals = Counter()
    for r in got:
        totals[r.source_size, round(r.target, 6)] += r.taken
    want = Counter()
    for s, t in target.items():
        want[by[s], round(t, 6)] += math.floor(t + 0.5)
    assert totals == want
    assert sorted(map(repr, mixing.mix(odd).collect())) == sorted(map(repr, got))


def test_mixed(odd):
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    size, by, target = _mix(rows)
    got = mixing.mixed(odd)
    assert got.columns == odd.columns
    words, biggest = Counter(), Counter()
    for r in got.collect():
        words[r.source] += len((r.text or "").encode().split())
    for n, (_, _, s) in zip(size, rows):
        biggest[s] = max(biggest[s], n)
    assert all(abs(words[s] - target[s]) <= biggest[s] / 2 + 1 for s in target)
    assert mixing.mixed(odd.limit(0)).count() == 0 and mixing.mix(odd.limit(0)).count() == 0


def test_attach_and_filter(spark, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 3)
    rows = spark.createDataFrame([(i % 7 if i % 2 else 0, i) for i in range(4000)], "key long, value long")
    groups = rows.groupBy("key").count().withColumnRenamed("count", "size").selectExpr("key", "size", "key * 10 as ten")
    got = shared.attach(rows, groups, "key", "size", 4000)
    assert got.count() == 4000 and got.where("ten <> key * 10").count() == 0
    gone = spark.createDataFrame([(3,), (5,)], "value long")
    left = {r.value for r in shared.without(rows, gone, "value").collect()}
    assert left == set(range(4000)) - {3, 5}


def test_components(spark, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 3)
    pairs = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 201), (200, 201), (5, 5), (129, 300)]
    root = {n: n for p in pairs for n in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in shared.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0
