"""The Jaccard self-join against all pairs on small data."""

from __future__ import annotations

import random

import numpy as np
import pytest

from nearfield.llm import jaccard_join


def shingle_set(text: str | None, words: int = 3) -> frozenset:
    found = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x0b", " ").split() if w]
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))) if found else frozenset()


def plain(rows, percent=90):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least: dict = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(s), least.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets))), key=str)


def run(spark, rows, **options):
    found = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **options)
    return sorted((tuple(r) for r in found.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def edited(words: list[str], edits: int, draw: random.Random) -> list[str]:
    words = list(words)
    for _ in range(edits):
        at = draw.randrange(len(words))
        words[at : at + 1] = draw.choice([["new%d" % draw.randrange(10**6)], [], [words[at], "extra"]])
    return words


def made(seed: int, bases: int, copies: int, most_edits: int, sizes=(5, 150)):
    draw = random.Random(seed)
    rows = []
    for _ in range(bases):
        base = [f"w{draw.randrange(3000)}" for _ in range(draw.randint(*sizes))]
        rows += [" ".join(edited(base, draw.randint(0, most_edits), draw)) for _ in range(copies)]
    draw.shuffle(rows)
    return list(enumerate(rows))


def test_groups_of_near_copies(spark):
    rows = made(1, 25, 6, 5)
    assert run(spark, rows) == plain(rows)


def test_one_large_group_whose_members_mostly_do_not_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 4)
    rows = made(2, 1, 120, 9, (100, 100)) + [(1000 + i, t) for i, t in made(3, 10, 3, 3)]
    assert run(spark, rows) == plain(rows)


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 1)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "SIDE", 5)
    rows = made(4, 2, 40, 4, (40, 60))
    assert run(spark, rows) == plain(rows)


def test_nulls_empty_repeated_and_short_texts(spark):
    rows = [(1, None), (2, ""), (3, " \t "), (4, "One"), (9, "one"), (5, "one two"), (6, "a b c a b c a b c"), (6, "a b c a"), (None, "one two"), (None, "lone text")]
    rows += [(7, "É à ü"), (8, "é à ü"), (10, "x " * 5000), (11, "x " * 4000), (3, "one two")]
    assert run(spark, rows) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a")]])
def test_small_tables(spark, rows):
    assert run(spark, rows) == plain(rows)


def test_extra_columns(spark):
    table = spark.createDataFrame([(1, "a b c d", 3, "x")], "doc_id int, text string, row int, node string")
    assert [tuple(r) for r in jaccard_join.components(table).collect()] == [(1, 2, 1)]


def sets_that_link(draw, size, percent):
    """Two sets whose similarity is just enough."""
    k = jaccard_join.difference(2 * size, percent)
    gone, new = k // 2, draw.randint(0, k - k // 2)
    a = np.array([draw.getrandbits(64) for _ in range(size)], np.uint64)
    b = np.concatenate([a[gone:], np.array([draw.getrandbits(64) for _ in range(new)], np.uint64)])
    return np.unique(a), np.unique(b)


@pytest.mark.parametrize("percent", [90, 80, 60])
def test_sets_that_link_share_a_signature_and_a_prefix(percent):
    draw = random.Random(percent)
    tried = 0
    for size in [*range(1, 60), *range(60, 1500, 97)] * 3:
        a, b = sets_that_link(draw, size, percent)
        if not jaccard_join.similar(a, b, percent) or len(a) == len(b) == len(np.intersect1d(a, b)):
            continue
        tried += 1
        assert len(np.intersect1d(jaccard_join.signatures(a, percent), jaccard_join.signatures(b, percent)))
        keys = [{(tag, x) for tag, n in jaccard_join.prefixes(len(s), percent) for x in s[:n].tolist()} for s in (a, b)]
        assert keys[0] & keys[1]
    assert tried > 50


def test_similarity_at_the_border():
    ten = np.arange(10, dtype=np.uint64)
    assert jaccard_join.similar(ten, ten[:9]) and not jaccard_join.similar(ten, ten[:8]) and not jaccard_join.similar(ten[:0], ten[:0])


def test_one_set_against_many():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 60, (40, 30))
    sets = [np.unique(row).astype(np.uint64) for row in base] + [np.unique(base[0]).astype(np.uint64)]
    index = jaccard_join.Overlaps(sets)
    for percent in (20, 50, 90):
        for one in [*sets, np.arange(1000, 1010, dtype=np.uint64)]:
            assert index.similar(one, percent).tolist() == [i for i, s in enumerate(sets) if jaccard_join.similar(s, one, percent)]


@pytest.mark.parametrize("percent", [90, 60])
def test_marks_allow_all_links(percent):
    draw = random.Random(percent)
    for size in [*range(1, 60), *range(60, 1500, 97)]:
        a, b = sets_that_link(draw, size, percent)
        if jaccard_join.similar(a, b, percent):
            marks = [np.frombuffer(jaccard_join.mark(x), np.uint64) for x in (a, b)]
            assert np.bitwise_count(marks[0] ^ marks[1]).sum() <= jaccard_join.difference(len(a) + len(b), percent)


def test_sets_are_sent_only_where_marks_allow_a_link(spark, monkeypatch):
    """Of pairs that share a signature but mostly fail the threshold few get to see each other's sets."""
    draw, seen, stored = random.Random(5), {}, jaccard_join.stored

    def counted(df, name):
        out = stored(df, name)
        seen.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "stored", counted)
    hot = [f"w{draw.randint(0, 5000)}" for _ in range(400)]
    texts = [" ".join(f"x{draw.randint(0, 5000)}" if draw.random() < 0.03 else w for w in hot) for _ in range(40)]
    texts += [" ".join([*hot[:-1], f"y{n}"]) for n in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 3]) for i in range(398)} for t in texts]
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    assert {r.doc_id: r.component_id for r in jaccard_join.components(docs).collect()} == dict(enumerate(root))
    assert sum(seen["pairs"]) > 20 and sum(seen["maybe-linked"]) < sum(seen["pairs"]) / 2


def test_only_sets_with_a_likely_partner_are_sent(spark, monkeypatch):
    """Sets of nodes that share keys but have no likely partner stay where they are, in pairs as in blocks."""
    draw, sent, with_sets = random.Random(6), [], jaccard_join._with_sets

    def counted(rows, sets, node):
        out = with_sets(rows, sets, node)
        sent.append((out.count(), sets.count()))
        return out

    monkeypatch.setattr(jaccard_join, "_with_sets", counted)
    monkeypatch.setattr(jaccard_join, "SMALL", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    hot = [f"w{draw.randint(0, 5000)}" for _ in range(400)]
    texts = [" ".join(f"x{draw.randint(0, 5000)}" if draw.random() < 0.03 else w for w in hot) for _ in range(60)]
    texts += [" ".join([*hot[:-1], f"y{n}"]) for n in range(3)]
    rows = list(enumerate(texts))
    assert run(spark, rows) == plain(rows)
    assert sent and all(found < sets / 2 for found, sets in sent)


def test_asked_nodes_have_a_partner_of_another_root(spark, monkeypatch):
    """Marks drop no node of a block that links with one of another root, and those that surely don't."""
    monkeypatch.setattr(jaccard_join, "AT_ONCE", 3)
    draw = random.Random(7)
    found = {node: np.unique(np.array([draw.getrandbits(64) for _ in range(200)], np.uint64)) for node in range(20)}
    for node in range(5):
        found[100 + node] = np.unique(np.r_[found[node][3:], np.uint64(node)])
    sets = spark.createDataFrame([(n, len(f), jaccard_join.mark(f), jaccard_join.mark(f, jaccard_join.SHORT)) for n, f in found.items()], "node long, n long, mark binary, short binary")
    roots = {n: 104 if n == 4 else n for n in found}
    dealt = [(1, 0, 0, asks, n, roots[n]) for n in found for asks in ((True, False) if n < 100 else (False,))]
    dealt = spark.createDataFrame(dealt, "key long, a int, b int, asks boolean, node long, root long").repartition(3)
    for kind in ("short", "mark"):
        got = sorted((r.asks, r.node) for r in jaccard_join._asked(dealt, sets, kind, 90).collect())
        assert got == [(False, 100), (False, 101), (False, 102), (False, 103), (True, 0), (True, 1), (True, 2), (True, 3)]


def test_repeated_rows_leave_one_set(spark, monkeypatch):
    rows = made(8, 6, 3, 2) * 2 + [(None, "a b c d e f g h i j k l m n")] * 3
    for few in (0, 1):
        monkeypatch.setattr(jaccard_join, "FEW", few)
        texts = jaccard_join.stored(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "xxhash64(text) hash").repartition(3), "t")
        sets = jaccard_join._sets(texts, jaccard_join.stored(texts.select("doc_id", "hash").distinct(), "w"), 3)
        assert sorted(r.node for r in sets.select("node").collect()) == sorted({jaccard_join._node(jaccard_join.shingles(t, 3)) for _, t in rows})
