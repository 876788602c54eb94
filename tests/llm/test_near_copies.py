"""Near copies against all pairs of five-word shingle sets in plain Python."""

import itertools
import random

import pytest

import corpus_pipeline
from nearfield.llm import near_copies


def plain_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """Places of the rows that stay."""
    found, root = [plain_set(t) for _, t in rows], list(range(len(rows)))
    pairs = 0
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(found[a] & found[b])
        if found[a] == found[b] or both and both >= 0.8 * len(found[a] | found[b]) - 1e-9:
            pairs += 1
            x, y = root[a], root[b]
            if x != y:
                root = [x if r == y else r for r in root]
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, []).append(i)
    least = [min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0)) for g in groups.values()]
    return least, pairs


def changed(draw, words, share):
    return [draw.choice(VOCABULARY) if draw.random() < share else w for w in words]


VOCABULARY = [f"w{i}" for i in range(3000)]


@pytest.fixture(scope="module")
def rows():
    draw, out = random.Random(8), [(None, None), (5, ""), (6, "One two"), (7, "one  TWO")]
    for n in range(60):
        words = [draw.choice(VOCABULARY) for _ in range(draw.randint(100, 400))]
        out.append((1000 + 10 * n, " ".join(words)))
        for k, share in enumerate((0.005, 0.01, 0.015, 0.02, 0.03)):
            out.append((1000 + 10 * n + 1 + k, " ".join(changed(draw, words, share))))
    hot = [draw.choice(VOCABULARY) for _ in range(200)]
    out += [(3000 + i, " ".join(changed(draw, hot, draw.choice((0.005, 0.02))))) for i in range(80)]
    return out


@pytest.mark.parametrize(("block", "stars"), [(512, 3), (8, 0)])
def test_stage_agrees_with_all_pairs(spark, rows, monkeypatch, block, stars):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(near_copies, "SIDE", block)
    monkeypatch.setattr(near_copies, "STARS", stars)
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, row int").repartition(3)
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert left.columns == docs.columns
    want, pairs = plain_kept(rows)
    assert pairs > 500
    assert sorted(r.row for r in left.collect() if r.doc_id not in (6, 7)) == sorted(i for i in want if rows[i][0] not in (6, 7))
    assert left.where("doc_id = 6").count() == 1 and left.where("doc_id = 7").count() == 0


def test_rows_not_ids_are_removed(spark):
    """Ids that stand twice or are null: one row of each group stays, and no other text goes."""
    draw = random.Random(9)
    one, two, three = ([draw.choice(VOCABULARY) for _ in range(200)] for _ in range(3))
    near = lambda words: " ".join([*words[:-1], "end"])
    rows = [(1, " ".join(one)), (2, near(one)), (2, " ".join(two)), (3, " ".join(three)), (3, near(three)), (None, near(two)), (None, near(["x", *three]))]
    left = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in left) == [1, 2, 3]
    assert " ".join(two) in {r.text for r in left}
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert corpus_pipeline.drop_near_copies(spark, nothing, "").count() == 0


def test_covering_simhash_gives_candidates(spark, rows):
    """Pairs whose fingerprints differ in four bits or less are linked by the covering tables alone, others are not."""
    from pyspark.sql import functions as F

    from nearfield.llm import shared, simhash
    from nearfield.session import stored

    docs = stored(spark.createDataFrame([(n, i, t) for n, (i, t) in enumerate(rows[:124])], "row long, doc_id long, text string"), "docs")
    marks = stored(near_copies.sketches(docs), "marks")
    nodes = stored(marks.groupBy("node").agg(F.min("row").alias("row"), F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig"), F.min("fp").alias("fp")), "nodes")
    pairs, found = near_copies.covered(nodes, docs)
    fps = {r.node: (r.fp, rows[r.row][1]) for r in nodes.collect()}
    assert all(fp & (2**64 - 1) == simhash.fingerprint(t, 5) for fp, t in fps.values())
    root = {r.node: r.root for r in shared.components(pairs).collect()}
    close = [(a, b) for a, b in itertools.combinations(fps, 2) if ((fps[a][0] ^ fps[b][0]) & (2**64 - 1)).bit_count() <= 4]
    assert len(close) > 10 and all(root[a] == root[b] for a, b in close)
    assert found.count() > 5
    for r in found.collect():
        a, b = (plain_set(fps[n][1]) for n in (r.a, r.b))
        assert len(a & b) >= 0.8 * len(a | b) - 1e-9


def test_no_rows_for_pairs_of_a_large_group(spark, monkeypatch):
    """Many texts that share keys but mostly fail the threshold: rows grow with the texts, not with their pairs."""
    draw, sizes, stored = random.Random(11), [], near_copies.stored

    def counted(df, name):
        out = stored(df, name)
        sizes.append((out.count(), name))
        return out

    monkeypatch.setattr(near_copies, "stored", counted)
    hot = [draw.choice(VOCABULARY) for _ in range(150)]
    rows = [(i, " ".join(changed(draw, hot, draw.choice((0.01, 0.025, 0.03))))) for i in range(300)]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, row int").repartition(3)
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    want, _ = plain_kept(rows)
    assert 30 < len(want) < 270
    assert sorted(r.row for r in left.collect()) == sorted(want)
    assert max(n for n, name in sizes if "pairs" in name or "links" in name) < 10 * len(rows)
