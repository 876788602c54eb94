"""Codes of vectors against a plain restatement with Python integers."""

from __future__ import annotations

import hashlib
import math
import random

import pytest

from nearfield.llm import vector_codes

SCHEMA = "vec_id long, label int, embedding array<float>"


def plain(rows, parts=16, entries=64, rounds=2):
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    ids: dict = {}
    for i, _, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v):
            ids[i] = min(v, ids.get(i, v))
    start = [[math.floor(256 * x) for x in ids[i]] for i in sorted(ids, key=lambda i: (i is None, i or 0))[:entries]]
    kept = [k for k in kept if len(k[2]) == len(start[0])]
    width = len(start[0]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[list(cut(v, p)) for v in start] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own: dict = {}
            for _, _, v in kept:
                own.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, some in own.items():
                books[p][k] = [sum(x) // len(some) for x in zip(*some)]
    out, errors = [], {}
    for i, label, v in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        errors[label] = errors.get(label, 0) + error
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), error))
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, code, error, errors[label], digest) for i, label, code, error in out), key=str)


def run(spark, rows, **options):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = vector_codes.encode(table, **options).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return sorted((tuple(r) for r in found.collect()), key=str)


def made(n, length, seed, spread=1.0):
    draw = random.Random(seed)
    # Multiples of 1/512 are the same as floats and doubles; many sit right on a border of floor.
    return [(i, draw.choice([None, 0, 1]), [draw.randint(-512, 512) / 512 * spread for _ in range(length)]) for i in range(n)]


def test_all_codes_and_errors(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "SLICE_ROWS", 37)
    rows = made(200, 32, 1)
    assert run(spark, rows) == plain(rows)


def test_nulls_copies_ties_and_repeated_ids(spark):
    rows = made(70, 16, 2, 1 / 64)
    rows += [(5, None, rows[9][2]), (None, 1, rows[3][2]), (None, None, [0.0] * 16), rows[0], rows[0]]
    rows += [(200 + k, 3, rows[1][2]) for k in range(60)]  # one vector again and again
    rows += [(-3, 0, None), (-4, 0, [math.nan] + [0.0] * 15), (-5, 0, [None] * 16), (-6, 0, [math.inf] * 16), (-7, 0, []), (300, 0, [1.0] * 32)]
    assert run(spark, rows) == plain(rows)


def test_fewer_vectors_than_entries_and_large_numbers(spark):
    rows = [(1, 0, [1000.5] * 16), (2, 0, [-1000.5] * 16), (3, None, [0.0] * 16)]
    assert run(spark, rows) == plain(rows)
    assert len(run(spark, [(1, 0, [3.0e38] * 16), (2, 0, [-3.0e38] * 16)])) == 2


@pytest.mark.parametrize("rows", [[], [(1, 0, None)], [(1, 0, [math.nan])]])
def test_tables_without_vectors(spark, rows):
    assert run(spark, rows) == []


def test_a_length_that_parts_do_not_divide(spark):
    with pytest.raises(ValueError):
        run(spark, [(1, 0, [1.0] * 17)])


def test_extra_columns_with_clashing_names(spark):
    table = spark.createDataFrame([(1, 0, [0.5] * 16, 7, "x")], SCHEMA + ", error long, key string")
    assert [r.error for r in vector_codes.encode(table).collect()] == [0]
