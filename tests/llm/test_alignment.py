"""Alignment of two tokenizers against a plain restatement of the rules."""

from __future__ import annotations

import collections
import hashlib

import public_tokenizers as public
import pytest

from nearfield.llm import alignment

A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


def plain(docs: list[tuple[int | None, str | None]]) -> list[tuple]:
    """Whole texts encoded at once, overlaps by positions of single bytes."""
    tok = alignment.Tokenizers(A, B)
    found, counts = [], collections.Counter()
    for doc, text in docs:
        a = tok.a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = tok.b.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if not text or b"".join(tok.a_bytes[i] for i in a) != want or b"".join(tok.b_bytes[i] for i in b) != want:
            found.append((doc, [], [], [], []))
            continue
        of_a, of_b = [[k for k, i in enumerate(ids) for _ in names[i]] for ids, names in ((a, tok.a_bytes), (b, tok.b_bytes))]
        links = [(a[x], b[y]) for x, y in sorted(set(zip(of_a, of_b)))]
        groups, i, j = [], 0, 0
        for at in range(1, len(want) + 1):
            if at == len(want) or (of_a[at] != of_a[at - 1] and of_b[at] != of_b[at - 1]):
                x, y = of_a[at - 1] + 1, of_b[at - 1] + 1
                groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
                i, j = x, y
        counts.update(links)
        found.append((doc, a, b, groups, links))
    most: dict[int, int] = {}
    for (_, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    return [
        (
            doc, len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "",
        )
        for doc, a, b, groups, links in found
    ]


def run(spark, docs) -> list[tuple]:
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return [tuple(r) for r in alignment.align(table, A, B).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r))


ODD = [
    None, "", " ", "  two blanks  inside ", "line\nbreak\ttab \n x", "<|endoftext|> and <s> </s> <unk>", "▁literal ▁ piece", "nul\x00byte",
    "don't you'll 1234 56,789.0 a+b", "été à la française œuvre", "中文 日本語 \U0001f600 emoji", "é combining ́x",
    "x" * 3000, "word " * 500, "no break   em", "'s 't ' ''", "ǅ ẞ ﬁ ſ", "﻿bom", "a ́b", "tail ",
]


def test_odd_texts_and_repeated_rows(spark):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, "a null id"), (None, "a null id")]
    assert ordered(run(spark, docs)) == ordered(plain(docs))


def test_documents_of_the_smallest_data(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_CHARS", 20_000)
    monkeypatch.setattr(alignment, "KNOWN_CHARS", 5_000)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    docs = [tuple(r) for r in rows]
    assert ordered(run(spark, docs)) == ordered(plain(docs))


def test_units_are_tokenised_as_in_the_whole_text():
    tok = alignment.Tokenizers(A, B)
    for text in [t for t in ODD if t]:
        cut = alignment.units(text)
        assert " ".join(cut) == text
        parts = [tok.encode(unit) for unit in cut]
        whole = tok.encode(text)
        assert [x for a, _ in parts for x in a.tolist()] == whole[0].tolist()
        assert [x for _, b in parts for x in b.tolist()] == whole[1].tolist()


def test_identity_map_has_the_same_bytes():
    tok = alignment.Tokenizers(A, B)
    pairs = [(i, j) for i, j in enumerate(tok.identity.tolist()) if j >= 0]
    assert len(pairs) > 10_000 and all(tok.a_bytes[i] == tok.b_bytes[j] for i, j in pairs)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "")]])
def test_tables_without_tokens(spark, rows):
    assert run(spark, rows) == [(1, 0, 0, 0, 0, 0, 0, "")] * len(rows)


def test_extra_columns(spark):
    table = spark.createDataFrame([(1, "some text", 2, 3, "x")], "doc_id int, text string, slice int, n_a int, codes string")
    assert [tuple(r)[:2] for r in alignment.align(table, A, B).collect()] == [(1, plain([(1, "some text")])[0][1])]
