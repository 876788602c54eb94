"""Hot keys of the suffix-array dedup: passages that very many documents share."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from nearfield.llm import suffixes


def plain(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[a : a + length] for _, t in texts for a in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for a in range(len(t) - length + 1):
            if seen[t[a : a + length]] > 1:
                gone[a : a + length] = b"\1" * length
        spans = sum(1 for k, x in enumerate(gone) if x and (not k or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, x in zip(t, gone) if not x)).hexdigest()))
    return sorted(out)


def made(seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(90), prose(6) + "\n"
    rows = [(i, prose(draw.randint(0, 30)) + passage + prose(draw.randint(0, 30))) for i in range(40)]
    rows += [(100 + i, passage[draw.randint(0, 40) : -draw.randint(1, 40)] + prose(10)) for i in range(15)]
    rows += [(200, line * 60), (201, line * 7 + prose(40)), (202, None), (203, "x"), (204, rows[0][1]), (205, rows[0][1]), (206, prose(200))]
    return rows


@pytest.mark.parametrize("hot", [3, 12, 20_000])
def test_remove_repeats_with_hot_keys(spark, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 64)
    rows = made(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffixes.remove_repeats(docs, 100, hot=hot, shard_bytes=4000).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 100)


def test_permuted_common_prefixes():
    draw = random.Random(2)
    text = np.frombuffer(bytes(draw.choice(b"ab") for _ in range(500)), np.uint8)
    data = text.tobytes()
    sa = np.array(sorted(range(len(text)), key=lambda i: data[i:]))
    before, prefix = suffixes.permuted_common_prefixes(text, sa, 12)
    for x, y in zip(sa, sa[1:]):
        a, b = data[x : x + 12], data[y : y + 12]
        want = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert before[y] == x and prefix[y] == want
    assert before[sa[0]] == -1 and prefix[sa[0]] == 0
