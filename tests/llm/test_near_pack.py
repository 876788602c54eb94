"""SimHash groups and packing against plain Python."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from nearfield.llm import packing, simhash

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_fingerprint(text, words):
    found = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not found:
        return 0
    parts = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(marks, radius):
    """Component of each fingerprint by smallest place."""
    root = list(range(len(marks)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(marks)), 2):
        if (marks[a] ^ marks[b]).bit_count() <= radius:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(marks))]


@pytest.mark.parametrize("radius", [1, 4])
def test_masks_cover(radius):
    kept = [m & (2**64 - 1) for m in simhash.masks(radius, 3)]
    assert len(kept) == 2 ** (radius + 1) - 1
    draw = random.Random(1)
    for _ in range(500):
        differ = sum(1 << b for b in draw.sample(range(64), radius))
        assert any(differ & m == 0 for m in kept)


def test_fingerprint():
    for text in (None, "", " \n", "One", "A b\tC  d", "é À b c d e", "x y z " * 50):
        assert simhash.fingerprint(text, 4) == plain_fingerprint(text, 4)


def test_links_survive_bucket_splits(spark, monkeypatch):
    """Many fingerprints that agree in most tables: buckets above the limit are split without losing a link."""
    monkeypatch.setattr(simhash, "BUCKET", 8)
    draw = random.Random(2)
    base = draw.getrandbits(64)
    marks = list({base ^ sum(1 << b for b in draw.sample(range(24), draw.randint(0, 9))) for _ in range(150)})
    marks += [draw.getrandbits(64) for _ in range(30)]
    nodes = spark.createDataFrame([(i, int(np.uint64(m).astype(np.int64))) for i, m in enumerate(marks)], "node long, fp long")
    from nearfield.llm import shared

    got = {r.node: r.root for r in shared.components(simhash.links(nodes, 4)).collect()}
    want = plain_groups(marks, 4)
    assert [got.get(i, i) for i in range(len(marks))] == want


def test_groups(spark):
    draw = random.Random(3)
    base = [" ".join(draw.choice("abcdefgh") * draw.randint(1, 3) for _ in range(60)) for _ in range(6)]
    texts = [None, "", " ", "one", "ONE"] + base + [b + " tail" for b in base] + [base[0]] * 5
    ids = [*range(10, 10 + len(texts) - 1), None]
    docs = spark.createDataFrame([(i, t, 1, "n") for i, t in zip(ids, texts)], "doc_id long, text string, fp int, node string").repartition(3)
    marks = [plain_fingerprint(t, 4) for t in texts]
    roots = plain_groups(marks, 4)
    least = defaultdict(lambda: 10**9)
    for r, i in zip(roots, ids):
        if i is not None:
            least[r] = min(least[r], i)
    got = Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_groups(docs, 4, 4).collect())
    assert got == Counter((i, m, least[r]) for i, m, r in zip(ids, marks, roots))
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_an_id_that_stands_with_several_texts_joins_nothing(spark):
    draw = random.Random(4)
    a, b = (" ".join(draw.choice("abcdefgh") * draw.randint(1, 3) for _ in range(80)) for _ in range(2))
    rows = [(3, a), (5, a + " tail"), (5, b), (9, b), (None, b), (7, b + " tail")]
    marks = [plain_fingerprint(t, 4) for _, t in rows]
    near = [(marks[i] ^ marks[j]).bit_count() <= 4 for i, j in ((0, 1), (0, 2), (2, 5))]
    assert near == [True, False, True]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_groups(docs, 4, 4).collect())
    assert got == Counter((i, m, 3 if t.startswith(a) else 5) for (i, t), m in zip(rows, marks))


WORDS = ["", None, "A b  c\t\td\x1ce", "it's 12 <|endoftext|> x<|startoftext|>y", "e\u0301a", "don't\nI'll", "\r\n \n",
         "\u03a3\u0391\u03a3 \u0130 \u00df", "x&amp; a,b ... $$$ wor!d wo!!", "the " * 5000]


def test_token_ids():
    tokenizer = Tokenizer.from_file(PATH)
    ids, ends = packing.token_ids(packing.WordIds(tokenizer), pa.array(WORDS))
    for text, a, b in zip(WORDS, ends, ends[1:]):
        assert ids[a:b].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def optimum(items, capacity):
    items = sorted(items, reverse=True)
    best = len(items)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for room in sorted(set(bins)):
            if room >= items[i]:
                at = bins.index(room)
                place(i + 1, bins[:at] + [room - items[i]] + bins[at + 1 :])
        place(i + 1, [*bins, capacity - items[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_reduction_keeps_the_optimum(seed):
    draw = random.Random(seed)
    capacity = draw.randint(8, 30)
    items = [draw.randint(max(1, capacity // draw.choice((3, 5, 9))), capacity) for _ in range(draw.randint(1, 9))]
    fixed, left = packing.reduce(Counter(items), capacity)
    used = Counter()
    for pattern, bins in fixed:
        assert sum(n * k for n, k in pattern) <= capacity
        for n, k in pattern:
            used[n] += k * bins
    assert used + Counter(left) == Counter(items)
    assert sum(b for _, b in fixed) + optimum(list(Counter(left).elements()), capacity) == optimum(items, capacity)


def test_pack(spark):
    texts = WORDS + ["a b c"] * 30 + ["word " * n for n in range(1, 40)]
    docs = spark.createDataFrame([(i % 35, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, length int").repartition(3)
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 64)):
            want[i % 35, k, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes())] += 1
    got = packing.pack(docs, PATH, capacity=64).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    assert len(sequences) <= -(-sum(r.length for r in got) // 64) + 3
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_each_word_is_tokenised_once():
    """Words come back after 160,000 others: the tokenizer sees each part of letters only once."""
    tokenizer, seen = Tokenizer.from_file(PATH), []

    class Counted:
        def get_vocab(self):
            return tokenizer.get_vocab()

        def encode_batch_fast(self, texts, add_special_tokens):
            seen.extend(word for text in texts for word in text.split())
            return tokenizer.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    letters = "abcdefghij"
    words = ["".join(letters[int(d)] for d in str(n)) for n in range(100_000, 260_000)]
    word_ids = packing.WordIds(Counted())
    for part in (words[:80_000], words[80_000:], [f"{w.upper()}." for w in words[:1000]], words[:1000]):
        ids, ends = packing.token_ids(word_ids, pa.array([" ".join(part)]))
        assert ids.tolist() == tokenizer.encode(" ".join(part), add_special_tokens=False).ids
    assert len(seen) == len(words) + 1


def test_letters_that_normalise_to_two_runs():
    tokenizer = Tokenizer.from_file(PATH)
    texts = [f"a{c}! {c}., Ä{c}?" for c in "क़য়གྷİΣ×µŉſŸ"]
    ids, ends = packing.token_ids(packing.WordIds(tokenizer), pa.array(texts))
    for text, a, b in zip(texts, ends, ends[1:]):
        assert ids[a:b].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
