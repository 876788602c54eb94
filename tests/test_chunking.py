import random
import re

import pytest

from nearfield.functions import text as tx
from nearfield.operators.chunking import chunk_documents, chunk_sizes, chunk_stats, split_sentences, with_chunk_count

WS = tx.WHITESPACE


def expected(text, size, overlap, keep_sentences, min_chars=50):
    """Plain restatement of the rules, one document at a time."""
    n = len(text)
    if n < min_chars:
        return [(0, 0, n, text.strip(WS), -(-n // 4))]
    ends = [m.end() for m in re.finditer("[.!?]" + tx.WHITESPACE_CLASS + "+", text)]
    marks = [(m.start(), m.end()) for m in re.finditer("[.!?]" + tx.WHITESPACE_CLASS + "+", text)]
    assert len(ends) == len(marks)
    radius = min(200, n // 10)
    out, start = [], 0
    while True:
        target = start + size
        if target >= n:
            stop = n
        else:
            stop = target
            if keep_sentences:
                low, high = max(0, target - radius), min(n, target + radius)
                best = radius
                for s, e in marks:
                    if s >= low and s + 1 < high:
                        at = min(e, high)
                        if abs(at - target) < best:
                            best, stop = abs(at - target), at
                if abs(stop - target) >= 0.3 * size:
                    stop = target
        body = text[start:stop].strip(WS)
        if len(body) >= min_chars:
            out.append((len(out), start, stop, body, -(-len(body) // 4)))
        if stop >= n:
            return out
        start = max(start + 1, stop - overlap)


def corpus():
    rng = random.Random(5)
    words = ["alpha", "be", "gamma.", "delta!", "no?", "\n\n", "\t", "\u00a0", "\u00e9", "word" * 9, ".", "...", " ", "\u3000x"]
    texts = ["", " ", "short.", " " * 60, "x" * 50, "x" * 49, "a. " * 400, "no end " * 900, "tail. " + " " * 500 + "z" * 3000]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(5, 1500))) for _ in range(60)]
    return texts


@pytest.mark.parametrize("keep_sentences", [True, False])
@pytest.mark.parametrize("tokens, percent", [(400, 15), (100, 15), (50, 50), (50, 0), (100, 29), (60, 80)])
def test_chunks_follow_the_rules(spark, keep_sentences, tokens, percent):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    got = {}
    rows = chunk_documents(docs, chunk_tokens=tokens, overlap_percent=percent, keep_sentences=keep_sentences).collect()
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.chunk_index, r.start_index, r.end_index, r.text, r.tokens))
    size, overlap = chunk_sizes(tokens, percent)
    for i, text in enumerate(texts):
        assert sorted(got.get(i, [])) == expected(text, size, overlap, keep_sentences), i


def test_overlap_is_a_percentage_in_double_arithmetic():
    assert chunk_sizes(100, 29) == (400, 115)
    assert chunk_sizes(400, 0.15) == (1600, 2)
    with pytest.raises(ValueError):
        chunk_sizes(400, 100)


def test_null_texts_and_carried_columns(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "hello", "b")], "doc_id int, text string, tag string")
    assert [(r.doc_id, r.text, r.tag) for r in chunk_documents(docs, keep=["tag"]).collect()] == [(2, "hello", "b")]
    for keep_sentences in (True, False):
        kept = chunk_documents(docs, keep_sentences=keep_sentences, keep_empty=True).orderBy("doc_id").collect()
        assert [(r.doc_id, r.chunk_id is None, r.text) for r in kept] == [(1, True, None), (2, False, "hello")]
    assert [r.chunks for r in with_chunk_count(docs).orderBy("doc_id").collect()] == [0, 1]


def test_characters_outside_the_basic_plane_count_once(spark):
    text = "\U0001f600" * 300
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    for keep_sentences in (True, False):
        rows = chunk_documents(docs, chunk_tokens=50, overlap_percent=0, keep_sentences=keep_sentences).orderBy("chunk_index").collect()
        assert [(r.start_index, r.end_index, r.text, r.tokens) for r in rows] == [
            (0, 200, text[:200], 50), (200, 300, text[:100], 25)
        ]


def test_ids_are_stable_and_distinct(spark):
    docs = spark.createDataFrame([(1, "word. " * 2000), (2, "word. " * 2000)], "doc_id int, text string")
    once = [r.chunk_id for r in chunk_documents(docs).collect()]
    assert sorted(once) == sorted(r.chunk_id for r in chunk_documents(docs.repartition(3)).collect())
    assert len(set(once)) == len(once)
    other = {r.chunk_id for r in chunk_documents(docs, chunk_tokens=200).collect()}
    assert not other & set(once)
    assert all(re.fullmatch("[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", i) for i in once)


def test_text_functions(spark):
    samples = ["a\r\nb\rc\n\n\n\nd", " \t x \t\t y  z ", "\u00a0\ufeff pad \u3000\v", "", "a  b\tc \t d", "\u2003\n"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, t string")

    def clean(s):
        s = re.sub("\r", "\n", s.replace("\r\n", "\n"))
        return re.sub("[ \t]+", " ", re.sub("\n{3,}", "\n\n", s)).strip(WS)

    from pyspark.sql import functions as F

    got = df.orderBy("i").select(tx.clean_text(F.col("t")).alias("c"), tx.is_blank(F.col("t")).alias("b")).collect()
    assert [r.c for r in got] == [clean(s) for s in samples]
    assert [r.b for r in got] == [not s.strip(WS) for s in samples]
    reasons = df.select(tx.validation_reason(F.repeat("t", 5), 12).alias("r")).collect()

    def reason(t):
        tokens = -(-len(t) // 4)
        if not t.strip(WS):
            return "Text is empty"
        return f"Text too long: ~{tokens} tokens (max: 12)" if tokens > 12 else None

    assert {r.r for r in reasons} == {reason(s * 5) for s in samples}


def test_sentences_drop_blanks(spark):
    docs = spark.createDataFrame([(1, "  . One.  Two!\n\nThree? four.")], "doc_id int, text string")
    rows = split_sentences(docs).orderBy("sentence_index").collect()
    assert [r.sentence for r in rows] == ["  .", "One.", "Two!", "Three?", "four."]


def test_stats_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert chunk_stats(empty).collect()[0].asDict() == {"chunks": 0, "avg_chunk_chars": None}


def test_few_texts_are_cut_at_a_time():
    import pyarrow as pa

    from nearfield.operators import chunking

    texts = [None if i % 9 == 4 else f"Sentence number {i}. " * (i % 40) for i in range(3 * chunking.TEXTS + 1)]
    cut = chunking._cutter(*chunking.chunk_sizes(50, 10), 20)
    found = list(chunking._sentence_cutter(*chunking.chunk_sizes(50, 10), 20).func(iter([pa.array(texts)])))
    assert max(map(len, found)) <= chunking.TEXTS
    pieces = [[c["chunk_text"] for c in chunks] for part in found for chunks in part.to_pylist()]
    assert pieces == [[piece for _, _, piece in cut(t)] if t is not None else [] for t in texts]
    counts = list(chunking._chunk_counter(*chunking.chunk_sizes(50, 10), 20, True).func(iter([pa.array(texts)])))
    assert max(map(len, counts)) <= chunking.TEXTS and [n for part in counts for n in part.to_pylist()] == list(map(len, pieces))
