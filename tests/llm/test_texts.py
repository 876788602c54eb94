"""Suffix arrays, WARC files, language and toxicity."""

import base64
import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest

from nearfield.llm import language, suffixes, toxicity, warc


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array(seed):
    draw = random.Random(seed)
    text = bytes(draw.choice(b"ab c\xff"[: draw.randint(1, 5)]) for _ in range(draw.randint(1, 300)))
    got = suffixes.suffix_array(np.frombuffer(text, np.uint8), 10**6).tolist()
    assert got == sorted(range(len(text)), key=lambda i: text[i:])


def plain_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(np.sum(np.diff(np.r_[0, gone.astype(int)]) == 1))
        yield len(d), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()


@pytest.mark.parametrize("options", [{}, {"hot": 1}, {"shard_bytes": 300}])
def test_remove_repeats(spark, options):
    draw = random.Random(5)
    base = ["".join(draw.choice("ab é") for _ in range(draw.randint(0, 400))) for _ in range(12)]
    texts = base + [b[draw.randint(0, 40) :] + "xyz" + base[draw.randint(0, 11)][:300] for b in base]
    texts += [None, "", "the " * 200, "z" * 700, "q" * 199, "q" * 200, "q" * 201, *base[:2]]
    ids = [None, 1, 1, *range(3, len(texts))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts)], "doc_id long, text string, hash int").repartition(3)
    got = Counter(map(tuple, suffixes.remove_repeats(docs, **options).collect()))
    assert got == Counter((i, *x) for i, x in zip(ids, plain_repeats(texts, 200)))


def test_no_repeats_in_nothing(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_archive(spark):
    rows = [(1, "http://a", "x"), (2, None, "x"), (None, "u", "x"), (3, "u", None), (4, "u", ""), (4, "u", ""), (None, "n", "zz"),
            (5, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (7, "\nq r", "é" * 30_000)]
    rows += [(100 + i, "h", "hot") for i in range(40)]
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)

    def want(least):
        for i, _, html in rows:
            data = (html or "").encode()
            of = first.get(html or "")
            again = of is not None and i != of and len(data) >= least
            digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
            yield i, len(data), digest, "revisit" if again else "response", of if again else None

    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    assert Counter(map(tuple, warc.archive(pages, file_bytes=2000).collect())) == Counter(want(0))
    assert Counter(map(tuple, warc.archive(pages, least=2).collect())) == Counter(want(2))
    assert warc.archive(pages.limit(0)).count() == 0


def test_stream_is_read_in_pieces():
    import gzip
    import io

    parts = [warc.record(i, "u", b"p" * i * 50, "D", None) for i in range(40)]
    for packed in (gzip.compress(b"".join(parts)), b"".join(map(gzip.compress, parts))):
        got = [data for _, data in warc.records(warc.inflated(io.BytesIO(packed), block=100))]
        assert got == parts
    with pytest.raises(ValueError):
        list(warc.records(iter([b"".join(parts)[:-3]])))


def test_language(spark):
    draw = random.Random(1)
    speech = {"aa": ["kalo", "mira", "tus", "fena"], "bb": ["zwork", "schlim", "prat", "grun"]}
    rows = [(i, " ".join(draw.choice(speech[l]) for _ in range(30)).title(), l) for i, l in enumerate(["aa", "bb"] * 20)]
    docs = spark.createDataFrame(rows + [(None, "x", None), (None, "y", "")], "doc_id long, text string, lang string")
    learned = language.dictionaries(docs)
    assert set(learned) == {"aa", "bb"}
    asked = spark.createDataFrame(
        [(1, "Kalo MIRA tus tus kalo fena mira", 1), (2, "grun prat zwork schlim grun", 1), (3, None, 1), (4, "12 !? \n", 1), (None, "", 1), (5, "mira kalo " * 50_000, 1)],
        "doc_id long, text string, score int",
    )
    got = {r.doc_id: r for r in language.languages(asked, learned).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, None, 5)] == ["aa", "bb", "und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language.languages(asked, {}).collect()} == {"und"}
    assert language.dictionaries(docs.limit(0)) == {}


def test_language_against_one_compressor_at_a_time(spark):
    """Samples come from anywhere in a text, copies count once, and numerals are no letters."""
    import zstandard

    draw = random.Random(6)
    speech = {"aa": ["kalo", "mira", "tus", "fena"], "bb": ["zwork", "schlim", "prat", "grun"], "cc": ["ελα", "νερο", "φως", "γη"]}
    text = lambda lang, n: " ".join(draw.choice(speech[lang]) for _ in range(n))
    rows = [(i, text(lang, 900), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 10)]
    rows += [(100 + i, rows[0][1], "aa") for i in range(50)]
    learned = language.dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5))
    assert set(learned) == set(speech) and all(len(d) <= language.DICTIONARY_BYTES + 100 for d in learned.values())
    heads = [language.letters(t[: language.SAMPLE_CHARS]) for _, t, lang in rows if lang == "bb"]
    assert not all(head in learned["bb"] for head in heads)  # not from the start only
    asked = [(i, text(lang, draw.choice([1, 3, 40, 3000]))) for i, lang in enumerate(["aa", "bb", "cc"] * 8)] + [(90, "² ½ ① Ⅷ"), (91, "²x"), (92, "🙂 12")]
    how = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_GREEDY, window_log=18, chain_log=16, hash_log=17, search_log=4, min_match=4,
        target_length=0, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    want = {}
    for i, t in asked:
        data, sizes = language.letters(t), {}
        for name, content in learned.items():
            packer = zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            sizes[name] = sum(len(packer.compress(data[at : at + 4096])) for at in range(0, len(data), 4096))
        want[i] = min(sizes, key=lambda n: (sizes[n], n)) if any(c.isalpha() for c in t) else "und"
    got = language.languages(spark.createDataFrame(asked, "doc_id long, text string"), learned).collect()
    assert {r.doc_id: r.lang_pred for r in got} == want and want[90] == want[92] == "und" != want[91]


@pytest.fixture(scope="module")
def toxic(spark):
    draw = random.Random(4)
    bad = ["idiot", "moron", "worthless"]
    rows, labels = [], []
    for i in range(300):
        words = ["".join(draw.choice(("the", "an", "er", "ou", "on", "re", "st")) for _ in range(draw.randint(1, 3))) for _ in range(40)]
        if i % 5 == 0:
            words[draw.randint(0, 39)] = draw.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*labels, (None, 1), (7, None), (1, 5)], "doc_id long, toxic int")
    return toxicity.fitted(docs, labels)


@pytest.mark.parametrize(
    ("text", "hit"),
    [("you idiot", 1), ("You IDIOT!!", 1), ("1d10t", 1), ("an i d i o t here", 1), ("m0r0n", 1), ("moooooron", 1), ("i.d.i.o.t", 1),
     ("the onst er", 0), ("", 0), (None, 0), ("12 34 !!", 0), ("a b c", 0), ("x" * 100_000, 0)],
)
def test_toxic_words_are_restored(toxic, text, hit):
    import pyarrow as pa

    model, weights, base = toxic
    words = toxicity.Words(pa.array([text], pa.string()))
    forms = {f for w in words.distinct for f in toxicity.restored(w, model)} | {f for _, x in words.apart() for f in toxicity.joined(x, model)}
    assert any(weights.get(f, 0) >= 0.5 for f in forms) == bool(hit)
    assert 0 < base < 0.5


@pytest.mark.parametrize(
    ("text", "hit"),
    [("you-are-on-the-on-the-worthless-1d10t-on-the-er-on", 1), ("the,idiot", 1), ("on/1d10t/er", 1), ("the_m0r0n", 1),
     ("the|idiot", 1), ("\u201cidiot\u201d", 1), ("\u2014idiot\u2014the", 1), ("\u00a1idiot!", 1), ("i\u200bd\u200bi\u200bot", 1),
     ("m" + "o" * 50 + "ron", 1), ("the.on" * 3000 + ".1d10t", 1), ("i-d-i-o-t/" + "on-the-" * 30, 1),
     ("the-on-er-st/" * 40, 0), ("\u201cthe\u201d", 0)],
)
def test_words_between_signs_are_restored(toxic, text, hit):
    import pyarrow as pa

    model, weights, base = toxic
    score = toxicity._scored(pa.array([text], pa.string()), model, weights, base)[0]
    assert (score >= 0.5) == bool(hit)


@pytest.mark.parametrize("blanks", [False, True])
@pytest.mark.parametrize("word", ["1d10t", "$tup1d", "a*s", "he11o", "cooool", "b-a-d", "i.d+1o_t", "ssss", "st4**d", "0"])
def test_readings_are_the_likeliest_of_all(toxic, word, blanks):
    model = toxic[0]
    places = toxicity.lattice(word, blanks)
    best, at_best = -1e9, set()
    for path in itertools.product(*places):
        score, x, y = sum(chance for _, chance in path), 0, 0
        text = "".join(chars for chars, _ in path)
        for char in text + " ":
            z = model.symbol(char)
            score += float(model.log[x, y, z])
            x, y = y, z
        if score > best + 1e-9:
            best, at_best = score, set()
        if score > best - 1e-9:
            at_best.add(text.strip())
    assert model.read(places) in at_best


def test_long_readings(toxic):
    """A text whose states never come down to one is read whole, in linear time."""
    model = toxic[0]
    assert model.read(toxicity.lattice("1d10t")) in model.read(toxicity.lattice("the-1d10t-on", blanks=True)).split()
    places = toxicity.lattice("10" * 50_000)
    assert len(model.read(places)) == 100_000


def test_labelled_copies_are_learned_from_once(spark):
    texts = [(1, "bad words here. A shared sentence of some length."), (2, "Bad  words here. a shared sentence of some length. "),
             (3, "other words. A shared sentence of some length."), (4, None), (5, None)]
    labels = spark.createDataFrame([(i, 1) for i, _ in texts] + [(9, 0)], "doc_id long, toxic int")
    seen = []
    original = toxicity.telling_words
    toxicity.telling_words = lambda rows, model: (seen.extend(tuple(r) for r in rows.collect()), ({}, 0.1))[1]
    try:
        toxicity.fitted(spark.createDataFrame(texts, "doc_id long, text string"), labels)
    finally:
        toxicity.telling_words = original
    assert sorted(t or "" for t, *_ in seen) == ["", texts[0][1], texts[2][1]]


def test_toxicity_of_tables(spark, toxic):
    docs = spark.createDataFrame([(1, "an idiot", 9), (1, "an idiot", 9), (None, None, 9), (3, "the on", 9)], "doc_id long, text string, score int")
    got = toxicity.scores(docs.select("doc_id", "text"), *toxic).collect()
    assert [r.score >= 0.5 for r in got] == [True, True, False, False]
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    left = toxicity.without_toxic(docs, labels)
    assert left.columns == docs.columns and left.count() == 4
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
