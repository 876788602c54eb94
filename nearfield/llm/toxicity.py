"""Toxicity of texts after noisy-channel deobfuscation.

A character language model (trigrams over all documents, backing off to shorter ones) and a channel of disguises span a
lattice of readings over each suspicious piece of text: look-alike signs stand for letters, signs between letters may
be noise or blanks, letters said three times or more may be one or two, and the blanks of letters written apart may be
dropped.  Viterbi search takes the likeliest reading.  A word with signs inside is read without blanks, with them, and as
the words between its signs (Unicode punctuation, symbols and format characters), whatever its length.  Other words have
a single reading, themselves.

The restored words are scored by words and word beginnings that occur in toxic rows of a labelled sample far more often
than chance explains.  A score is the chance that at least one of the text's telling words is meant (noisy or), over
the rate of toxic rows among texts without any.  Null and empty texts, and all texts if there are no labels, get that
rate; rows are scored one by one, so repeated rows and extra columns don't matter.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.session import stored

#: Labelled rows that are learned from, at most; chosen by a hash of the id.
TRAIN_ROWS = 16_000
PREFIXES = (4, 5, 6)
#: The most that a text without telling words scores: nothing in it says that it is toxic.
MOST_BASE = 0.45
#: A word's toxic share counts as if so many rows more had the average share.
PRIOR_ROWS = 1.0
#: Toxic share that a word needs, and the beginning of words.
LEAST_SHARE, LEAST_SHARE_BEGINNING = 0.7, 0.85

# Letters that signs may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t",
}
MASKED = "aeiou"  # what a star may hide

_SYMBOLS = 64
_LETTER = re.compile(r"[^\W\d_]")
_SIGN_KINDS = {"Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Sm", "Sc", "Sk", "So", "Cc", "Cf"}


def _signs() -> str:
    """A character class of punctuation, symbols, controls and format characters that stand for no letter."""
    codes = [c for c in range(0xE1000) if unicodedata.category(chr(c)) in _SIGN_KINDS and chr(c) not in LOOKALIKES]
    starts = [c for c, before in zip(codes, [-2, *codes]) if c != before + 1]
    ends = [c for c, after in zip(codes, [*codes[1:], -1]) if c != after - 1]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(starts, ends))


_NOISE_CLASS = _signs()
_NOISE = re.compile(f"[{_NOISE_CLASS}]+")
#: Signs that words are cut at; those that may be letters too cut in a second reading.
_ANY_SIGN = re.compile(f"[{_NOISE_CLASS}@$!|+]+")
_ODD = re.compile(rf"[0-9@$!|+{_NOISE_CLASS}]|([^\W\d_])\1\1")
_EDGE = frozenset(c for c in map(chr, range(0xE1000)) if _NOISE.match(c) or c in "!|")
_TEXT_BYTES = 2 << 20
#: Words whose counts a task holds before it hands them on.
COUNTED = 100_000


def _symbol_table() -> np.ndarray:
    """Symbols of code points: 0 no letter, 1-26 a-z, 27-62 other letters (folded), 63 letters outside of Latin-1."""
    table = np.zeros(1 << 16, np.uint8)
    for code in range(1 << 16):
        char = chr(code)
        if char.isalpha():
            table[code] = code - 96 if "a" <= char <= "z" else 27 + code % 36 if code < 256 else 63
    return table


class CharModel:
    """Log-probabilities of a character after two others, from counts of trigrams."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS).astype(np.float64)
        one = three.sum(axis=(0, 1)) + 1.0
        one /= one.sum()
        two = three.sum(axis=0)
        two = (two + 10.0 * one) / (two.sum(axis=1, keepdims=True) + 10.0)
        full = (three + 5.0 * two) / (three.sum(axis=2, keepdims=True) + 5.0)
        self.log = np.log(full).astype(np.float32)
        self.table = _symbol_table()

    def symbol(self, char: str) -> int:
        return int(self.table[min(ord(char), 0xFFFF)])

    def read(self, lattice: list[list[tuple[str, float]]]) -> str:
        """The likeliest reading: one choice (characters, log-chance) of each place."""
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        settled: list[str] = []
        for choices in [*lattice, [(" ", 0.0)]]:
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, back) in states.items():
                for chars, chance in choices:
                    x, y, total = a, b, score + chance
                    for char in chars:
                        z = self.symbol(char)
                        total += float(self.log[x, y, z])
                        x, y = y, z
                    if (x, y) not in after or total > after[x, y][0]:
                        after[x, y] = (total, (chars, back))  # readings share what they have in common
            states = after
            if len(states) == 1:  # all readings agree on what led here
                (last, (_, back)) = next(iter(states.items()))
                settled.append(_spelt(back))
                states = {last: (0.0, None)}
        return "".join([*settled, _spelt(max(states.values(), key=lambda s: s[0])[1])]).strip()


def _spelt(back: tuple | None) -> str:
    """The characters that lead to the end of a chain of (characters, what was before)."""
    out = []
    while back is not None:
        out.append(back[0])
        back = back[1]
    return "".join(reversed(out))


def lattice(text: str, blanks: bool = False) -> list[list[tuple[str, float]]]:
    """Readings of each place of lower-case ``text``; blanks are those between letters written apart.

    With ``blanks``, signs that stand for no letter may be blanks too.
    """
    places = []
    for run in re.finditer(r"(.)\1*", text):
        char, n = run[1], len(run[0])
        if char == " ":
            places.append([("", math.log(0.5)), (" ", math.log(0.5))])
        elif char in LOOKALIKES:
            letters = LOOKALIKES[char]
            chance = math.log(0.9 / len(letters))
            one = [(c, chance) for c in letters]
            places.extend([one] * n if n < 3 else [one])
        elif _NOISE.match(char):
            stars = [(v, math.log(0.1)) for v in MASKED] if char == "*" else []
            other = [(" ", math.log(0.5))] if blanks else []
            places.extend([[("", math.log(0.5)), *stars, *other]] * (n if stars and n < 4 else 1))
        elif n == 1:
            places.append([(char, 0.0)])
        elif n == 2:
            places.append([(char * 2, math.log(0.8)), (char, math.log(0.2))])
        else:
            places.append([(char, math.log(0.5)), (char * 2, math.log(0.5))])
    return places


def joined(letters: str, model: CharModel) -> set[str]:
    """Words that letters written apart may be: read with blanks where they are likely, and as one word."""
    return {*model.read(lattice(letters)).split(), *model.read(lattice(letters.replace(" ", ""))).split()}


def bare_word(word: str) -> str:
    """``word`` without signs at its edges."""
    a, b = 0, len(word)
    while a < b and word[a] in _EDGE:
        a += 1
    while a < b and word[b - 1] in _EDGE:
        b -= 1
    return word[a:b]


def restored(word: str, model: CharModel) -> list[str]:
    """Lower-case readings of one word: as it stands without signs at its edges, and the likeliest if it looks odd.

    If there are signs inside, they may be noise or blanks, or each of them ends a word.
    """
    bare = bare_word(word.lower())
    if not _LETTER.search(bare):
        return []
    if not _ODD.search(bare):
        return [bare]
    forms = [bare, *model.read(lattice(bare)).split()]
    if _NOISE.search(bare):
        forms += model.read(lattice(bare, blanks=True)).split()
    for cut in (_NOISE, _ANY_SIGN):
        pieces = cut.split(bare)
        for piece in pieces if len(pieces) > 1 else ():
            if _LETTER.search(piece):
                forms += [piece, *(model.read(lattice(piece)).split() if _ODD.search(piece) else ())]
    return list(dict.fromkeys(forms))


class Words:
    """The distinct words of some texts, and where they occur."""

    def __init__(self, texts: pa.Array):
        lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        self.distinct = coded.dictionary.to_pylist()
        self.at = coded.indices.to_numpy()
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        self.doc = np.repeat(np.arange(len(texts)), np.diff(offsets))

    def apart(self) -> Iterator[tuple[int, str]]:
        """(text, letters with blanks) where at least three single characters follow each other."""
        single = np.fromiter((len(bare_word(w)) == 1 for w in self.distinct), bool, len(self.distinct))[self.at]
        if not single.any():
            return
        joined = single[1:] & single[:-1] & (self.doc[1:] == self.doc[:-1])
        edges = np.flatnonzero(np.diff(np.r_[False, joined, False].astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= 2:
                letters = [bare_word(self.distinct[i]).lower() for i in self.at[a : b + 1].tolist()]
                yield int(self.doc[a]), " ".join(letters)


def _parts(batches: Iterator[pa.RecordBatch], size: int = _TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of a bounded size of text."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


def char_counts(docs: DataFrame) -> np.ndarray:
    """Counts of trigrams of symbols over all texts; at most 64 cubed rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts = _symbol_table(), np.zeros(_SYMBOLS**3, np.int64)
        for batch in _parts(batches):
            text = "  ".join(t for t in batch.column("text").to_pylist() if t).lower() + "  "
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            symbols = table[np.minimum(codes, 0xFFFF)].astype(np.int32)
            counts += np.bincount((symbols[:-2] << 12) | (symbols[1:-1] << 6) | symbols[2:], minlength=_SYMBOLS**3)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["code", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "code bigint, n bigint")
    counts = np.zeros(_SYMBOLS**3, np.int64)
    for row in rows.groupBy("code").agg(F.sum("n").alias("n")).collect():
        counts[row.code] = row.n
    return counts


def _features(form: str) -> list[str]:
    return [form, *(f"{form[:n]}~" for n in PREFIXES if len(form) >= n)]


def _document_features(words: Words, model: CharModel) -> list[set[str]]:
    """Words and word beginnings of each text."""
    forms = [[f for form in restored(w, model) for f in _features(form)] for w in words.distinct]
    out: list[set[str]] = [set() for _ in range(int(words.doc[-1]) + 1 if len(words.doc) else 0)]
    for doc, word in set(zip(words.doc.tolist(), words.at.tolist())):
        out[doc].update(forms[word])
    for doc, letters in words.apart():
        for form in joined(letters, model):
            out[doc].update(_features(form))
    return out


def telling_words(labelled: DataFrame, model: CharModel) -> tuple[dict[str, float], float]:
    """Features with their toxic share, learned from rows (text, toxic, witness); and the share of toxic rows with none of them.

    What several rows of one witness say counts once: a feature has as many voices as witnesses have it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter] = [Counter(), Counter()]
        at, own = None, set()  # the witness whose rows are being read, and its features so far

        def counted() -> Iterator[pa.RecordBatch]:
            for toxic, counter in enumerate(seen):
                columns = [pa.array(list(counter), pa.string()), pa.array(list(counter.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([toxic] * len(counter), pa.int32())], names=["feature", "n", "toxic"])
                counter.clear()

        for batch in _parts(batches, _TEXT_BYTES // 4):
            found = _document_features(Words(batch.column("text")), model)
            found += [set()] * (batch.num_rows - len(found))
            for witness, toxic, features in zip(batch.column("witness").to_pylist(), batch.column("toxic").to_pylist(), found):
                if (witness, toxic) != at:
                    if at is not None:
                        seen[at[1]].update(own)
                    at, own = (witness, toxic), set()
                own |= features
            if sum(map(len, seen)) > COUNTED:
                yield from counted()
        if at is not None:
            seen[at[1]].update(own)
        yield from counted()

    totals = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.countDistinct("witness").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return {}, MOST_BASE if bad else 0.5 / (good + 10.0)
    together = labelled.select("witness", "toxic", "text").repartition("witness").sortWithinPartitions("witness", "toxic")
    counts = together.mapInArrow(run, "feature string, n bigint, toxic int").groupBy("feature")
    counts = counts.agg(
        F.coalesce(F.sum(F.when(F.col("toxic") == 1, F.col("n"))), F.lit(0)).alias("bad"), F.sum("n").alias("all")
    )
    counts = stored(counts, "word-counts")
    # Twice the log-likelihood ratio that hardly any of so many words reaches by chance.
    least_gain = 2 * math.log(max(2, counts.count()))
    rate, share = bad / (bad + good), F.col("bad") / F.col("all")
    part = lambda n, p, q: F.when(n > 0, n * F.log(p / q)).otherwise(0.0)
    gain = 2 * (part(F.col("bad"), share, F.lit(rate)) + part(F.col("all") - F.col("bad"), 1 - share, F.lit(1 - rate)))
    weight = (F.col("bad") + PRIOR_ROWS * rate) / (F.col("all") + PRIOR_ROWS)
    least = F.when(F.col("feature").endswith("~"), LEAST_SHARE_BEGINNING).otherwise(LEAST_SHARE)
    telling = counts.where((gain >= least_gain) & (weight >= least)).select("feature", weight.alias("weight"))
    # The gain asks for several toxic rows of the bounded sample each, so these are few.
    weights = {r.feature: r.weight for r in telling.collect()}
    scored = scores(labelled, model, weights, 0.0).where("score = 0")
    rest = scored.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    return weights, min(MOST_BASE, (rest.bad + 0.5) / (rest.n + 10.0))


def _scored(texts: pa.Array, model: CharModel, weights: dict[str, float], base: float) -> np.ndarray:
    def weigh(form: str) -> float:
        return max(weights.get(f, 0.0) for f in _features(form))

    words = Words(texts)
    weight = np.zeros(len(words.distinct))
    for i, word in enumerate(words.distinct):
        for form in restored(word, model):
            weight[i] = max(weight[i], weigh(form))
    clear = np.zeros(len(texts))  # log of the chance that no word is meant
    here = np.flatnonzero(weight[words.at] > 0)
    if len(here):
        pairs = np.unique(words.doc[here] * len(weight) + words.at[here])
        doc, word = np.divmod(pairs, len(weight))
        np.add.at(clear, doc, np.log1p(-np.minimum(weight[word], 0.9999)))
    for doc, letters in words.apart():
        for form in joined(letters, model):
            clear[doc] += math.log1p(-min(weigh(form), 0.9999))
    return 1.0 - (1.0 - base) * np.exp(clear)


def scores(rows: DataFrame, model: CharModel, weights: dict[str, float], base: float) -> DataFrame:
    """``rows`` with a double ``score`` of their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            score = _scored(batch.column("text"), model, weights, base)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    schema = rows.select("*", F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(run, schema)


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[CharModel, dict[str, float], float]:
    """Character model of all ``docs`` and telling words of at most TRAIN_ROWS rows of ``labels`` (doc_id, toxic)."""
    model = CharModel(char_counts(docs))
    chosen = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    sample = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Of texts that are equal but for case and white space the row of the least id is learned from.  Rows that share their
    # sentence of the smallest hash are one witness, so a passage that many rows have doesn't speak for itself many times.
    same = F.xxhash64(F.btrim(F.regexp_replace(F.lower("text"), r"\s+", " ")))
    sample = sample.join(F.broadcast(chosen), "doc_id").groupBy(same.alias("same"), "toxic").agg(F.min(F.struct("doc_id", "text")).alias("one"))
    sentences = F.filter(F.split(F.lower("text"), r"[.\n]+"), lambda part: F.length(part) > 20)
    witness = F.coalesce(F.array_min(F.transform(sentences, lambda part: F.xxhash64(part))), F.xxhash64("text"))
    sample = sample.select("one.text", "toxic").withColumn("witness", witness)
    return model, *telling_words(stored(sample, "labelled"), model)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score of every document."""
    model, weights, base = fitted(docs, labels)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scores(rows, model, weights, base).select("doc_id", "score")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` whose score is below ``threshold``, all columns kept."""
    model, weights, base = fitted(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            yield batch.filter(pa.array(_scored(batch.column("text"), model, weights, base) < threshold))

    return docs.mapInArrow(run, docs.schema)
