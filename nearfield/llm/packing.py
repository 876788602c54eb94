"""Best-fit packing of token sequences, after Martello and Toth's dominance reduction.

A document is its token ids and an end id; only one longer than the capacity is cut, into pieces of the capacity and a
last one of the rest.  Pieces of one length are interchangeable, so the instance is the number of pieces of each length:
at most as many numbers as the capacity, whatever the data.  On these counts the driver first fixes small sets that
dominate all others with the same piece (see ``reduce``), then places the remainder by best fit, longest first.  The
result is a short list of patterns with repetitions.  Spark numbers the pieces of each length, in slices of bounded
size, and each piece takes the place with its number.
A null text is empty: one piece of the end id.  Repeated rows are packed each.  An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm import shared
from nearfield.session import settings, stored

CAPACITY = 4096
END_ID = 1
#: Expected pieces of one length that one task numbers together.
SLICE_ROWS = 4096
#: Words whose ids a task remembers between batches of text.
KNOWN_WORDS = 400_000
#: Letters that lower-case one by one whatever stands beside them, and signs that may follow them in a word.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_SIGNS = ".,;:!?|*&$%#"
_PLAIN = f"^[{_LETTERS}]+[{_SIGNS}]*$"
_LOW_LETTERS = "".join(c for c in map(chr, range(0x180)) if re.match(f"[{_LETTERS}]", c) and c.lower() == c)
_TEXT_BYTES = 4 << 20  # text tokenised at once

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
Pattern = tuple[tuple[int, int], ...]  # (length, how many), ...


class WordIds:
    """Ids of words, each distinct part tokenised once while it is remembered.

    The tokenizer lower-cases a word and cuts it into runs (of letters, of signs, ...), whose last ids it marks.  Words
    of letters and perhaps signs after them are put together from both parts; letters are one run, so many words are
    tokenised in one text and told apart by the marks.  All other words are tokenised one by one.  Words of the usual
    letters are cut and lower-cased by Arrow, so Python looks up their distinct parts only.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        vocabulary = tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.known = {"": 0}  # number of a word, whose ids are from starts[number] on up to the next
        self.ids, self.starts = array("i"), array("q", [0, 0])

    def _add(self, words: list[str], ids: list[int], ends: np.ndarray) -> None:
        """New words, all different, with their ids in a row."""
        first = len(self.starts) - 1
        self.known.update(zip(words, range(first, first + len(words))))
        self.starts.frombytes((ends + len(self.ids)).astype(np.int64).tobytes())
        self.ids.extend(ids)

    def _add_letters(self, words: list[str]) -> None:
        for at in range(0, len(words), 8192):
            parts = [words[k : k + 256] for k in range(at, min(at + 8192, len(words)), 256)]
            found = self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)
            for part, ids in zip(parts, (e.ids for e in found)):
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) == len(part):
                    self._add(part, ids, ends)
                else:
                    self._add_single(part)

    def _add_single(self, words: list[str]) -> None:
        for at in range(0, len(words), 512):
            part = words[at : at + 512]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            self._add(part, [i for ids in found for i in ids], np.cumsum([len(ids) for ids in found]))

    def _numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))

    def _plain(self, words: pa.Array) -> np.ndarray:
        """Numbers of both parts of words of usual letters and signs."""
        low, out = pc.utf8_lower(words), np.empty((len(words), 2), np.int32)
        trimmed = (pc.utf8_rtrim(low, _SIGNS), self._add_letters), (pc.utf8_ltrim(low, _LOW_LETTERS), self._add_single)
        for place, (parts, add) in enumerate(trimmed):
            coded = parts.dictionary_encode()
            distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            add([p for p in distinct if p not in self.known])
            out[:, place] = self._numbers(distinct)[coded.indices.to_numpy()]
        return out

    def _others(self, words: list[str]) -> np.ndarray:
        known, letters, single, parts = self.known, set(), set(), []
        for word in words:
            low = word.lower()
            bare = low.rstrip(_SIGNS)
            # The form of sigma at a word's end depends on what follows, so such words are left as they are.
            # Some letters become two runs when the tokenizer normalises them.
            if bare.isalpha() and "\u03c2" not in bare and unicodedata.normalize("NFC", bare).isalpha():
                signs = low[len(bare) :]
                if bare not in known:
                    letters.add(bare)
                if signs not in known:
                    single.add(signs)
                parts += (bare, signs)
            else:
                if word not in known:
                    single.add(word)
                parts += (word, "")
        self._add_letters(list(letters))
        self._add_single([word for word in single if word not in known])
        return self._numbers(parts).reshape(-1, 2)

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has."""
        if len(self.known) > KNOWN_WORDS:
            self._clear()
        plain = pc.match_substring_regex(words, _PLAIN)
        number, usual = np.empty((len(words), 2), np.int32), plain.to_numpy(zero_copy_only=False)
        number[usual] = self._plain(words.filter(plain))
        number[~usual] = self._others(words.filter(pc.invert(plain)).to_pylist())
        number = number.ravel()
        ids, starts = np.array(self.ids, np.int32), np.array(self.starts, np.int64)
        size = np.diff(starts)[number]
        return ids[ranges(starts[number], size)], size.reshape(-1, 2).sum(axis=1)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of them, in a row."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def token_ids(word_ids: WordIds, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in a row, and where each text's begin and end.

    The tokenizer splits at white space, which it drops, so blanks and line breaks cut a text into words whose ids
    don't depend on the rest; each distinct word is tokenised once.
    """
    texts = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    flat, sizes = word_ids(coded.dictionary)
    word = coded.indices.to_numpy()
    size = sizes[word]
    out = flat[ranges((np.cumsum(sizes) - sizes)[word], size)]
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return out, np.r_[0, np.cumsum(size)][offsets]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (of little-endian unsigned 32-bit ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        word_ids = WordIds(Tokenizer.from_file(tokenizer_path))
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                before = sizes[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, before + _TEXT_BYTES, side="right")))
                part = batch.slice(at, to - at)
                ids, ends = token_ids(word_ids, part.column("text"))
                rows = []
                for doc, a, b in zip(part.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                    own = np.append(ids[a:b], end_id).astype("<u4")
                    for number, start in enumerate(range(0, len(own), capacity)):
                        piece = own[start : start + capacity]
                        rows.append((doc, number, start, len(piece), zlib.crc32(piece.tobytes())))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])
                at = to

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(shared.tidy(run), PIECES)


class Multiset:
    """Lengths with their counts, in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {k: n for k, n in counts.items() if n > 0}
        self.order = sorted(self.counts)

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            self.order.pop(bisect.bisect_left(self.order, length))

    def smallest(self, n: int) -> list[int]:
        out: list[int] = []
        for length in self.order:
            out += [length] * min(self.counts[length], n - len(out))
            if len(out) == n:
                break
        return out

    def largest(self, most: int) -> int | None:
        at = bisect.bisect_right(self.order, most)
        return self.order[at - 1] if at else None

    def best_pair(self, most: int) -> tuple[int, int] | None:
        """(a, b), a >= b, of the largest sum up to ``most``."""
        best, low, high = None, 0, bisect.bisect_right(self.order, most) - 1
        while low <= high:
            a, b = self.order[high], self.order[low]
            if a + b > most or (low == high and self.counts[a] < 2):
                high -= 1
                continue
            if best is None or a + b > sum(best):
                best = (a, b)
            low += 1
        return best


def _dominating(left: Multiset, item: int, capacity: int) -> Pattern | None:
    """A set with ``item`` that is at least as good as any other with it, ``left`` being all other pieces.

    One set dominates another if the other's pieces can be shared out to distinct pieces of the first, none of which
    gets more than its length.
    """
    room = capacity - item
    few = left.smallest(3)
    if not few or few[0] > room:
        return ((item, 1),)
    one = left.largest(room)
    if one == room or len(few) < 2 or few[0] + few[1] > room:  # fills the bin, or only one more goes in
        return ((item, 1), (one, 1))
    if len(few) == 3 and sum(few) <= room:
        return None
    pair = left.best_pair(room)  # at most two more go in
    if pair is None or one >= sum(pair):
        return ((item, 1), (one, 1))
    a, b = pair
    between = left.order[bisect.bisect_right(left.order, b) : bisect.bisect_left(left.order, a)]
    two = [x for x in between[:2] for _ in range(min(2, left.counts[x]))][:2]
    if a + b == room and one == a and (len(two) < 2 or sum(two) > room):
        return ((item, 1), (a, 1), (b, 1))
    return None


def reduce(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Sets fixed by dominance, with their number, and the counts that remain; repeated until nothing more is fixed."""
    left, fixed, changed = Multiset(counts), [], True
    while changed:
        changed = False
        for item in sorted(left.counts, reverse=True):
            while left.counts.get(item):
                left.take(item, 1)
                found = _dominating(left, item, capacity)
                if item in left.counts:
                    left.counts[item] += 1
                else:
                    bisect.insort(left.order, item)
                    left.counts[item] = 1
                if found is None:
                    break
                need = Counter()
                for length, n in found:
                    need[length] += n
                # With fewer other pieces the same set still dominates while all its pieces are there.
                times = min(left.counts[length] // n for length, n in need.items())
                for length, n in need.items():
                    left.take(length, n * times)
                fixed.append((tuple(need.items()), times))
                changed = True
    return fixed, left.counts


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Longest first, each into the fullest bin that takes it; bins of one content are handled together."""
    rooms: dict[int, list[tuple[Pattern, int]]] = {}
    order: list[int] = []  # the rooms that bins have

    def put(room: int, pattern: Pattern, bins: int) -> None:
        if bins:
            if room not in rooms:
                rooms[room] = []
                bisect.insort(order, room)
            rooms[room].append((pattern, bins))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect.bisect_left(order, length)
            room, pattern, bins = capacity, (), n
            if at < len(order):
                room = order[at]
                pattern, bins = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    order.pop(at)
            each = room // length
            whole = min(bins, n // each)
            put(room - each * length, (*pattern, (length, each)), whole)
            n -= whole * each
            bins -= whole
            if n and bins and n < each:  # the last of them share one bin
                put(room - n * length, (*pattern, (length, n)), 1)
                n, bins = 0, bins - 1
            if pattern:
                put(room, pattern, bins)
    return [part for parts in rooms.values() for part in parts]


def places(patterns: list[tuple[Pattern, int]]) -> np.ndarray:
    """Rows (length, first number, first sequence, pieces per sequence, offset), sorted: where numbered pieces go."""
    out, used, sequence = [], Counter(), 0
    for pattern, bins in patterns:
        offset = 0
        for length, each in pattern:
            out.append((length, used[length], sequence, each, offset))
            used[length] += bins * each
            offset += length * each
        sequence += bins
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 5)


def _placed(numbered: DataFrame, table: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (table[:, 0] << 48) | table[:, 1]
        for batch in batches:
            length, number = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "number"))
            row = table[np.searchsorted(keys, (length << 48) | number, side="right") - 1]
            at = number - row[:, 1]
            sequence, offset = row[:, 2] + at // row[:, 3], row[:, 4] + at % row[:, 3] * length
            kept = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return numbered.mapInArrow(run, PIECES + ", sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece, with the sequence it is in and its offset there."""
    spark = docs.sparkSession
    key = F.xxhash64("doc_id", "piece", F.monotonically_increasing_id())  # fixed once stored
    with settings(spark, shared.SMALL_BATCHES):
        cut = stored(pieces(docs, tokenizer_path, capacity, end_id).withColumn("key", key), "pieces")
    # At most one row per length up to the capacity.
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    fixed, remain = reduce(counts, capacity)
    table = places(fixed + best_fit(remain, capacity))

    slices = spark.createDataFrame([(k, -(-n // SLICE_ROWS)) for k, n in counts.items()], "length bigint, slices bigint")
    cut = cut.join(F.broadcast(slices), "length")
    cut = cut.withColumn("slice", F.pmod("key", "slices")).drop("slices")
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "slice").orderBy("key")) - 1
    numbered = cut.withColumn("inside", inside).join(sizes, ["length", "slice"])
    return _placed(numbered.withColumn("number", F.col("before") + F.col("inside")), table)
