"""Removal of repeated substrings by suffix arrays over shards.

Which bytes go is decided on windows of LENGTH bytes: a window is repeated if its bytes start anywhere else too, in the
same document or another, and every byte of a repeated window is removed.

Shards: a window's key is the smallest hash of the grams in it, so equal windows have equal keys, and windows of one key
follow each other in a document: they are one segment.  A first pass counts keys; only segments whose key occurs again
(by a filter of bounded size) are dealt out by key.  Equal segments are collapsed to one with its number.  The others of
a key make a shard: its suffix array is built by induced sorting (suffixes classified, the substrings between leftmost
smaller positions sorted and named, the string of names sorted, and the rest induced bucket by bucket in linear time),
and the common prefixes of neighbours, in text order, tell the repeated windows.  Keys with very many segments (HOT) are
first cut into pieces at places that their content names; equal pieces, the inside of a passage that very many documents
share, are counted by partial aggregation and collapsed to one.  What is left goes to the key's shard if it is few enough,
else its single windows are counted by their digests, so no shard is unbounded.

Null texts are empty.  Rows that repeat id and text count as copies of each other.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm import shared
from nearfield.session import stored

LENGTH = 200
GRAM = 40
#: Segments of one key, and windows in them, that may meet in one shard.
HOT, HOT_WINDOWS = 20_000, 4 << 20
#: Windows in a piece of a hot segment, on average.
PIECE = 16
#: Windows in a segment, at most.
SEGMENT = 4096
#: Bytes of segments whose suffixes are sorted together, unless one key has more.
SHARD_BYTES = 1 << 20
#: The filter of repeated keys has at most so many bits (32 MB).
FILTER_BITS = 1 << 28
_TEXT_BYTES = 1 << 20

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _words(data: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes from each of the first ``n`` places on, as numbers; ``data`` has seven more at least."""
    out = np.empty(-(-n // 8) * 8, np.uint64)
    padded = np.zeros(len(out) + 16, np.uint8)
    padded[: min(len(data), len(padded))] = data[: len(padded)]
    for k in range(8):
        out[k::8] = padded[k : k + len(out)].view("<u8")
    return out[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _ODD[0]
    x ^= x >> np.uint64(32)
    x *= _ODD[1]
    x ^= x >> np.uint64(29)
    return x


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM (40) bytes from each place on."""
    m = _mixed(_words(data, len(data) - 7))
    two = m[:-8] * _ODD[2] + m[8:]
    four = two[:-16] * _ODD[3] + two[16:]
    return _mixed(four[: len(data) - GRAM + 1] * _ODD[1] + m[32 : len(data) - GRAM + 33])


def _sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """The ``least`` (np.minimum or np.maximum) of each ``width`` values in a row."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    filled = np.full(rows * width, x[-1], x.dtype)
    filled[: len(x)] = x
    filled = filled.reshape(rows, width)
    ahead = least.accumulate(filled, axis=1).ravel()
    back = least.accumulate(filled[:, ::-1], axis=1)[:, ::-1].ravel()
    return least(back[:n], ahead[width - 1 : width - 1 + n])


class Windows:
    """Keys of all windows of some documents (binary arrays), laid out one after the other."""

    def __init__(self, texts: pa.Array, length: int):
        self.offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        base = self.offsets[0]
        self.data = np.frombuffer(texts.buffers()[2], np.uint8)[base : self.offsets[-1]] if texts.buffers()[2] else np.empty(0, np.uint8)
        self.offsets -= base
        self.length, self.keys, self.grams = length, np.empty(0, np.uint64), np.empty(0, np.uint64)
        if len(self.data) >= length:
            self.grams = gram_hashes(self.data)
            self.keys = _sliding(self.grams, length - GRAM + 1, np.minimum)
        sizes = np.diff(self.offsets)
        self.valid = np.zeros(len(self.keys) + 1, np.int32)  # starts from which a window stays within its document
        long = sizes >= length
        np.add.at(self.valid, self.offsets[:-1][long], 1)
        np.add.at(self.valid, self.offsets[1:][long] - length + 1, -1)
        self.valid = np.cumsum(self.valid[: len(self.keys)]).astype(bool)

    def key_counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys, the places whose gram is one, its segments, and the windows in them."""
        if not self.valid.any():
            return self.keys[:0], *[np.empty(0, np.int64)] * 3
        width = self.length - GRAM + 1
        # A place is one if the largest key of the windows over it is its own hash; invalid windows don't count.
        keys = np.where(self.valid, self.keys, np.uint64(0))
        padded = np.r_[np.zeros(width - 1, np.uint64), keys, np.zeros(width - 1, np.uint64)]
        found, places = np.unique(self.grams[_sliding(padded, width, np.maximum) == self.grams], return_counts=True)
        _, first, last, key = self.segments()
        at = np.searchsorted(found, key)
        return found, places, np.bincount(at, minlength=len(found)), np.bincount(at, last - first + 1, len(found)).astype(np.int64)

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, first start, last start within the document, key) of each run of windows of one key."""
        starts = np.flatnonzero(self.valid)
        if not len(starts):
            return (np.empty(0, np.int64),) * 3 + (self.keys[:0],)
        key = self.keys[starts]
        new = np.r_[True, (key[1:] != key[:-1]) | (starts[1:] != starts[:-1] + 1)]
        first = np.flatnonzero(new)
        count = np.diff(np.r_[first, len(starts)])
        pieces = -(-count // SEGMENT)  # long runs in pieces
        if (pieces > 1).any():
            step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = np.repeat(first, pieces) + step * SEGMENT
            count = np.diff(np.r_[first, len(starts)])
        a = starts[first]
        doc = np.searchsorted(self.offsets, a, side="right") - 1
        return doc, a - self.offsets[doc], a - self.offsets[doc] + count - 1, key[first]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a bounded size, but for single long texts."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column("data")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _TEXT_BYTES, side="right")))
            yield batch.slice(at, to - at)
            at = to


# ---------------------------------------------------------------- suffix arrays


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the end counts as smallest."""
    n = len(text)
    step = np.r_[np.diff(text.astype(np.int16)), -1]
    known = np.where(step != 0, np.arange(n), n - 1)
    return step[np.minimum.accumulate(known[::-1])[::-1]] > 0


def _append(sa: np.ndarray, place: np.ndarray, text: np.ndarray, suffixes: np.ndarray, way: int) -> None:
    """Put suffixes in this order at the ends of their buckets' lists, growing in direction ``way``."""
    chars = text[suffixes]
    order = np.argsort(chars, kind="stable")
    count = np.bincount(chars, minlength=256)
    rank = np.arange(len(chars)) - np.repeat(np.cumsum(count) - count, count)
    sa[place[chars[order]] + way * rank] = suffixes[order]
    place += way * count


def _induce(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes sorted, from leftmost-smaller ones in order: the larger ones bucket by bucket, then the smaller ones.

    Within a bucket, what a list brings forth is appended to other lists or itself, wave by wave, which is the order in
    which a scan would meet it.
    """
    n = len(text)
    count = np.bincount(text, minlength=256)
    end = np.cumsum(count)
    start = end - count
    sa = np.full(n, -1, np.int64)
    used = np.flatnonzero(count)

    by_char = np.searchsorted(text[lms], np.arange(257))  # lms is in order of its first characters
    head = start.copy()
    _append(sa, head, text, np.array([n - 1]), 1)  # before the end of the text
    for c in used:
        done = start[c]
        while done < head[c]:
            wave = sa[done : head[c]]
            done = head[c]
            wave = wave[wave > 0] - 1
            wave = wave[~smaller[wave]]
            if len(wave):
                _append(sa, head, text, wave, 1)
        wave = lms[by_char[c] : by_char[c + 1]]
        wave = wave[wave > 0] - 1
        if len(wave):
            _append(sa, head, text, wave, 1)
    tail = end - 1
    for c in used[::-1]:
        done = end[c] - 1
        while done > tail[c]:
            wave = sa[tail[c] + 1 : done + 1][::-1]
            done = tail[c]
            wave = wave[wave > 0] - 1
            wave = wave[smaller[wave]]
            if len(wave):
                _append(sa, tail, text, wave, -1)
        wave = sa[start[c] : head[c]][::-1]
        wave = wave[wave > 0] - 1
        wave = wave[smaller[wave]]
        if len(wave):
            _append(sa, tail, text, wave, -1)
    return sa


def _sorted_names(names: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a string of numbers in order of their first ``depth`` ones: ranks of doubled length, again and again."""
    rank, width = names.astype(np.int64), 1
    while True:
        after = np.zeros(len(rank), np.int64)
        after[:-width] = rank[width:] + 1 if width < len(rank) else 0
        pair = rank * (int(rank.max()) + 2) + after
        order = np.argsort(pair, kind="stable")
        ranks = np.cumsum(np.r_[0, np.diff(pair[order]) != 0])
        rank = np.empty_like(ranks)
        rank[order] = ranks
        width *= 2
        if width >= depth or ranks[-1] == len(rank) - 1 or width >= len(rank):
            return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of the bytes in order, as far as their first ``depth`` bytes tell."""
    if len(text) < 2:
        return np.arange(len(text))
    smaller = _types(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if not len(lms):
        return _induce(text, smaller, lms)
    # Any order within a character gives the substrings from one leftmost-smaller place to the next in order.
    rough = _induce(text, smaller, lms[np.argsort(text[lms], kind="stable")])
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]
    size = np.zeros(len(text), np.int64)
    size[lms] = np.diff(np.r_[lms, len(text)]) + 1  # the last one ends with the text
    a, b = ordered[:-1], ordered[1:]
    same = (size[a] == size[b]) & (a != lms[-1]) & (b != lms[-1])
    left, at = np.flatnonzero(same), 0
    while len(left):
        equal = text[a[left] + at] == text[b[left] + at]
        same[left[~equal]] = False
        at += 1
        left = left[equal]
        left = left[size[a[left]] > at]
    name = np.zeros(len(text), np.int64)
    name[ordered] = np.cumsum(np.r_[0, ~same])
    if not same.any():
        return _induce(text, smaller, ordered)
    # Two leftmost-smaller places are two bytes apart at least.
    return _induce(text, smaller, lms[_sorted_names(name[lms], depth // 2 + 1)])


def permuted_common_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """In text order: the suffix before each one in ``sa`` (-1 for the first), and how many bytes, up to ``most``, they share."""
    n = len(text)
    words = _words(np.r_[text, np.zeros(most + 16, np.uint8)], n + most)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    shared_bytes = np.zeros(n, np.int64)
    at, i = 0, np.flatnonzero(before >= 0)
    while len(i) and at < most:
        other = words[i + at] ^ words[before[i] + at]
        differs = other != 0
        # The lowest set bit is in the first byte that differs.
        low = other[differs] & (~other[differs] + np.uint64(1))
        shared_bytes[i[differs]] = at + np.bitwise_count(low - np.uint64(1)) // 8
        i, at = i[~differs], at + 8
    shared_bytes[i] = most
    rest = n - np.maximum(np.arange(n), before)  # neither may reach past the end
    return before, np.minimum(np.minimum(shared_bytes, most), np.where(before >= 0, rest, 0))


def repeated_windows(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment whether each of its windows occurs again in any of them, itself included."""
    text = np.frombuffer(b"\xff".join(segments), np.uint8)  # a byte that UTF-8 never has
    before, prefix = permuted_common_prefixes(text, suffix_array(text, length), length)
    found = prefix >= length
    found[before[found]] = True  # the suffix before it shares as much
    out, at = [], 0
    for segment in segments:
        out.append(found[at : at + len(segment) - length + 1])
        at += len(segment) + 1
    return out


# ---------------------------------------------------------------- Spark


_RANGE = "id bigint, hash bigint, first bigint, last bigint"


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(text).alias("hash"), F.encode(text, "UTF-8").alias("data"))


def repeated_keys(texts: DataFrame, length: int) -> DataFrame:
    """First pass: (key, segments, windows) of the keys that occur at more than one place, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            keys, *counts = Windows(batch.column("data"), length).key_counts()
            columns = [pa.array(keys.view(np.int64)), *(pa.array(c.astype(np.int64)) for c in counts)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "places", "segments", "windows"])

    counts = texts.select("data").mapInArrow(run, "key bigint, places bigint, segments bigint, windows bigint")
    counts = counts.groupBy("key").agg(*[F.sum(n).alias(n) for n in ("places", "segments", "windows")])
    return stored(counts.where("places > 1").drop("places"), "repeated-keys")


def _filter(keys: DataFrame, most_bits: int) -> np.ndarray:
    """A Bloom filter of keys as an array of words of 64 bits, of bounded size."""
    bits = min(most_bits, 1 << max(16, (16 * max(1, keys.count()) - 1).bit_length()))
    slots = F.explode(F.array(*[s.bitwiseAND(F.lit(bits - 1)) for s in (F.col("key"), F.shiftrightunsigned("key", 32))]))
    words = keys.select(slots.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word"))
    one = F.element_at(F.array(*[F.lit(1 << b if b < 63 else -1 << 63) for b in range(64)]), (F.col("slot").bitwiseAND(F.lit(63)) + 1).cast("int"))
    rows = words.agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def _in_filter(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    hit, mask = np.ones(len(keys), bool), np.uint64(len(table) * 64 - 1)
    for slot in (keys & mask, (keys >> np.uint64(32)) & mask):
        hit &= (table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0
    return hit


def _hot_keys(keys: DataFrame, hot: int) -> np.ndarray:
    """The keys whose segments are too many for one shard, sorted; of all of them at most a millionth."""
    segments, windows = keys.agg(*[F.coalesce(F.sum(n), F.lit(0)) for n in ("segments", "windows")]).first()
    many = (F.col("segments") > max(hot, segments // 1_000_000)) | (F.col("windows") > max(HOT_WINDOWS, windows // 1_000_000))
    return np.sort(keys.where(many).select("key").toArrow().column("key").to_numpy().view(np.uint64))


def _is_among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    return np.isin(keys, some) if len(some) else np.zeros(len(keys), bool)


def segments(texts: DataFrame, keys: DataFrame, length: int, hot_keys: np.ndarray) -> DataFrame:
    """Second pass: (key, segment, id, hash, first, last) of segments whose key may be repeated, but for ``hot_keys``."""
    table = texts.sparkSession.sparkContext.broadcast(_filter(keys, FILTER_BITS))
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = Windows(batch.column("data"), length)
            doc, first, last, key = found.segments()
            hit = _in_filter(table.value, key) & ~_is_among(key, hot_keys)
            doc, first, last, key = doc[hit], first[hit], last[hit], key[hit]
            base, ids, hashes = found.offsets[doc], batch.column("id"), batch.column("hash")
            data = found.data.tobytes()
            for at in range(0, len(key), 20_000):
                k, o, d, a, b = (x[at : at + 20_000] for x in (key.view(np.int64), base, doc, first, last))
                rows = [data[o_ + a_ : o_ + b_ + length] for o_, a_, b_ in zip(o.tolist(), a.tolist(), b.tolist())]
                of = pa.array(d)
                columns = [pa.array(k), pa.array(rows, kinds[1]), ids.take(of), hashes.take(of), pa.array(a), pa.array(b)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "segment", "id", "hash", "first", "last"])

    return texts.mapInArrow(run, f"key bigint, segment binary, {_RANGE}")


def pieces(texts: DataFrame, length: int, hot_keys: np.ndarray) -> DataFrame:
    """The segments of ``hot_keys`` in pieces: (key, digest, segment, id, hash, first, last), stored.

    A piece ends where the hash of a window's first gram says so, so what a passage has inside falls into the same
    pieces wherever the passage stands, and only the pieces at its edges differ.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = Windows(batch.column("data"), length)
            doc, first, last, key = found.segments()
            hit = _is_among(key, hot_keys)
            ids, hashes, data = batch.column("id"), batch.column("hash"), found.data.tobytes()
            rows: list[tuple] = []
            for d, a, b, k in zip(*(x[hit].tolist() for x in (doc, first, last, key.view(np.int64)))):
                base = int(found.offsets[d])
                cuts = np.flatnonzero(found.grams[base + a + 1 : base + b + 1] % np.uint64(PIECE) == 0) + a + 1
                for start, end in zip([a, *cuts.tolist()], [*cuts.tolist(), b + 1]):
                    piece = data[base + start : base + end - 1 + length]
                    rows.append((k, xxhash.xxh3_128_digest(piece), piece, d, start, end - 1))
            for at in range(0, len(rows), 20_000):
                k, mark, piece, d, a, b = zip(*rows[at : at + 20_000])
                of = pa.array(d)
                columns = [pa.array(k), pa.array(mark, pa.binary()), pa.array(piece, pa.binary()), ids.take(of), hashes.take(of), pa.array(a, pa.int64()), pa.array(b, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "digest", "segment", "id", "hash", "first", "last"])

    return stored(texts.mapInArrow(run, f"key bigint, digest binary, segment binary, {_RANGE}"), "hot-pieces")


def _window_rows(distinct: DataFrame, length: int) -> DataFrame:
    """(digest, id, hash, first, last) of every window of distinct pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts = (pc.binary_length(part.column("segment")).to_numpy() - length + 1).tolist()
                marks = [
                    xxhash.xxh3_128_digest(piece[i : i + length])
                    for piece, n in zip(part.column("segment").to_pylist(), counts) for i in range(n)
                ]
                of = pa.array(np.repeat(np.arange(len(counts)), counts))
                starts = part.column("first").take(of).to_numpy() + np.concatenate([np.arange(n) for n in counts])
                columns = [pa.array(marks, pa.binary()), *(part.column(n).take(of) for n in ("id", "hash")), pa.array(starts), pa.array(starts)]
                yield pa.RecordBatch.from_arrays(columns, names=["digest", "id", "hash", "first", "last"])

    return distinct.select("segment", "id", "hash", "first").mapInArrow(run, f"digest binary, {_RANGE}")


def hot_ranges(texts: DataFrame, length: int, hot_keys: np.ndarray, hot: int) -> tuple[DataFrame, DataFrame]:
    """What ``hot_keys`` have: ranges of starts that are known to be repeated, and segments for shards.

    Equal pieces are counted by their digest, and those that occur again are repeated throughout.  One of each kind is
    left; the pieces of a key that then has few enough go to its shard.  Of the others single windows are counted.
    """
    cut = pieces(texts, length, hot_keys)
    one = F.min(F.struct("id", "hash", "first", "last", "segment")).alias("one")
    distinct = stored(cut.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("size"), one).select("key", "digest", "size", "one.*"), "distinct-pieces")
    again = stored(distinct.where("size > 1").select("digest", "size"), "repeated-pieces")
    whole = shared.attach(cut.select("digest", "id", "hash", "first", "last"), again, "digest", "size", cut.count()).drop("digest")
    left = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    still = distinct.join(F.broadcast(left.where(F.col("n") > hot).select("key")), "key", "left_semi")  # at most as many as hot keys
    rest = distinct.join(F.broadcast(left.where(F.col("n") <= hot).select("key")), "key", "left_semi")
    windows = stored(_window_rows(still, length), "hot-windows")
    twice = stored(windows.groupBy("digest").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "repeated-windows")
    single = shared.attach(windows, twice, "digest", "size", windows.count()).drop("digest")
    return whole.unionByName(single), rest.select("key", "segment", "id", "hash", "first", "last")


def ranges(parts: DataFrame, length: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, hash, first, last): starts of repeated windows, from segments dealt out by key and sorted."""
    names = ["id", "hash", "first", "last"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 4
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        shard: list[tuple] = []  # (segment, id, hash, first), the place null if the segment is known to be repeated
        group: list[tuple] = []  # of the key at hand
        last_key = last_segment = None

        def flush() -> None:
            for (_, i, h, first), hit in zip(shard, repeated_windows([s for s, *_ in shard], length)):
                if first is not None and hit.any():
                    edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
                    out.extend((i, h, first + a, first + b - 1) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()))
            shard.clear()

        def close() -> None:
            """The key's segments are complete: a single known one has nothing left to find."""
            if len(group) > 1 or (group and group[0][3] is not None and len(group[0][0]) >= length):
                shard.extend(g for g in group if len(g[0]) >= length)
            group.clear()

        size = 0
        for batch in batches:
            for key, segment, i, h, first, last in zip(*(batch.column(n).to_pylist() for n in range(6))):
                if key != last_key:
                    size += sum(len(g[0]) for g in group)
                    close()
                    if size >= shard_bytes:
                        flush()
                        size = 0
                    last_segment = None
                if segment == last_segment:
                    if group[-1][3] is not None:
                        _, i0, h0, first0 = group[-1]
                        out.append((i0, h0, first0, first0 + last - first))
                        group[-1] = (segment, None, None, None)
                    out.append((i, h, first, last))
                else:
                    group.append((segment, i, h, first))
                last_key, last_segment = key, segment
            if out:
                yield batch_of(out)
                out.clear()
        close()
        flush() if shard else None
        yield batch_of(out)

    return parts.mapInArrow(run, _RANGE)


def joined_ranges(found: DataFrame) -> DataFrame:
    """Ranges of starts that overlap or follow each other as one."""
    document = Window.partitionBy("id", "hash").orderBy("first", "last")
    before = F.max("last").over(document.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("first") <= before + 1, 0).otherwise(1)).over(document.rowsBetween(Window.unboundedPreceding, 0))
    rows = found.distinct().withColumn("island", island)
    return rows.groupBy("id", "hash", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))


def _kept(rows: DataFrame, length: int) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) from rows (id, data, starts of repeated windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, data, found in zip(*(batch.column(n).to_pylist() for n in ("id", "data", "found"))):
                kept, at, removed, spans, end = hashlib.sha256(), 0, 0, 0, -1
                for first, last in sorted((r["first"], r["last"]) for r in found):
                    if first > end:  # not next to what is removed before it
                        spans += 1
                        kept.update(data[at:first])
                    begin = max(first, at)
                    at = end = max(at, last + length)
                    removed += at - begin
                kept.update(data[at:])
                out.append((i, len(data), removed, spans, kept.hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return rows.select("id", "data", "found").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.  ``length`` is GRAM bytes at least."""
    texts = _texts(docs)
    keys = repeated_keys(texts, length)
    hot_keys = _hot_keys(keys, hot)
    parts, more = segments(texts, keys, length, hot_keys), None
    if len(hot_keys):
        more, rest = hot_ranges(texts, length, hot_keys, hot)
        parts = parts.unionByName(rest)
    found = ranges(parts.repartition("key").sortWithinPartitions("key", "segment"), length, shard_bytes)
    found = joined_ranges(found if more is None else found.unionByName(more)).groupBy("id", "hash")
    found = stored(found.agg(F.collect_list(F.struct("first", "last")).alias("found")), "repeated-ranges")
    own = [F.coalesce("id", F.lit(-1 << 63)), F.col("hash")]
    bits = shared.filter_bits(found.count())
    marks = found.select(F.explode(F.array(*shared.slots(own, bits))).alias("slot"))
    probed = shared.maybe_in(texts, shared.filter_table(marks, "ranges-filter"), own, bits, "some")
    # Only documents that may have repeats meet their ranges.
    some = probed.where("some").drop("some")
    joined = some.join(found.withColumnRenamed("id", "found_id"), F.col("id").eqNullSafe(F.col("found_id")) & (some["hash"] == found["hash"]), "left")
    none = F.array().cast("array<struct<first: bigint, last: bigint>>")
    touched = _kept(joined.select("id", "data", F.coalesce("found", none).alias("found")), length)
    size = F.octet_length("data").cast("bigint")
    zero = F.lit(0).cast("bigint")
    whole = probed.where("not some").select(
        F.col("id").alias("doc_id"), size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("data", 256).alias("kept_sha256")
    )
    return whole.unionByName(touched)
