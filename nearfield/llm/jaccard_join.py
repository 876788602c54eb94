"""Exact Jaccard self-join of shingle sets by PartEnum signatures, and its components.

A document's set is its distinct WORDS-word shingles (words as in ``near_copies``; with fewer words the whole sequence is
one; without words, or null, it is empty and links with nothing).  Two sets link when their Jaccard similarity is at least
``percent`` of 100.  Equal sets are one node, known by a 64-bit hash; shingles are known by their XXH64.

Signatures: sets of a and b shingles that link differ in at most (a + b)(100 - p) / (100 + p) of them.  Sizes are cut into
groups that overlap so far that any two sets that may link share one, and each group has its own bound k on the
difference.  The domain of shingles is cut by hash into k // 2 + 1 first-level parts, one of which then has at most one
difference, and each of these into three, of which all subsets of two are enumerated: two sets that link agree wholly in
some subset, whose sum of hashes is the signature.  Every pair is decided on the whole sets afterwards.

Before whole sets are sent to each other, their marks are: MARK bits, each of which tells whether the set's shingles in its
share of the hashes are even in number.  Two marks differ in no more bits than their sets do in shingles, so a pair whose
marks differ in more than the bound doesn't link.  Sets of nodes that no mark leaves a partner stay where they are.

Only keys that two different nodes share are dealt out.  Within a key, all nodes are held against a single one first (a
star), which joins groups of copies without squares; nodes of one component need no further look.  Keys that stay open
are settled pair by pair if they have at most SMALL nodes.  The nodes of larger ones are keyed anew by the prefixes of
their sets, rarest shingles first: two sets that share c shingles have one in common among the first a - c + 1 and
b - c + 1 of them, in any one order.  What common passages or near copies make equal comes last in that order, so such
keys are as small as the differences allow; any that is still large is decided in blocks, inside tasks: first on marks of
SHORT bits, then on whole marks, then on the sets of those nodes that may have a partner in their block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm import shared
from nearfield.llm.near_copies import Joined, Overlaps, shingles
from nearfield.session import stored

WORDS, PERCENT = 3, 90
#: A group of sizes reaches this much further than the one before.
BAND = 1.25
#: Nodes of an open key that are paired with each other at most; sides of a block.
SMALL, BLOCK = 16, 512
#: Slots of the table of frequencies that orders shingles (8 MB), and the filter of shared keys (32 MB at most).
SLOTS = 1 << 20
FILTER_BITS = 1 << 28
#: Nodes that are held against one other in one task.
SIDE = 1024
#: Bits of a mark, a power of two.
MARK = 2048
#: Up to this share of repeated sets they are merged wherever sets are read, else once, into a table of its own.
FEW = 1 / 16
#: Bits of a mark that is sent to every block, a power of two; nodes whose marks are held against a block's at once.
SHORT, AT_ONCE = 512, 64

_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> _U(32))


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets link; empty ones never do."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    place = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[place] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def largest(size: int, percent: int) -> int:
    """The size of the largest set that may link with one of ``size``."""
    return 100 * size // percent


def difference(sizes: int, percent: int) -> int:
    """The most shingles in which two linked sets may differ whose sizes sum to ``sizes``."""
    return sizes * (100 - percent) // (100 + percent)


def size_groups(size: int, percent: int) -> list[tuple[int, int]]:
    """(number, bound on the difference) of the groups that a set of ``size`` belongs to."""
    out, number, low = [], 0, 1
    while low <= size:
        high = max(low, int(low * BAND))  # the smaller set of a pair has low to high shingles
        if size <= largest(high, percent):
            out.append((number, difference(high + largest(high, percent), percent)))
        number, low = number + 1, high + 1
    return out


def signatures(found: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The signatures of a sorted set; none where only an equal set can link."""
    out = []
    for number, k in size_groups(len(found), percent) if len(found) else []:
        if not k:
            continue
        parts = k // 2 + 1
        hashes = mixed(found + _U(number))
        cell = (mixed(hashes) % _U(3 * parts)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        sums = np.r_[_U(0), np.cumsum(hashes[order], dtype=np.uint64)]
        edges = np.searchsorted(cell[order], np.arange(3 * parts + 1))
        each = (sums[edges[1:]] - sums[edges[:-1]]).reshape(parts, 3)
        subsets = each.sum(axis=1, dtype=np.uint64)[:, None] - each  # all but one of the three
        places = np.arange(3 * parts, dtype=np.uint64) + (_U(number) << _U(40))
        out.append(mixed(subsets.ravel() ^ mixed(places + _U(1))))
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def mark(found: np.ndarray, bits: int = MARK) -> bytes:
    """The parity of a set's shingles in each of ``bits`` shares of the hashes."""
    counts = np.bincount((found & _U(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _sketches(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, hash, n_shingles, node, keys) for rows (doc_id, hash, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, keys = [], [], []
            for text in batch.column("text"):
                found = shingles(text.as_py(), words)
                sizes.append(len(found))
                nodes.append(_node(found))
                keys.append(signatures(found, percent).tobytes())
            made = [pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), *made], names=["doc_id", "hash", "n_shingles", "node", "keys"])

    return texts.mapInArrow(run, "doc_id bigint, hash bigint, n_shingles bigint, node bigint, keys binary")


def _node(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64))


def _shared_keys(firsts: DataFrame) -> DataFrame:
    """Stored (key, node) of the keys that several nodes have; ``firsts`` (node, keys) has each node once.

    Keys are counted without their nodes; a filter of the shared ones then picks the rows that are dealt out.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                flat = np.frombuffer(b"".join(batch.column("keys")[at : at + 1024].to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat)], names=["key"])

    counts = firsts.select("keys").mapInArrow(keys, "key bigint").groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    many = stored(counts.where("size > 1"), "shared-keys")
    total, rows = many.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    bits = min(FILTER_BITS, 1 << max(16, (16 * max(1, total) - 1).bit_length()))
    words = many.select(F.explode(F.array(*[s.bitwiseAND(F.lit(bits - 1)) for s in (F.col("key"), F.shiftrightunsigned("key", 32))])).alias("slot"))
    one = F.element_at(F.array(*[F.lit(1 << b if b < 63 else -1 << 63) for b in range(64)]), (F.col("slot").bitwiseAND(F.lit(63)) + 1).cast("int"))
    words = words.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()  # bounded by FILTER_BITS
    table = np.zeros(bits // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    sent = firsts.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit, mask = sent.value, _U(bits - 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                binary = part.column("keys").to_pylist()
                flat = np.frombuffer(b"".join(binary), np.uint64)
                nodes = np.repeat(part.column("node").to_numpy(), [len(b) // 8 for b in binary])
                hit = np.ones(len(flat), bool)
                for slot in (flat & mask, (flat >> _U(32)) & mask):
                    hit &= (bit[slot >> _U(6)] >> (slot & _U(63))) & _U(1) != 0
                yield pa.RecordBatch.from_arrays([pa.array(flat[hit].view(np.int64)), pa.array(nodes[hit])], names=["key", "node"])

    some = stored(firsts.select("node", "keys").mapInArrow(known, "key bigint, node bigint"), "maybe-shared")
    return stored(shared.attach(some, many, "key", "size", rows).select("key", "node"), "candidates")


def _sets(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, found, n, mark, short), from stored tables: the sets of ``wanted`` (doc_id, hash) and of few others.

    No text leaves its place, and a set only if a second row has it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [shingles(t.as_py(), words) for t in part.column("text")]
                made = [pa.array([_node(f) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())]
                made += [pa.array([len(f) for f in found], pa.int64())]
                made += [pa.array([mark(f, bits) for f in found], pa.binary()) for bits in (MARK, SHORT)]
                yield pa.RecordBatch.from_arrays(made, names=["node", "found", "n", "mark", "short"])

    picked = _maybe_of(texts, wanted, [F.coalesce("doc_id", F.lit(-1 << 63)), F.col("hash")], "candidate-filter")
    made = stored(picked.select("text").mapInArrow(run, "node bigint, found binary, n bigint, mark binary, short binary"), "candidate-sets")
    again = stored(made.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "repeated-sets")
    repeats = again.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if not repeats:
        return made
    single, several = (_maybe_of(made, again, [F.col("node")], "repeated-filter", maybe) for maybe in (False, True))
    one = several.groupBy("node").agg(F.any_value(F.struct("found", "n", "mark", "short")).alias("set")).select("node", "set.*")
    sets = single.unionByName(one)
    return sets if repeats <= FEW * made.count() else stored(sets, "single-sets")


def _maybe_of(rows: DataFrame, wanted: DataFrame, keys: list[Column], name: str, maybe: bool = True) -> DataFrame:
    """``rows`` whose keys may be among those of stored ``wanted``, or surely are not; none leaves its place."""
    bits = shared.filter_bits(wanted.count())
    marks = wanted.select(F.explode(F.array(*shared.slots(keys, bits))).alias("slot"))
    probed = shared.maybe_in(rows, shared.filter_table(marks, name), keys, bits, "maybe")
    return probed.where(F.col("maybe") == F.lit(maybe)).drop("maybe")


def _likely(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` (key, ...) without most of those whose key is not in stored ``keys``; a filter of all keys is broadcast."""
    return _maybe_of(rows, keys, [F.col("key")], "key-filter")


def _with_sets(rows: DataFrame, sets: DataFrame, node: str) -> DataFrame:
    """Stored ``rows`` with ``found``, the set of their ``node``; other sets stay where they are."""
    sets = sets.select(F.col("node").alias(node), "found")
    if rows.count() <= shared.BROADCAST_ROWS:
        return sets.join(F.broadcast(rows), node)
    return rows.join(_maybe_of(sets, rows, [F.col(node)], "sent-filter"), node)


def _maybe_linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Stored pairs of stored ``pairs`` (a, b) whose marks allow a link; ``a`` may be in very many of them."""
    marks = sets.select("node", "n", "mark")
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("size"))
    a_rows = stored(sizes.join(marks.toDF("a", "a_n", "a_mark"), "a"), "pair-marks")
    b_rows = stored(pairs.join(marks.withColumnRenamed("node", "b"), "b"), "marked-pairs")
    rows = shared.attach(b_rows, a_rows, "a", "size", b_rows.count()).select("a", "b", "n", "a_n", "mark", "a_mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for n in ("a_mark", "mark"))
                sizes = batch.column("n").to_numpy() + batch.column("a_n").to_numpy()
                near = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= sizes * (100 - percent) // (100 + percent)
                yield batch.select(["a", "b"]).filter(pa.array(near))

    return stored(rows.mapInArrow(run, "a bigint, b bigint"), "maybe-linked")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Stored pairs (a, b) that link; ``a`` may be in very many of them, so its set goes to each part of its partners."""
    pairs = _maybe_linked(stored(pairs, "pairs"), sets, percent)
    if pairs.isEmpty():
        return pairs
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("size"))
    sizes = stored(sizes.withColumn("parts", F.ceil(F.col("size") / SIDE).cast("int")), "pair-sizes")
    dealt = shared.attach(pairs, sizes, "a", "size", pairs.count())
    dealt = stored(dealt.select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")), "dealt-pairs")
    b_rows = _with_sets(dealt, sets, "b").select("a", "part", F.lit(True).alias("asks"), "b", "found")
    a_rows = _with_sets(sizes, sets, "a")
    a_rows = a_rows.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("asks"), F.col("a").alias("b"), "found")
    rows = b_rows.unionByName(a_rows).repartition("a", "part").sortWithinPartitions("a", "part", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.empty(0, np.uint64)
        for batch in batches:
            out: list[tuple[int, int]] = []
            for a, asks, b, found in zip(*(batch.column(n) for n in ("a", "asks", "b", "found"))):
                one = np.frombuffer(found.as_py(), np.uint64)
                if not asks.as_py():
                    mine = one
                elif similar(mine, one, percent):
                    out.append((a.as_py(), b.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return stored(rows.mapInArrow(run, "a bigint, b bigint"), "links")


def _rarest_first(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, node) for ``nodes`` (node): keys of the rarest shingles of each set; two that link share one.

    A set has a prefix for every class of sizes that a partner may have: so many shingles as the two together can lack,
    and one more.  A key is a shingle with both classes.
    """
    own = stored(nodes.join(sets.select("node", "found"), "node"), "open-sets")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for found in batch.column("found"):
                np.add.at(total, (mixed(np.frombuffer(found.as_py(), np.uint64)) % _U(SLOTS)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["slot", "n"])

    rows = own.select("found").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most SLOTS
    frequency = np.zeros(SLOTS, np.int64)
    frequency[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    sent = nodes.sparkSession.sparkContext.broadcast(frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, found in zip(batch.column("node").to_pylist(), batch.column("found")):
                found = np.frombuffer(found.as_py(), np.uint64)
                hashes = mixed(found)
                order = np.lexsort((hashes, sent.value[(hashes % _U(SLOTS)).astype(np.int64)]))
                keys = [mixed(hashes[order[:length]] + _U(tag)) for tag, length in prefixes(len(found), percent)]
                keys = np.unique(np.concatenate(keys)).view(np.int64) if keys else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), node))], names=["key", "node"])

    return own.mapInArrow(run, "key bigint, node bigint")


def size_class(size: int) -> tuple[int, int, int]:
    """(number, least size, width) of the class of a size: single sizes first, then a hundredth or so of the size."""
    width = max(1, 1 << max(0, size.bit_length() - 8))
    return (width.bit_length() << 32) + size // width, size // width * width, width


def prefixes(size: int, percent: int) -> Iterator[tuple[int, int]]:
    """(tag, length) of the prefixes of a set: one for each class of partners."""
    mine, low, _ = size_class(size)
    other = -(-percent * size // 100)
    while other <= largest(size, percent):
        number, least, width = size_class(other)
        both = -(-percent * (size + max(least, -(-percent * size // 100))) // (100 + percent))  # shingles that two linked sets share
        yield (min(mine, number) * 0x9E3779B97F4A7C15 + max(mine, number)) & (1 << 64) - 1, size - both + 1
        other = least + width


def _by_block(dealt: DataFrame) -> DataFrame:
    """Blocks one after the other, those that ask first."""
    return dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", F.desc("asks"))


def _dealt(rows: DataFrame, stats: DataFrame, total: int) -> DataFrame:
    """Rows (key, a, b, asks, node, root): the nodes of one key meet in blocks of about BLOCK nodes of either side.

    Those that ask are not of the key's largest group.
    """
    parts = stats.withColumn("a_parts", F.ceil((F.col("size") - F.col("most")) / BLOCK).cast("int"))
    parts = parts.withColumn("b_parts", F.ceil(F.col("size") / BLOCK).cast("int")).drop("most")
    dealt = shared.attach(rows, parts, "key", "size", total).withColumn("minor", F.col("root") != F.col("large"))
    part = lambda n: F.pmod(F.xxhash64("node", F.lit(n)), F.col(n)).cast("int").alias(n[0])
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(n[0])
    left = dealt.where("minor").select("key", part("a_parts"), all_("b_parts"), F.lit(True).alias("asks"), "node", "root")
    return left.unionByName(dealt.select("key", all_("a_parts"), part("b_parts"), F.lit(False).alias("asks"), "node", "root"))


def _asked(dealt: DataFrame, sets: DataFrame, kind: str, percent: int) -> DataFrame:
    """Stored rows of ``dealt`` (key, a, b, asks, node, root) that marks of a ``kind`` allow a link in their block, of two roots.

    No row stands for a pair.
    """
    names = ["key", "a", "b", "asks", "node", "root"]
    groups = _by_block(dealt.join(sets.select("node", "n", F.col(kind).alias("mark")), "node").select(*names, "n", "mark"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, mine, hit = None, [], np.empty(0, bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in [*names, "n"]}
            marks = np.frombuffer(b"".join(batch.column("mark").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            place = np.stack([own[n].astype(np.int64) for n in names[:4]])
            edges = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            out = []
            for first, last in zip(edges, edges[1:]):
                if (now := tuple(place[:3, first].tolist())) != group:
                    group, mine, hit = now, [], np.empty(0, bool)
                if place[3, first]:
                    mine.append((own["node"][first:last], own["root"][first:last], own["n"][first:last], marks[first:last]))
                    continue
                if not mine:
                    continue
                mine = [tuple(np.concatenate(column) for column in zip(*mine))]  # whole by now
                nodes, roots, sizes, theirs = mine[0]
                hit = hit if len(hit) else np.zeros(len(nodes), bool)
                for at in range(first, last, AT_ONCE):
                    to = slice(at, min(last, at + AT_ONCE))
                    apart = np.bitwise_count(theirs[:, None] ^ marks[None, to]).sum(axis=2, dtype=np.int64)
                    near = (apart <= (sizes[:, None] + own["n"][to]) * (100 - percent) // (100 + percent)) & (roots[:, None] != own["root"][to])
                    new = near.any(axis=1) & ~hit
                    hit |= new
                    for asks, one, root in ((True, nodes[new], roots[new]), (False, own["node"][to][near.any(axis=0)], own["root"][to][near.any(axis=0)])):
                        out.append([*(np.full(len(one), x) for x in (*now, asks)), one, root])
            if out:
                kinds = (np.int64, np.int32, np.int32, bool, np.int64, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(k)) for c, k in zip(zip(*out), kinds)], names=names)

    return stored(groups.mapInArrow(run, "key bigint, a int, b int, asks boolean, node bigint, root bigint"), f"asked-by-{kind}")


def _blocks(rows: DataFrame, sets: DataFrame, stats: DataFrame, total: int, percent: int) -> DataFrame:
    """Stored links (a, b) of rows (key, node, root) under one key and of two roots, decided block by block in tasks.

    A block gives at most one link for each of its nodes.
    """
    asked = _dealt(rows, stats, total)
    for kind in ("short", "mark"):
        asked = _asked(asked, sets, kind, percent)
    groups = _by_block(_with_sets(asked, sets, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, mine, index, joined = None, [], None, Joined()
        for batch in batches:
            out: list[tuple[int, int]] = []
            for key, a, b, asks, node, root, found in zip(*(batch.column(n).to_pylist() for n in ("key", "a", "b", "asks", "node", "root", "found"))):
                if (key, a, b) != group:
                    group, mine, index, joined = (key, a, b), [], None, Joined()
                one = np.frombuffer(found, np.uint64)
                if asks:
                    mine.append((node, root, one))
                elif mine:
                    index = index or Overlaps([m[2] for m in mine])
                    out += [(mine[i][0], node) for i in index.similar(one, percent).tolist() if mine[i][1] != root and joined.add(mine[i][0], node)]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return stored(groups.mapInArrow(run, "a bigint, b bigint").distinct(), "block-links")


def _open(rows: DataFrame, roots: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored rows (key, node, root) of the keys with nodes of several roots; their (key, root, node); (key, size, most, large)."""
    rows = rows.select("key", "node")
    rows = rows.withColumn("root", F.col("node")) if roots is None else rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = stored(rows.select("key", "node", "root"), "rooted")
    if roots is None:  # each node is a group
        groups = rows.select("key", "root", F.lit(1).alias("n"), F.xxhash64("node").alias("same"))
    else:
        groups = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("same"))
    large = F.max(F.struct("n", "root")).getField("root").alias("large")
    stats = groups.groupBy("key").agg(F.sum("n").alias("size"), F.max("n").alias("most"), large, F.bit_xor("same").alias("same")).where("most < size")
    # Keys with the same nodes are one.
    stats = stats.groupBy("size", "same").agg(F.min(F.struct("key", "most", "large")).alias("s")).select("s.*", "size")
    stats = stored(stats, "open-keys")
    rows = stored(_likely(rows, stats).join(stats.select("key"), "key", "left_semi"), "open-rows")
    return rows, rows if roots is None else rows.groupBy("key", "root").agg(F.min("node").alias("node")), stats


def _pairs_of_small(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Pairs (a, b) of two roots within keys of at most SMALL nodes."""
    few = rows.join(stats.where(F.col("size") <= SMALL).select("key"), "key")
    pairs = few.select("key", F.col("node").alias("a"), F.col("root").alias("a_root")).join(few, "key")
    return pairs.where("a < node and a_root <> root").select("a", F.col("node").alias("b")).distinct()


def links(candidates: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) whose components are those of all links between nodes of one key of stored ``candidates`` (key, node).

    Components are made once for the keys of either kind, after the star; what small keys add later is only returned.
    """
    found = candidates.sparkSession.createDataFrame([], "a bigint, b bigint")
    keys, roots = candidates, None
    for anew in (False, True):
        rows, groups, stats = _open(keys, roots)
        total = rows.count()
        if not total:
            return found
        # One node against all others of its key; by a hash, so that keys of much the same nodes choose the same one.
        other = groups.join(stats.select("key", "large"), "key").where("root <> large")
        other = other.groupBy("key").agg(F.min(F.struct(F.xxhash64("node"), "node", "root")).alias("a"))
        stars = stats.select("key", "size").join(other, "key").select("key", "size", F.col("a.node").alias("a"), F.col("a.root").alias("a_root"))
        pairs = shared.attach(rows, stored(stars, "stars"), "key", "size", total).where("root <> a_root")
        found = found.unionByName(_linked(pairs.select("a", F.col("node").alias("b")).distinct(), sets, percent))
        roots = shared.components(found)
        rows, groups, stats = _open(rows, roots)
        found = found.unionByName(_linked(_pairs_of_small(rows, stats), sets, percent))
        stats = stored(stats.where(F.col("size") > SMALL), "large-keys")
        rows = stored(rows.join(stats.select("key"), "key", "left_semi"), "large-rows")
        total = rows.count()
        if not total:
            return found
        if anew:
            return found.unionByName(_blocks(rows, sets, stats, total, percent))
        made = stored(_rarest_first(rows.select("node").distinct(), sets, percent), "prefix-keys")
        many = stored(made.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared-prefixes")
        keys = stored(shared.attach(_likely(made, many), many, "key", "size", made.count()).select("key", "node"), "candidates")
    raise AssertionError


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable over links, or its own).

    Rows without an id belong to the component of their set (null if no row with an id is in it).  Rows with one id are
    documents each; one without links has its own id.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("hash", F.xxhash64("text"))
    marks = stored(_sketches(texts, words, percent).withColumn("row", F.monotonically_increasing_id()), "sketches")
    total, filled = marks.count(), marks.where("n_shingles > 0")
    first = F.min(F.struct("row", "doc_id", "hash")).alias("first")
    nodes = stored(filled.groupBy("node").agg(F.min("doc_id").alias("least"), first, F.count(F.lit(1)).alias("size")), "nodes")
    several = nodes.where("size > 1").select("node", "size", F.col("first.row").alias("first"))
    copies = shared.attach(filled.select("row", "node"), stored(several, "several"), "node", "size", total)
    firsts = shared.without(filled.select("row", "node", "keys"), stored(copies.where("row <> first").select("row"), "copies"), "row")
    candidates = _shared_keys(firsts.where(F.octet_length("keys") > 0))
    wanted = candidates.select("node").distinct().join(nodes, "node").select("first.doc_id", "first.hash")
    wanted = stored(wanted, "wanted")
    roots = shared.components(links(candidates, _sets(texts, wanted, words), percent))
    groups = stored(nodes.join(roots, "node", "left").select("node", "least", "size", F.coalesce("root", "node").alias("root")), "rooted-nodes")
    least = groups.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = shared.attach(groups, stored(least, "components"), "root", "n", groups.count()).select("node", "size", "component_id")
    known = shared.attach(filled.select("doc_id", "n_shingles", "node"), stored(named, "named"), "node", "size", total)
    empty = marks.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return known.select("doc_id", "n_shingles", "component_id").unionByName(empty)
