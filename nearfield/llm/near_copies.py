"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of LEAST or more, transitively.

Words and shingles are those of ``simhash``; repeats don't count.  Texts of one set are one node.  First come the pairs that
covering SimHash links (``simhash.links``, the operator of op10).  Its radius finds near equal texts without a miss, but
few of a similarity near LEAST, so for what it leaves unlinked nodes that share one of
BANDS keys, each made of BAND_ROWS MinHash values, are candidates: a pair of similarity 0.8 shares none with a chance of
7e-5.  Candidates are linked only if their whole sets are similar enough.  Within a key all pairs are decided, save those
that are linked already and those whose one-byte MinHash values agree in under AGREE of all places (chance 1e-6 at 0.8):
first against a few single nodes, which joins groups of copies without squares, then what is left: keys of at most SMALL
nodes give their pairs, larger ones are decided on the whole sets in blocks, inside tasks, which give only such links as
join something; so no row stands for a pair of a large group.

Of each group one row stays, that of the smallest id (a null id loses to any other, ties to the row that is read first).
Texts without words, or null, are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm import shared, simhash
from nearfield.session import settings, stored

WORDS, SEED = 5, 42
LEAST = 0.8
BANDS, BAND_ROWS = 24, 5
#: Of the BANDS * BAND_ROWS bytes, those that have to agree.
AGREE = 73
STARS = 3
#: Nodes of an open key whose pairs become rows, at most; sides of a block.
SMALL, BLOCK = 16, 512
#: Nodes that are held against one other in one task.
SIDE = 1024
_CHUNK = 2048  # shingles hashed at once


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct XXH64 of the shingles, sorted."""
    return np.unique(simhash.shingle_hashes(text, words)).astype(np.uint64)


def minima(found: np.ndarray) -> np.ndarray:
    """BANDS * BAND_ROWS MinHash values of a set."""
    draw = np.random.default_rng(SEED)
    flips, factors = (draw.integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64) for _ in range(2))
    out = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _CHUNK):
        mixed = (found[at : at + _CHUNK, None] ^ flips) * (factors | np.uint64(1))
        out = np.minimum(out, mixed.min(axis=0))
    return out


def similar(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least ``least``."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    place = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[place] == a).sum())
    return both >= least * (len(a) + len(b) - both) - 1e-9


class Overlaps:
    """Some sets by their shingles, to hold another set against all of them at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.shingles, self.owners = flat[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def both(self, one: np.ndarray) -> np.ndarray:
        """How many shingles each of the sets has in common with ``one``."""
        first = np.searchsorted(self.shingles, one)
        size = np.searchsorted(self.shingles, one, side="right") - first
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return np.bincount(self.owners[at], minlength=len(self.sizes))

    def similar(self, one: np.ndarray, percent: int) -> np.ndarray:
        """The places of the sets that share ``percent`` of 100 with ``one``, and something at all."""
        both = self.both(one)
        return np.flatnonzero((both > 0) & (100 * both >= percent * (self.sizes + len(one) - both)))


class Joined:
    """Groups of numbers that links join."""

    def __init__(self):
        self.to: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.to.get(x, x)) != x:
            self.to[x] = x = self.to.get(up, up)
        return x

    def add(self, a: int, b: int) -> bool:
        """Whether the link joins two groups."""
        a, b = self.root(a), self.root(b)
        self.to[a] = b
        return a != b


def _node(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64))


def sketches(docs: DataFrame) -> DataFrame:
    """(row, doc_id, node, bands, sig, fp) for rows (row, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, bands, signs, marks = [], [], [], []
            for text in batch.column("text"):
                hashes = simhash.shingle_hashes(text.as_py(), WORDS)
                found = np.unique(hashes).astype(np.uint64)
                marks.append(simhash.folded(hashes))
                least = minima(found)
                nodes.append(_node(found))
                keys = [xxhash.xxh3_64_intdigest(part.tobytes(), i) for i, part in enumerate(least.reshape(BANDS, BAND_ROWS))]
                bands.append(np.array(keys, np.uint64).view(np.int64).tolist())
                signs.append((least >> np.uint64(20)).astype(np.uint8).tobytes())
            columns = [pa.array(nodes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(signs, pa.binary()), pa.array(np.array(marks, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *columns], names=["row", "doc_id", "node", "bands", "sig", "fp"])

    kind = "row bigint, doc_id bigint, node bigint, bands array<bigint>, sig binary, fp bigint"
    return docs.select("row", "doc_id", "text").mapInArrow(shared.tidy(run), kind)


def sets(docs: DataFrame) -> DataFrame:
    """(row, node, found) for rows (row, text): the sets as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [shingles(t.as_py()) for t in part.column("text")]
                columns = [pa.array([_node(f) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("row"), *columns], names=["row", "node", "found"])

    return docs.select("row", "text").mapInArrow(shared.tidy(run), "row bigint, node bigint, found binary")


def _agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of stored ``pairs`` (a, b) whose MinHash bytes agree in AGREE places; ``a`` may be in very many of them."""
    sizes = stored(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("size")), "star-sizes")
    a_rows = stored(sizes.join(nodes.select(F.col("node").alias("a"), F.col("sig").alias("a_sig")), "a"), "star-values")
    b_rows = stored(pairs.join(nodes.select(F.col("node").alias("b"), "sig"), "b"), "pair-values")
    rows = shared.attach(b_rows, a_rows, "a", "size", b_rows.count()).select("a", "b", "a_sig", "sig")
    agree = AGREE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for n in ("a_sig", "sig"))
            yield batch.select(["a", "b"]).filter(pa.array((a == b).sum(axis=1) >= agree)) if batch.num_rows else batch.select(["a", "b"])

    return rows.mapInArrow(shared.tidy(run), "a bigint, b bigint")


def _sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, found) of the nodes ``wanted`` (node); no other texts are hashed or leave their place."""
    wanted = stored(wanted.distinct().join(nodes.select("node", "row"), "node"), "candidate-rows")
    bits = shared.filter_bits(wanted.count())
    marks = wanted.select(F.explode(F.array(*shared.slots([F.col("row")], bits))).alias("slot"))
    texts = shared.maybe_in(docs.select("row", "text"), shared.filter_table(marks, "candidate-filter"), [F.col("row")], bits, "maybe")
    with settings(docs.sparkSession, shared.SMALL_BATCHES):
        return stored(sets(texts.where("maybe")).join(wanted.select("row"), "row").select("node", "found"), "candidate-sets")


def _both(pairs: DataFrame) -> DataFrame:
    """(node) for the nodes in ``pairs`` (a, b)."""
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def _verified(pairs: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) that are similar; ``a`` may be in very many of them."""
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("size"))
    sizes = stored(sizes.withColumn("n", F.col("size")).withColumn("parts", F.ceil(F.col("size") / SIDE).cast("int")), "pair-sizes")
    dealt = shared.attach(pairs, sizes.drop("n"), "a", "size", pairs.count())
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).drop("parts")
    b_rows = dealt.join(known.withColumnRenamed("node", "b"), "b").select("a", "part", F.lit(True).alias("asks"), "b", "found")
    a_rows = sizes.join(known.withColumnRenamed("node", "a"), "a")
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
                elif similar(mine, one, least):
                    out.append((a.as_py(), b.as_py()))
            columns = [pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    return rows.mapInArrow(shared.tidy(run), "a bigint, b bigint")


def _dealt(rows: DataFrame, stats: DataFrame, total: int, *rest: str) -> DataFrame:
    """Rows (key, a, b, asks, minor, *rest): groups of one key meet in blocks of about BLOCK nodes of either side.

    Those that ``asks`` are not of the key's largest group.
    """
    parts = stats.withColumn("a_parts", F.ceil((F.col("size") - F.col("most")) / BLOCK).cast("int"))
    parts = parts.withColumn("b_parts", F.ceil(F.col("size") / BLOCK).cast("int")).drop("most")
    dealt = shared.attach(rows, parts, "key", "size", total).withColumn("minor", F.col("root") != F.col("large"))
    part = lambda n: F.pmod(F.xxhash64("node", F.lit(n)), F.col(n)).cast("int").alias(n[0])
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(n[0])
    left = dealt.where("minor").select("key", part("a_parts"), all_("b_parts"), F.lit(True).alias("asks"), "minor", *rest)
    right = dealt.select("key", all_("a_parts"), part("b_parts"), F.lit(False).alias("asks"), "minor", *rest)
    return left.unionByName(right)


def _by_block(dealt: DataFrame) -> DataFrame:
    """Blocks one after the other, those that ask first."""
    return dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", F.desc("asks"))


def _small_pairs(rows: DataFrame, stats: DataFrame, total: int) -> DataFrame:
    """Pairs (a, b) of rows (key, node, root, sig) under one key, of two roots and with values that agree."""
    groups = _by_block(_dealt(rows, stats, total, "node", "root", "sig"))
    agree = AGREE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, mine, sigs = None, [], None
        for batch in batches:
            out: list[tuple[int, int]] = []
            for key, a, b, asks, minor, node, root, sig in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, a, b) != group:
                    group, mine, sigs = (key, a, b), [], None
                if asks:
                    mine.append((node, root, sig))
                    continue
                if not mine:
                    continue
                if sigs is None:
                    sigs = np.frombuffer(b"".join(m[2] for m in mine), np.uint8).reshape(len(mine), -1)
                    roots, nodes = (np.array([m[i] for m in mine], np.int64) for i in (1, 0))
                near = ((sigs == np.frombuffer(sig, np.uint8)).sum(axis=1) >= agree) & (roots != root)
                if minor:
                    near &= nodes < node  # the other way round it is met again
                out += [(n, node) for n in nodes[near].tolist()]
            columns = [pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    return groups.mapInArrow(shared.tidy(run), "a bigint, b bigint")


def _block_links(rows: DataFrame, known: DataFrame, stats: DataFrame, total: int, least: float) -> DataFrame:
    """Links (a, b) of rows (key, node, root) under one key and of two roots; ``known`` has the sets of all.

    Pairs are decided where they meet; a block gives at most one link for each of its nodes.
    """
    groups = _by_block(_dealt(rows, stats, total, "node", "root").join(known, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, mine, index, joined = None, [], None, Joined()
        for batch in batches:
            out: list[tuple[int, int]] = []
            for key, a, b, asks, node, root, found in zip(*(batch.column(n) for n in ("key", "a", "b", "asks", "node", "root", "found"))):
                place = (key.as_py(), a.as_py(), b.as_py())
                if place != group:
                    group, mine, index, joined = place, [], None, Joined()
                node, root, one = node.as_py(), root.as_py(), np.frombuffer(found.as_py(), np.uint64)
                if asks.as_py():
                    mine.append((node, root, one))
                    continue
                if not mine:
                    continue
                if index is None:
                    index = Overlaps([m[2] for m in mine])
                    nodes, roots = (np.array([m[i] for m in mine], np.int64) for i in (0, 1))
                both = index.both(one)
                near = (both >= least * (index.sizes + len(one) - both) - 1e-9) & (roots != root)
                out += [(n, node) for n in nodes[near].tolist() if joined.add(n, node)]
            columns = [pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    return groups.mapInArrow(shared.tidy(run), "a bigint, b bigint").distinct()


def covered(nodes: DataFrame, docs: DataFrame, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """(a, b) that covering SimHash links, equal fingerprints included, and those of them that are similar."""
    marks = nodes.groupBy("fp").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("size"))
    marks = stored(marks, "fingerprint-nodes")
    equal = shared.attach(nodes.select("fp", "node"), marks, "fp", "size", nodes.count()).where("node <> a")
    near = simhash.links(marks.select("fp", F.col("a").alias("node")))  # (node, first of its group)
    pairs = equal.select("a", F.col("node").alias("b")).unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = stored(pairs.distinct(), "covered-pairs")
    agreeing = stored(_agreeing(pairs, nodes), "agreeing-pairs")
    return pairs, stored(_verified(agreeing, _sets_of(_both(agreeing), nodes, docs), least), "near-pairs")


def links(nodes: DataFrame, docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b) that join all similar nodes; ``nodes`` (node, row, bands, sig, fp) and ``docs`` (row, text) are stored."""
    decided, found = covered(nodes, docs, least)
    buckets = nodes.select("node", F.explode("bands").alias("key"))
    buckets = stored(buckets, "bands")
    many = stored(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared-bands")
    rows = stored(shared.attach(buckets, many, "key", "size", buckets.count()).select("key", "node"), "candidates")
    roots, rows = shared.components(found), rows.withColumn("root", F.col("node"))
    for step in range(STARS + 1):
        rows = rows.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        groups = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"))
        stats = groups.groupBy("key").agg(
            F.sum("n").alias("size"), F.max("n").alias("most"), F.max(F.struct("n", "root")).getField("root").alias("large")
        )
        # Keys whose nodes all are linked have nothing left to decide.
        stats = stored(stats.where("most < size"), "open-keys")
        rows = stored(rows.join(stats.select("key"), "key", "left_semi"), "open-rows")
        total = rows.count()
        if not total:
            break
        if step < STARS:
            other = groups.join(stats.select("key", "large"), "key").where("root <> large")
            other = other.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(step)), "node", "root")).alias("a"))
            other = other.select("key", F.col("a.node").alias("a"), F.col("a.root").alias("a_root"))
            stars = stored(stats.select("key", "size").join(other, "key"), "stars")
            pairs = shared.attach(rows, stars, "key", "size", total)
            pairs = pairs.where("root <> a_root").select("a", F.col("node").alias("b"))
        else:
            large = stored(stats.where(F.col("size") > SMALL), "large-keys")
            many = stored(rows.join(large.select("key"), "key", "left_semi"), "large-rows")
            if size := many.count():
                known = _sets_of(many.select("node"), nodes, docs)
                with settings(docs.sparkSession, shared.SMALL_BATCHES):
                    found = found.unionByName(stored(_block_links(many, known, large, size, least), "block-links"))
            small = rows.join(large.select("key"), "key", "left_anti").join(nodes.select("node", "sig"), "node")
            pairs = _small_pairs(small, stats.where(F.col("size") <= SMALL), total)
        pairs = pairs.distinct().join(decided, ["a", "b"], "left_anti").join(decided.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
        pairs = stored(pairs, "candidate-pairs")
        decided = decided.unionByName(pairs)
        if step < STARS:
            pairs = stored(_agreeing(pairs, nodes), "agreeing-pairs")
        if pairs.isEmpty():
            continue
        found = found.unionByName(stored(_verified(pairs, _sets_of(_both(pairs), nodes, docs), least), "near-pairs"))
        roots = shared.components(found)
    return found


def without_near_copies(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` with one row of each group, all columns kept."""
    wide = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("all")), "numbered")
    texts = wide.select("row", F.col("all.doc_id").cast("bigint").alias("doc_id"), F.col("all.text").cast("string").alias("text"))
    with settings(docs.sparkSession, shared.SMALL_BATCHES):
        marks = stored(sketches(texts), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")).alias("first")
    nodes = marks.groupBy("node").agg(first, F.count(F.lit(1)).alias("size"), F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig"), F.min("fp").alias("fp"))
    nodes = stored(nodes.withColumn("row", F.col("first.row")), "nodes")
    roots = shared.components(links(nodes, texts, least))
    groups = nodes.select("node", "first", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = stored(groups, "node-groups")
    stay = groups.groupBy("root").agg(F.min("first").alias("stay"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("all"))
    stay = stored(stay.where("all > 1").select("root", "n", F.col("stay.row").alias("stay")), "stay")
    copied = shared.attach(groups.select("node", "size", "root"), stay, "root", "n", groups.count()).select("node", "size", "stay")
    copied = stored(copied, "copied")
    gone = stored(shared.attach(marks.select("row", "node"), copied, "node", "size", marks.count()).where("row <> stay").select("row"), "gone")
    return shared.without(wide, gone, "row").select("all.*")
