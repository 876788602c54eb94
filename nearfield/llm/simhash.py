"""Near duplicates by SimHash fingerprints and covering locality-sensitive hashing: no pair within the radius is missed.

Words are runs of other than ASCII white space of the text, A-Z lower-cased; shingles are so many words in a row, with
repeats, joined by one space (fewer words: the whole sequence).  A fingerprint bit is set if it is in over half of the
shingles' XXH64 (seed 42).  A text without words, or null, has fingerprint 0 and links like any other.

Covering: each bit position gets one of the 2^(r+1)-1 non-zero vectors of r+1 bits, in turn over a shuffled order, and
table v keeps the positions whose vector has an odd product with v.  For up to r positions some v is orthogonal to all
their vectors, so fingerprints that differ in at most r bits agree in what table v keeps.  Equal fingerprints are one
node.  A bucket of over BUCKET nodes is split by a fresh family of tables, again without a miss, until all are small;
buckets are compared in a sorted stream and give at most one link per node, to the first of its group in the bucket.
Rows with one id are documents each, linked by their own texts only.  Rows whose doc_id is null link like any other, and
belong to the component of their fingerprint (null if no row with an id is in it).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm import shared
from nearfield.session import stored

BITS = 64
RADIUS = 4
WORDS = 5
SEED = 42
#: Nodes that are compared with each other at most; larger buckets are split again.
BUCKET = 1024
_CHUNK = 1 << 16  # hashes whose bits are counted at once


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The XXH64 of the shingles, repeats included."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII white space and A-Z only
    if not found:
        return np.empty(0, "<u8")
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    width = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    last = ends[width - 1 :].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), last)], dtype="<u8")


def folded(hashes: np.ndarray) -> int:
    """The fingerprint of shingles as an unsigned integer."""
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int) -> int:
    """The fingerprint of a text."""
    return folded(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp), one row per document; fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(marks.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


def masks(radius: int, family: int) -> list[int]:
    """The bits kept by each table, as signed longs; ``family`` shuffles the positions."""
    vectors = (1 << (radius + 1)) - 1
    order = np.random.default_rng(family).permutation(BITS)
    vector_of = {int(bit): 1 + place % vectors for place, bit in enumerate(order)}
    kept = [sum(1 << bit for bit, m in vector_of.items() if (m & v).bit_count() % 2) for v in range(1, vectors + 1)]
    return [k - (1 << BITS) if k >> (BITS - 1) else k for k in kept]


def _bucket_links(key: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, first of its group) within runs of equal ``key``."""
    bits = fp.view(np.uint64)  # counting bits of a signed number takes its absolute value
    here, step, found = np.arange(len(key) - 1), 1, []
    while len(here):
        here = here[here + step < len(key)]
        here = here[key[here] == key[here + step]]
        near = here[np.bitwise_count(bits[here] ^ bits[here + step]) <= radius]
        if len(near):
            found.append(np.stack([near, near + step]))
        step += 1
    label = np.arange(len(key))
    if found:
        a, b = np.concatenate(found, axis=1)
        while True:
            least = label.copy()
            np.minimum.at(least, a, label[b])
            np.minimum.at(least, b, label[a])
            least = least[least]
            if (least == label).all():
                break
            label = least
    moved = np.flatnonzero(label != np.arange(len(key)))
    return node[moved], node[label[moved]]


def _compare(buckets: DataFrame, radius: int) -> DataFrame:
    """Rows (key, fp, node), dealt by key and sorted: links (a, b) and, with a null b, the rows of buckets too large."""
    most = BUCKET

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64)] * 3
        large: int | None = None  # the key of the bucket that is being passed on

        def rows(key, fp, a, b=None):
            nulls = pa.nulls(len(a), pa.int64())
            columns = [nulls, nulls, pa.array(a), pa.array(b)] if b is not None else [pa.array(key), pa.array(fp), pa.array(a), nulls]
            return pa.RecordBatch.from_arrays(columns, names=["key", "fp", "a", "b"])

        def done(key, fp, node):
            """Whole buckets only."""
            if not len(key):
                return
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[start, len(key)])
            big = np.repeat(sizes > most, sizes)
            if big.any():
                yield rows(key[big], fp[big], node[big])
            some = np.repeat((sizes > 1) & (sizes <= most), sizes)
            if some.any():
                yield rows(None, None, *_bucket_links(key[some], fp[some], node[some], radius))

        for batch in batches:
            new = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "fp", "node")]
            if large is not None:
                same = int(np.searchsorted(new[0], large, side="right"))
                if same:
                    yield rows(*(x[:same] for x in new))
                if same == len(new[0]):
                    continue
                new, large = [x[same:] for x in new], None
            key, fp, node = (np.concatenate([old, x]) for old, x in zip(kept, new))
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
            yield from done(key[:cut], fp[:cut], node[:cut])
            kept = [key[cut:], fp[cut:], node[cut:]]
            if len(kept[0]) > most:
                large = int(key[-1])
                yield rows(*kept)
                kept = [x[:0] for x in kept]
        yield from done(*kept)

    return buckets.mapInArrow(run, "key bigint, fp bigint, a bigint, b bigint")


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) for ``nodes`` (node, fp) with distinct fingerprints: joins every two that differ in at most ``radius`` bits."""
    rest, found, family = nodes.withColumn("key", F.lit(0).cast("bigint")), None, 0
    while True:
        kept = F.array(*[F.xxhash64("key", F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks(radius, family))])
        buckets = rest.select("fp", "node", F.explode(kept).alias("key")).select("key", "fp", "node")
        sorted_rows = buckets.repartition("key").sortWithinPartitions("key")
        out = stored(_compare(sorted_rows, radius).distinct(), "bucket-links")
        new = out.where(F.col("b").isNotNull()).select("a", "b")
        found = new if found is None else found.unionByName(new)
        rest = out.where(F.col("b").isNull()).select("key", "fp", F.col("a").alias("node"))
        family += 1
        if rest.isEmpty():
            return found


def near_groups(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id reachable over links)."""
    marks = stored(fingerprints(docs, words), "fingerprints")
    groups = marks.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size"))
    groups = stored(groups, "fingerprint-groups")
    # Nodes are fingerprints, not ids: an id that stands with several texts is in several components, or joins none.
    roots = shared.components(links(groups.select("fp", F.col("fp").alias("node")), radius))
    groups = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = stored(groups, "fingerprint-roots")
    least = groups.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = shared.attach(groups, stored(least, "component-ids"), "root", "n", groups.count())
    named = stored(named.select("fp", "size", "component_id"), "fingerprint-components")
    return shared.attach(marks, named, "fp", "size", marks.count(), "left")
