"""What several operators need: joins that bear hot keys, Bloom filters as tables, components of a graph."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.session import stored

#: Lookup tables of at most so many fixed-width rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 50_000
#: A filter has at most so many bits (256 MB, broadcast); beyond it more rows pass, and the results stay exact.
MAX_FILTER_BITS = 1 << 31
BITS_PER_KEY = 16
HASHES = 2
#: For steps on whole texts: an Arrow batch of ten thousand rows takes tens of MB, in the JVM and in the worker.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
_BUCKET_BITS = 15  # bitmap_construct_agg makes bitmaps of 32,768 bits


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` of a task, before and after which memory that is no longer used goes back to the system.

    Python workers live on from task to task and stage to stage, and would else keep what the largest of them needed.
    """

    def release() -> None:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim is not None:
            trim(0)

    def whole(batches: Iterator) -> Iterator:
        release()
        yield from run(batches)
        release()

    return whole


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their group, one key of which may own much of the rows.

    ``groups`` has one row per key, ``size`` its number of rows and ``total`` their sum.  Groups of at least a
    thousandth of all rows are at most a thousand, so those are broadcast and their rows stay where they are; the
    other keys are joined by a shuffle, in which no key has more than that.  A small ``groups`` is broadcast whole.
    Both inputs are read more than once: pass stored tables.
    """
    if groups.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups.drop(size)), key, how)
    limit = max(1000, total // 1000)
    hot, cold = groups.where(F.col(size) >= limit).drop(size), groups.where(F.col(size) < limit).drop(size)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key, how))


def filter_bits(keys: int) -> int:
    """Bits of a filter for so many keys: a power of two, at most MAX_FILTER_BITS."""
    return min(MAX_FILTER_BITS, 1 << max(_BUCKET_BITS, (BITS_PER_KEY * max(1, keys) - 1).bit_length()))


def slots(keys: list[Column], bits: int) -> list[Column]:
    """The bits that a key sets."""
    return [F.pmod(F.xxhash64(F.lit(i), *keys), F.lit(bits)) for i in range(HASHES)]


def filter_table(slot_rows: DataFrame, name: str) -> DataFrame:
    """A stored Bloom filter (bucket, bits) from rows of one column ``slot``."""
    parts = slot_rows.select(
        F.shiftright("slot", _BUCKET_BITS).alias("bucket"),
        F.col("slot").bitwiseAND(F.lit((1 << _BUCKET_BITS) - 1)).alias("place"),
    )
    # One task has whole buckets, so no bitmap is made more than once.
    made = parts.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))
    return stored(made, name)


def maybe_in(rows: DataFrame, table: DataFrame, keys: list[Column], bits: int, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: false only if the key is surely not in the filter."""
    hit = F.lit(True)
    for i, slot in enumerate(slots(keys, bits)):
        side = table.select(F.col("bucket").alias(f"_bucket{i}"), F.col("bits").alias(f"_bits{i}"))
        rows = rows.withColumn(f"_slot{i}", slot).withColumn(f"_bucket{i}", F.shiftright(f"_slot{i}", _BUCKET_BITS))
        rows = rows.join(F.broadcast(side), f"_bucket{i}", "left")
        place = F.col(f"_slot{i}").bitwiseAND(F.lit((1 << _BUCKET_BITS) - 1))
        byte = F.substring(F.col(f"_bits{i}"), F.shiftright(place, 3).cast("int") + 1, F.lit(1))
        mask = F.element_at(F.array(*[F.lit(1 << b) for b in range(8)]), place.bitwiseAND(F.lit(7)).cast("int") + 1)
        hit = hit & F.coalesce(F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(mask) != 0, F.lit(False))
    rows = rows.withColumn(name, hit)
    return rows.drop(*[f"_{what}{i}" for i in range(HASHES) for what in ("slot", "bucket", "bits")])


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` whose non-null ``key`` is not in ``gone``, one row per key, stored; few other rows shuffle.

    A filter of the keys is broadcast; rows that it does not know pass straight through.
    """
    bits = filter_bits(gone.count())
    marks = gone.select(F.explode(F.array(*slots([F.col(key)], bits))).alias("slot"))
    probed = maybe_in(rows, filter_table(marks, "gone-filter"), [F.col(key)], bits, "_maybe")
    passed = probed.where(~F.col("_maybe")).drop("_maybe")
    return passed.unionByName(probed.where("_maybe").drop("_maybe").join(gone.select(key), key, "left_anti"))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over ``links`` (a, b), for every node that has a link.

    Every round each node joins its smallest neighbour and the links are drawn anew between what has merged, which
    at least halves the nodes; then the rounds are put together from the last to the first.
    """
    links = stored(links.where("a <> b").distinct(), "links")
    rounds = []
    while count := links.count():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        joins = both.groupBy("a").agg(F.least("a", F.min("b")).alias("to"), F.count(F.lit(1)).alias("size"))
        joins = stored(joins.withColumnRenamed("a", "node"), "joins")
        rounds.append(joins)
        left = attach(links.withColumnRenamed("a", "node"), joins, "node", "size", 2 * count)
        left = left.select(F.col("to").alias("a"), F.col("b").alias("node"))
        right = attach(stored(left, "half"), joins, "node", "size", 2 * count)
        links = stored(right.select("a", F.col("to").alias("b")).where("a <> b").distinct(), "links")
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    known = rounds.pop().select("node", F.col("to").alias("root"))
    while rounds:
        step = rounds.pop().select("node", "to")
        known = stored(known, "roots")
        into = known.join(step.groupBy(F.col("to").alias("node")).agg(F.count(F.lit(1)).alias("size")), "node", "left")
        into = stored(into.select(F.col("node").alias("to"), "root", F.coalesce("size", F.lit(0)).alias("size")), "into")
        known = attach(step, into, "to", "size", step.count(), "left")
        known = known.select("node", F.coalesce("root", "to").alias("root"))
    return stored(known, "roots")
