"""Exact duplicates by two passes over a Bloom filter, in DataFrame functions only.

Texts are equal when their UTF-8 bytes are (no normalisation; null counts as empty), judged by SHA-256.  The wide table
is read once, into a narrow one of ids and digests.  The first pass counts how often each filter bit is set and keeps
the bits set more than once; the second looks every digest up.  A row that has a bit set by itself alone is unique and
passes straight through; only the others shuffle, and exact counts of digests decide among them.
Rows with equal text and equal or null ids: one of them stays (a null id loses to any other).  Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm import shared
from nearfield.session import stored


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def repeated_filter(digests: DataFrame) -> tuple[DataFrame, int]:
    """First pass over rows of ``sha``: the filter of bits set by more than one row, and its number of bits."""
    bits = shared.filter_bits(digests.count())
    marks = digests.select(F.explode(F.array(*shared.slots([F.col("sha")], bits))).alias("slot"))
    twice = marks.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("slot")
    return shared.filter_table(twice, "repeated-filter"), bits


def dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.  The largest doc_id of equal texts stays."""
    narrow = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        digest(F.col("text")).alias("sha"),
        F.monotonically_increasing_id().alias("row"),
    )
    narrow = stored(narrow, "digests")
    table, bits = repeated_filter(narrow)
    probed = shared.maybe_in(narrow, table, [F.col("sha")], bits, "again")
    again = stored(probed.where("again").drop("again"), "again")
    groups = again.groupBy("sha").agg(
        F.max(F.struct("doc_id", "row")).alias("last"), F.count(F.lit(1)).alias("size"), F.count(F.lit(1)).alias("n")
    )
    judged = shared.attach(again, stored(groups, "groups"), "sha", "size", again.count())
    judged = judged.select(
        "doc_id",
        F.col("last.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("last.row")).alias("kept"),
        "sha",
    )
    single = probed.where("not again").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    out = single.unionByName(judged)
    return out.withColumn("text_sha256", F.lower(F.hex("sha"))).drop("sha")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated texts, all columns kept; only rows that may be repeated shuffle."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id"), digest(F.col("text")).alias("sha"))
    narrow = stored(rows.select("doc_id", "sha"), "digests")
    table, bits = repeated_filter(narrow.select("sha"))
    key = [F.col("sha")]
    again = shared.maybe_in(narrow, table, key, bits, "again").where("again")
    groups = again.groupBy("sha").agg(F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("size"))
    probed = shared.maybe_in(rows, table, key, bits, "again")
    stay = shared.attach(probed.where("again").drop("again"), stored(groups, "groups"), "sha", "size", narrow.count())
    stay = stay.where(F.col("doc_id").eqNullSafe(F.col("last"))).dropDuplicates(["sha"])
    return probed.where("not again").select("row.*").unionByName(stay.select("row.*"))
