"""Mixing sources to target weights by random keys and distributed prefix sums, in DataFrame functions only.

Every document gets a random key from its id.  Within each source documents are ordered by that key, in slices of the
key range: the sizes are summed by slice, the slices' prefix sums say in which one the source's budget ends, and only
that slice (a few thousand rows) is ordered row by row.  Rows of other slices are taken whole or not at all and never
shuffle.  A budget beyond the source repeats it in epochs.
Null texts have size 0, null ids are one id, a null source is a source of its own (the last); repeated rows each count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm import shared
from nearfield.session import stored
from nearfield.sources.rows import number_rows

KEY_BITS = 60
MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
#: Expected rows of one source in one slice of the keys.
SLICE_ROWS = 4096


def words(text: Column) -> Column:
    """The number of words: runs of other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def random_key(doc_id: Column) -> Column:
    """Sixty bits of the id's MD5: the same order in every run."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("bigint")


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """The narrow rows that decisions are made on."""
    return docs.select(
        *more,
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.col("source").isNull().alias("no_source"),
        words(F.col("text")).alias("size"),
        random_key(F.col("doc_id")).alias("key"),
    )


def targets(sources: DataFrame) -> DataFrame:
    """``target`` for rows of source_size and weight: by weight, none above MAX_REPEATS times its source's size.

    What is above is shared again among the others: the target is the smaller of that bound and a common level times
    the weight.  Only sums reach the driver, and each turn finds more sources at their bound or ends.
    """
    bound = F.col("source_size") * MAX_REPEATS
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, at_bound = None, -1
    while True:
        full = F.lit(False) if level is None else bound < F.lit(level) * F.col("weight")
        row = sources.agg(
            F.coalesce(F.sum(F.when(full, bound)), F.lit(0)).alias("given"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weight"),
            F.count(F.when(full, 1)).alias("full"),
        ).first()
        if row.full == at_bound:
            break
        at_bound, level = row.full, (total - row.given) / row.weight if row.weight else level
    return sources.withColumn("target", F.least(bound.cast("double"), F.lit(float(level or 0)) * F.col("weight")))


def budgets(rows: DataFrame) -> tuple[DataFrame, int]:
    """Per source of the stored ``rows``: target, epochs, the rest in words and the slice of keys where it ends; and the slices."""
    total = rows.count()
    slices = max(1, -(-total // SLICE_ROWS))
    by = ["no_source", "source"]
    parts = rows.groupBy(*by, slice_of(slices).alias("slice")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
    parts = stored(parts, "slice-sums")
    sources = parts.groupBy(*by).agg(F.sum("words").alias("source_size"), F.sum("docs").alias("docs"))
    sources = number_rows(sources, by, "number")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("number") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    sources = targets(stored(sources.withColumn("weight", weight), "sources"))
    budget = F.floor(F.col("target") + 0.5)
    some = F.col("source_size") > 0
    sources = sources.withColumn("epochs", F.when(some, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)))
    sources = sources.withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    before = Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.select(*by, "slice", "words", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    ends = sums.join(sources.select(*by, "rest"), by).where("before < rest and rest <= before + words")
    # A slice without words can't hold the end; a rest of 0 ends before all slices.
    ends = ends.groupBy(*by).agg(F.min("slice").alias("cut"), F.min("before").alias("before"))
    sources = sources.join(ends, by, "left").withColumn("cut", F.coalesce("cut", F.lit(-1)))
    sources = sources.select(*by, "source_size", "docs", "target", "epochs", "rest", "cut", "before")
    return stored(sources.withColumn("place", F.xxhash64(*by)), "budgets"), slices


def slice_of(slices: int) -> Column:
    return F.floor(F.col("key") / F.lit(float(1 << KEY_BITS)) * slices)


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows of the slices in which budgets end, with the ``ahead`` words of their source before them."""
    order = Window.partitionBy("no_source", "source").orderBy("key", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))


def _with_budgets(rows: DataFrame, sources: DataFrame, slices: int, total: int) -> DataFrame:
    rows = rows.withColumn("place", F.xxhash64("no_source", "source")).drop("source", "no_source")
    return shared.attach(rows, sources, "place", "docs", total).withColumn("slice", slice_of(slices))


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target and ``taken``, the words that the mix takes of it.

    Each source's words come to its target, rounded: the last document of a source is taken in part.
    """
    rows = stored(keyed(docs), "keyed")
    sources, slices = budgets(rows)
    known = _with_budgets(rows, sources, slices, rows.count())
    whole = known.where("slice <> cut").withColumn("extra", F.when(F.col("slice") < F.col("cut"), F.col("size")).otherwise(F.lit(0)))
    part = _ordered(known.where("slice = cut"))
    part = part.withColumn("extra", F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("ahead")))).drop("ahead")
    taken = (F.col("epochs") * F.col("size") + F.col("extra")).cast("bigint")
    return whole.unionByName(part).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them, all columns kept: whole documents, each as often as it is taken.

    A document in which a budget ends is taken once more if at least half of it fits.
    """
    rows = stored(keyed(docs), "keyed")
    sources, slices = budgets(rows)
    total = rows.count()
    part = _ordered(_with_budgets(rows, sources, slices, total).where("slice = cut"))
    fits = part.where(F.col("ahead") + F.col("size") / 2 <= F.col("rest"))
    ends = fits.groupBy("place").agg(F.max(F.struct("key", "size", F.coalesce("doc_id", F.lit(-1 << 63)).alias("id"))).alias("end"))
    ends = stored(sources.join(ends, "place", "left"), "ends")
    wide = _with_budgets(keyed(docs, F.struct("*").alias("row")), ends, slices, total)
    here = F.struct("key", "size", F.coalesce("doc_id", F.lit(-1 << 63)).alias("id"))
    extra = (F.col("slice") < F.col("cut")) | ((F.col("slice") == F.col("cut")) & F.coalesce(here <= F.col("end"), F.lit(False)))
    copies = (F.col("epochs") + extra.cast("int")).cast("int")
    return wide.withColumn("copy", F.explode(F.array_repeat(F.lit(0), copies))).select("row.*")
