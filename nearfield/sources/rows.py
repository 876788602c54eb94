"""Number the rows of a table in order, without bringing them to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.operators.points import small_side
from nearfield.session import stored


def number_rows(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """Add 1, 2, 3, ... in the order of ``order``, which must be unique per row.

    Rows are range-partitioned and sorted, each takes its place within its
    partition, and the partition sizes (one small row each) give the rest.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(ranged.withColumn("_seat", F.monotonically_increasing_id()), "numbered")
    return _add_offsets(placed, F.shiftright("_seat", 33), name)


def _add_offsets(placed: DataFrame, part: Column, name: str, within: list[str] | None = None) -> DataFrame:
    """Row numbers from per-block sizes: rows of one block have consecutive seats."""
    placed = placed.withColumn("_part", part)
    sizes = placed.groupBy(*(within or []), "_part").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_seat").alias("_first")
    )
    # One row per block (file split or partition), so a window over them is small.
    before = Window.partitionBy(*(within or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    joined = placed.join(small_side(starts), [*(within or []), "_part"])
    number = (F.col("_before") + F.col("_seat") - F.col("_first") + 1).cast("bigint")
    return joined.withColumn(name, number).drop("_part", "_seat", "_before", "_first")


def number_file_rows(rows: DataFrame, name: str = "row_number") -> DataFrame:
    """Add ``file`` and the row's number within it, in file order.

    ``rows`` is a freshly read file source.  Rows of one split are read in
    order, and splits know where in the file they start.
    """
    placed = stored(
        rows.select(
            "*",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_seat"),
        ),
        "file-rows",
    )
    return _add_offsets(placed, F.col("_block"), name, ["file"]).drop("_block")
