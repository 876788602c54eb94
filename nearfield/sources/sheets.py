"""Tabular sources: a header row and rows of string cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import text as tx
from nearfield.operators.points import latest
from nearfield.sources.files import read_csv_rows

MAX_COLUMNS = 26  # fixed value: columns A to Z


def read_sheet(spark: SparkSession, path: str, *, multi_line: bool | None = None) -> DataFrame:
    """A sheet from a CSV file, with ``row_number`` (see ``read_csv_rows``)."""
    return sheet_cells(read_csv_rows(spark, path, multi_line=multi_line).drop("file"), ["row_number"])


def left_out_columns(rows: DataFrame, also: list[str] | None = None, max_columns: int | None = MAX_COLUMNS) -> list[str]:
    """The columns that ``sheet_cells`` does not take."""
    cells = [name for name in rows.columns if name not in (also or [])]
    return [] if max_columns is None else cells[max_columns:]


def sheet_cells(rows: DataFrame, also: list[str] | None = None, max_columns: int | None = MAX_COLUMNS) -> DataFrame:
    """The first ``max_columns`` columns (None: all) as strings, a missing cell as an empty one; ``also`` passes through."""
    also = also or []
    out = left_out_columns(rows, also, max_columns)
    cells = [name for name in rows.columns if name not in also and name not in out]
    return rows.select(
        *also, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in cells]
    )


def sheet_documents(
    rows: DataFrame,
    *,
    sheet: str,
    key: str,
    text_columns: list[str],
    metadata_columns: list[str] | None = None,
    order: list[str] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """``doc_id, row_key, text`` and metadata (an empty cell as NULL) of every row.

    With ``order`` only the last row of a key is returned: later rows replace
    the points of earlier ones.
    """
    if not text_columns:
        raise ValueError("at least one text column is needed")
    if order:
        rows = latest(rows, f"`{key}`", F.struct(*order))
    return rows.select(
        F.concat(F.lit(f"sheet_{sheet}_"), F.col(f"`{key}`")).alias("doc_id"),
        F.col(f"`{key}`").alias("row_key"),
        tx.labelled_values(text_columns, "\n").alias("text"),
        *[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in metadata_columns or []],
        *(keep or []),
    )


def sheet_preview(rows: DataFrame, order: list[str], *, sample: int = 3) -> DataFrame:
    """The first rows, each with the number of rows and the column names of the sheet."""
    cells = [name for name in rows.columns if name not in order]
    total = rows.count()
    return rows.orderBy(*order).limit(sample).select(
        *order, *cells, F.lit(total).cast("bigint").alias("total_rows"), F.lit(", ".join(cells)).alias("column_names")
    )


def sheet_sync_stats(chunk_counts: DataFrame, *, chunks: str = "chunks", failed: DataFrame | None = None) -> DataFrame:
    """One row of counts from one row per sheet row; all chunks count as new.

    ``failed`` are the documents (``doc_id``) that could not be embedded: their rows count as errors, not as processed.
    """
    rows, bad = F.count(F.lit(1)), F.lit(False)
    if failed is not None:
        wrong = failed.select("doc_id").distinct().withColumn("_failed", F.lit(True))
        chunk_counts = chunk_counts.join(wrong, "doc_id", "left")
        bad = F.col("_failed").isNotNull()
    return chunk_counts.agg(
        rows.alias("total_rows"),
        F.count_if(~bad).alias("processed_rows"),
        F.coalesce(F.sum(F.when(~bad, F.col(chunks))), F.lit(0)).cast("bigint").alias("new_chunks"),
        F.lit(0).cast("bigint").alias("updated_chunks"),
        F.count_if(bad).alias("errors"),
    )
