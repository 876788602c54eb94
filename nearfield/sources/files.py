"""Text out of files."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from nearfield.functions import text as tx
from nearfield.sources.rows import number_file_rows

MAX_UPLOAD_BYTES = 50 << 20  # fixed value: largest file of an upload request
NO_PARSER = ("pdf",)


def read_files(spark: SparkSession, path: str, *, pattern: str = "*", max_bytes: int | None = None) -> DataFrame:
    """``filename, size, content`` of every file below ``path``; content is NULL above ``max_bytes``, if given.

    A file is read whole (Spark takes up to 2 GB); read large CSV files with :func:`read_csv_rows`.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    files = files.select("path", "length", "content")
    if max_bytes is not None:
        large = files.where(F.col("length") > max_bytes).withColumn("content", F.lit(None).cast("binary"))
        files = files.where(F.col("length") <= max_bytes).unionByName(large)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size"), "content"
    )


def extract_files(files: DataFrame, *, max_bytes: int | None = None) -> DataFrame:
    """Clean text of uploaded files (``filename, content``).

    Returns ``filename, size, type, content, row_count, reason``.  A CSV becomes
    one ``Row i: column: value, ...`` line per row; anything else is read as
    UTF-8.  A file that cannot be taken has NULL content and a reason; above ``max_bytes``, if given, none is.
    """
    kind = tx.file_extension(F.col("filename"))
    size = F.col("size") if "size" in files.columns else F.octet_length("content")
    typed = files.select("filename", size.cast("bigint").alias("size"), kind.alias("type"), "content")
    read = typed.select(
        "filename",
        "size",
        "type",
        F.make_valid_utf8(F.col("content").cast("string")).alias("raw"),
    )
    table = F.when(F.col("type") == "csv", _csv_text()(F.when(F.col("type") == "csv", F.col("raw"))))
    parsed = read.withColumn("table", table).select(
        "filename",
        "size",
        "type",
        F.when(F.col("type") == "csv", F.col("table.text")).otherwise(F.col("raw")).alias("text"),
        F.col("table.row_count").alias("row_count"),
    )
    reason = (
        F.when(F.col("size") > F.lit(max_bytes).cast("bigint"), F.lit("File too large"))
        .when(F.col("type").isin(*NO_PARSER), F.concat(F.lit("No parser for "), F.col("type")))
        .when(tx.is_blank(F.col("text")), F.lit("No readable content found in file"))
    )
    taken = parsed.withColumn("reason", reason)
    return taken.select(
        "filename",
        "size",
        "type",
        F.when(F.col("reason").isNull(), tx.clean_text(F.col("text"))).alias("content"),
        "row_count",
        "reason",
    )


def _names(header: list[str], cells: int) -> list[str]:
    """The header, with a positional name for every cell beyond it."""
    return header + [f"column_{i}" for i in range(len(header) + 1, cells + 1)]


def _csv_text():
    """Arrow UDF for one small CSV file per value, each with a header of its own."""

    def lines(text: str) -> list[str]:
        table = csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline=""))
        header = next(table, [])
        rows = (row for row in table if row)
        return [
            f"Row {i}: " + ", ".join(f"{name}: {value}" for name, value in zip(_names(header, len(row)), row))
            for i, row in enumerate(rows, 1)
        ]

    @arrow_udf("struct<text:string,row_count:bigint>")
    def csv_text(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            found = [None if text is None else lines(text) for text in column.to_pylist()]
            yield pa.StructArray.from_arrays(
                [
                    pa.array([None if rows is None else "\n".join(rows) for rows in found], pa.string()),
                    pa.array([None if rows is None else len(rows) for rows in found], pa.int64()),
                ],
                ["text", "row_count"],
            )

    return csv_text


def read_csv_rows(spark: SparkSession, path: str, *, multi_line: bool | None = None) -> DataFrame:
    """Rows of CSV files of one layout, all strings, with ``file`` and ``row_number``.

    Cells beyond the header are kept under positional names (``column_4``).  A
    file is read in splits unless cells hold line breaks.  Where ``multi_line`` does not say, one pass over the lines finds out: without a
    line that has an odd number of quotes no cell can go on to the next line.
    """
    def times(sign: str):
        return F.length("value") - F.length(F.replace("value", F.lit(sign), F.lit("")))

    lines = spark.read.text(path).agg(F.max(times(",")).alias("commas"), F.max(times('"') % 2).alias("open")).first()
    if multi_line is None:
        multi_line = bool(lines["open"])

    def reader(header: bool = True):
        return spark.read.option("header", header).option("escape", '"').option("multiLine", multi_line)

    found = reader().csv(path)
    # Cells beyond the header: no line has more than its commas allow, unless cells hold line breaks.
    width = (lines["commas"] or 0) + 1
    if multi_line:
        width = max(width, len(reader(header=False).csv(path).columns))
    extra = _names(found.columns, width)[len(found.columns) :]
    if extra:
        schema = T.StructType([*found.schema.fields, *(T.StructField(name, T.StringType()) for name in extra)])
        wide = reader().schema(schema).csv(path)
        used = wide.agg(*[F.count(name).alias(name) for name in extra]).first()
        last = max((i for i, name in enumerate(extra, 1) if used[name]), default=0)
        found = wide.drop(*extra[last:])
    return number_file_rows(found)


def csv_lines(rows: DataFrame, columns: list[str], *, number: str = "row_number") -> DataFrame:
    """One ``Row i: column: value, column: value`` line per row of a table of any size."""
    line = F.concat(F.lit("Row "), F.col(number).cast("string"), F.lit(": "), tx.labelled_values(columns, ", "))
    keep = [name for name in ("file",) if name in rows.columns]
    return rows.select(*keep, number, line.alias("line"))
