"""Keep points in step with a stream of document changes.

A change has ``seq`` (any orderable type, growing per document), ``op``,
``doc_id`` and ``full_document`` (a struct with the text and metadata, or NULL).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearfield.functions import text as tx
from nearfield.operators.chunking import chunk_documents
from nearfield.operators.embedding import EmbeddingProvider, embed_texts
from nearfield.operators.points import latest, small_side, without_keys
from nearfield.plans.ingest import ChunkOptions, compose_payload
from nearfield.session import remove, stored
from nearfield.sources.sheets import sheet_cells, sheet_documents

OPERATIONS = ("insert", "update", "delete")  # fixed values: the operations listened to
METADATA = ("title", "category", "source", "tags")  # fixed values: metadata taken by default


def classify_changes(changes: DataFrame, *, text: str = "text") -> DataFrame:
    """Add ``action``: ``upsert``, ``delete`` or ``ignore``.

    An insert or update without a document is ignored, one whose document has
    no text is a delete; so is a delete.  Changes without a key and of other
    operations are ignored.
    """
    listened = F.col("op").isin(*OPERATIONS) & F.col("doc_id").isNotNull()
    action = (
        F.when(~F.coalesce(listened, F.lit(False)), F.lit("ignore"))
        .when(F.col("op") == "delete", F.lit("delete"))
        .when(F.col("full_document").isNull(), F.lit("ignore"))
        .when(tx.usable_text(F.col("full_document")[text]), F.lit("upsert"))
        .otherwise(F.lit("delete"))
    )
    return changes.withColumn("action", action)


def effective_changes(changes: DataFrame, *, text: str = "text") -> DataFrame:
    """The last change of each document that counts."""
    counted = classify_changes(changes, text=text).where(F.col("action") != "ignore")
    return latest(counted, "doc_id", F.col("seq"))


@dataclass(frozen=True)
class ChangeSettings:
    factory: Callable[[], EmbeddingProvider]
    options: ChunkOptions = ChunkOptions()
    text: str = "text"
    metadata: list[str] = field(default_factory=lambda: list(METADATA))
    source: str = "mongo"


def changed_points(effective: DataFrame, settings: ChangeSettings) -> DataFrame:
    """One row per new point, and one without a point for each document left with none.

    Columns ``seq, doc_id, id`` (NULL for no point), payload and ``vector``.
    """
    document = effective.schema["full_document"].dataType
    fields = [name for name in settings.metadata if name in document.names]
    upsert = F.col("action") == "upsert"
    docs = effective.select(
        "seq",
        "doc_id",
        F.when(upsert, F.col("full_document")[settings.text]).alias("text"),
        *[F.when(upsert, F.col("full_document")[name]).alias(name) for name in fields],
    )
    chunks = chunk_documents(
        docs,
        chunk_tokens=settings.options.chunk_tokens,
        overlap_percent=settings.options.overlap_percent,
        keep_sentences=settings.options.keep_sentences,
        keep=["seq", *fields],
        keep_empty=True,
    )
    return compose_payload(
        embed_texts(chunks, settings.factory),
        source=settings.source,
        synced_at=F.current_timestamp(),
        metadata=fields,
    ).withColumnsRenamed({"chunk_id": "id", "synced_at": "updated_at"})


def apply_changes(points: DataFrame, changes: DataFrame, settings: ChangeSettings) -> DataFrame:
    """Points after a batch of changes: those of changed documents give way to the new ones."""
    changed = stored(changed_points(effective_changes(changes, text=settings.text), settings), "changed")
    new = changed.where(F.col("id").isNotNull()).drop("seq")
    return without_keys(points, changed, "doc_id").unionByName(new, allowMissingColumns=True)


class ChangeLog:
    """Points as a log of changes: one folder per micro-batch below ``<path>/log``.

    A micro-batch writes only its own rows, in a folder named by its number, so
    running it again after a failure gives the same log; nothing already written
    is touched.  Reading takes the rows with the highest ``seq`` per document,
    so late or repeated changes do no harm.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def write_batch(self, changes: DataFrame, batch: int, settings: ChangeSettings) -> None:
        effective = effective_changes(changes, text=settings.text)
        changed_points(effective, settings).write.mode("overwrite").parquet(f"{self.path}/log/batch={batch}")

    def _log(self) -> DataFrame | None:
        try:
            return self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/log")
        except AnalysisException as problem:
            if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def _newest(self, log: DataFrame) -> DataFrame:
        # A change seen twice counts once, as written by the later batch.  Only the keys are compared; rows with their
        # vectors are joined afterwards, and stay where they are while the documents are few.
        newest = log.groupBy("doc_id").agg(F.max(F.struct("seq", "batch")).alias("newest")).select("doc_id", "newest.*")
        return log.join(small_side(newest), ["doc_id", "seq", "batch"], "left_semi")

    def points(self) -> DataFrame:
        """The current points of the documents in the log; none for a log without changes."""
        log = self._log()
        if log is None:
            return self.spark.createDataFrame([], "seq bigint, doc_id string, id string, vector array<double>")
        return self._newest(log).where(F.col("id").isNotNull()).drop("batch")

    def compact(self) -> int:
        """Fold all batches into one and drop them; returns how many there were.

        What is folded keeps each document's ``seq``, and a row without a point for documents that were deleted, so
        changes that come late still lose.  The folded batch gets a number below all others and is complete before any
        other goes: whatever fails, the log says the same.
        """
        log = self._log()
        if log is None:
            return 0
        folded = [r.batch for r in log.select("batch").distinct().collect()]
        if len(folded) < 2:
            return len(folded)
        base = min(0, *folded) - 1
        self._newest(log).drop("batch").write.mode("overwrite").parquet(f"{self.path}/log/batch={base}")
        for batch in folded:
            remove(self.spark, f"{self.path}/log/batch={batch}")
        return len(folded)

    def applied_to(self, base: DataFrame) -> DataFrame:
        """``base`` points with the log applied."""
        log = self._log()
        if log is None:
            return base
        return without_keys(base, log, "doc_id").unionByName(self.points().drop("seq"), allowMissingColumns=True)

    def follow(
        self, changes: DataFrame, checkpoint: str, settings: ChangeSettings, *, once: bool = False, every: str = "10 seconds"
    ) -> StreamingQuery:
        """Start a streaming query that applies ``changes``; ``once`` takes what there is and stops."""
        writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
            lambda batch, number: self.write_batch(batch, number, settings)
        )
        writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
        return writer.start()


def sheet_changes(
    rows: DataFrame,
    *,
    spreadsheet: str,
    sheet: str,
    key: str,
    text_columns: list[str],
    metadata_columns: list[str] | None = None,
) -> DataFrame:
    """Sheet rows (with ``seq``) as updates of the documents they describe."""
    metadata = metadata_columns or []
    docs = sheet_documents(
        sheet_cells(rows, ["seq"]),
        sheet=sheet,
        key=key,
        text_columns=text_columns,
        metadata_columns=metadata,
        keep=["seq"],
    )
    document = F.struct(
        "text", "row_key", F.lit(spreadsheet).alias("spreadsheet_id"), F.lit(sheet).alias("sheet_name"), *metadata
    )
    return docs.select("seq", F.lit("update").alias("op"), "doc_id", document.alias("full_document"))


def follow_sheet(
    log: ChangeLog,
    path: str,
    columns: list[str],
    checkpoint: str,
    settings: ChangeSettings,
    *,
    once: bool = True,
    every: str = "60 minutes",
    **sheet: object,
) -> StreamingQuery:
    """Take in every CSV export that appears below ``path``; later files, and later rows of a file, win.

    ``sheet`` holds the arguments of :func:`sheet_changes`.  With ``once`` the
    query takes what is new since its last run and stops, to be run on a schedule.
    """
    schema = ", ".join(f"`{name}` string" for name in columns)
    origin = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start")
    rows = (
        log.spark.readStream.schema(schema)
        .options(header=True, escape='"', multiLine=True)
        .csv(path)
        .select(*[f"`{name}`" for name in columns], origin.alias("_origin"))
    )

    def take(batch: DataFrame, number: int) -> None:
        seq = F.struct("_origin.*", F.monotonically_increasing_id().alias("row"))
        log.write_batch(sheet_changes(batch.withColumn("seq", seq).drop("_origin"), **sheet), number, settings)

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start()
