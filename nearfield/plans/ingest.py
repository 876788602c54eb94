"""Documents in, points out: embed requests, bulk sync and sheet sync."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions import text as tx
from nearfield.operators.chunking import chunk_documents, with_chunk_count
from nearfield.operators.embedding import EmbeddingCache, EmbeddingProvider, embed_texts
from nearfield.operators.points import small_side, without_keys
from nearfield.session import stored
from nearfield.sources.sheets import sheet_documents
from nearfield.sources.tables import PointTable

Factory = Callable[[], EmbeddingProvider]


@dataclass(frozen=True)
class ChunkOptions:
    """Limits of a request: 50 to 2000 tokens, 0 to 50 percent overlap."""

    chunk_tokens: int = tx.DEFAULT_CHUNK_TOKENS
    overlap_percent: float = tx.DEFAULT_OVERLAP_PERCENT
    keep_sentences: bool = True

    def __post_init__(self):
        if not 50 <= self.chunk_tokens <= 2000:
            raise ValueError("chunk_tokens must be between 50 and 2000")
        if not 0 <= self.overlap_percent <= 50:
            raise ValueError("overlap_percent must be between 0 and 50")


def split_valid(docs: DataFrame, max_tokens: int, *, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents that may be embedded, and the others with a ``reason``."""
    judged = docs.withColumn("reason", tx.validation_reason(F.col(text), max_tokens))
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())


def embed_documents(
    docs: DataFrame,
    factory: Factory,
    options: ChunkOptions = ChunkOptions(),
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
    share_copies: bool = False,
    max_tokens: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Chunks of every valid document with their vectors, and the other documents with a ``reason``.

    ``max_tokens`` is the longest text taken, by default what the provider takes.
    """
    most = factory().max_input_tokens if max_tokens is None else max_tokens
    accepted, rejected = split_valid(docs, most, text=text)
    chunks = chunk_documents(
        accepted,
        doc_id=doc_id,
        text=text,
        chunk_tokens=options.chunk_tokens,
        overlap_percent=options.overlap_percent,
        keep_sentences=options.keep_sentences,
        keep=keep,
    )
    return embed_texts(chunks, factory, share_copies=share_copies), rejected


def sync_action(text: Column, embedding: Column, re_embed: bool = True) -> Column:
    """``process``, ``skip_no_text`` or ``skip_embedded``."""
    skip = embedding.isNotNull() & F.lit(not re_embed)
    return (
        F.when(~tx.usable_text(text), F.lit("skip_no_text"))
        .when(skip, F.lit("skip_embedded"))
        .otherwise(F.lit("process"))
    )


def compose_payload(docs: DataFrame, *, source: str, synced_at: Column, metadata: list[str], doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, source, synced_at`` and metadata columns; a document's own value overrides the base one."""
    base = {"doc_id": F.col(doc_id), "source": F.lit(source), "synced_at": synced_at}
    own = {name: F.col(f"`{name}`") for name in metadata}
    merged = {
        **{name: F.coalesce(own[name], value) if name in own else value for name, value in base.items()},
        **{name: value for name, value in own.items() if name not in base},
    }
    rest = [c for c in docs.columns if c not in merged and c != doc_id]
    return docs.select(*[value.alias(name) for name, value in merged.items()], *rest)


def sync_preview(
    docs: DataFrame,
    options: ChunkOptions = ChunkOptions(),
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    embedding: str = "embedding",
    re_embed: bool = True,
) -> DataFrame:
    """What a sync would do: ``doc_id, chunks, has_embedding, text_length`` of each document it would take."""
    taken = docs.where(sync_action(F.col(text), F.col(embedding), re_embed) == "process").select(
        F.col(doc_id).alias("doc_id"), F.col(embedding).isNotNull().alias("has_embedding"), F.col(text).alias("text")
    )
    counted = with_chunk_count(
        taken,
        chunk_tokens=options.chunk_tokens,
        overlap_percent=options.overlap_percent,
        keep_sentences=options.keep_sentences,
    )
    return counted.select("doc_id", "chunks", "has_embedding", F.length("text").alias("text_length"))


def sync_stats(
    docs: DataFrame,
    options: ChunkOptions = ChunkOptions(),
    *,
    text: str = "text",
    embedding: str = "embedding",
    re_embed: bool = True,
    dry_run: bool = False,
) -> DataFrame:
    """One row of counts for a sync; a dry run writes no points."""
    takes = F.col("action") == "process"
    judged = docs.select(
        sync_action(F.col(text), F.col(embedding), re_embed).alias("action"), F.col(text).alias("text")
    ).withColumn("text", F.when(takes, F.col("text")))
    counted = with_chunk_count(
        judged,
        chunk_tokens=options.chunk_tokens,
        overlap_percent=options.overlap_percent,
        keep_sentences=options.keep_sentences,
    )
    chunks = F.coalesce(F.sum("chunks"), F.lit(0)).cast("bigint")
    return counted.agg(
        F.count_if(takes).alias("documents_processed"),
        chunks.alias("chunks_created"),
        (F.lit(0).cast("bigint") if dry_run else chunks).alias("points_upserted"),
        F.count_if(~takes).alias("documents_skipped"),
    )


def sync_points(
    docs: DataFrame,
    factory: Factory,
    options: ChunkOptions = ChunkOptions(),
    *,
    synced_at: Column,
    source: str = "mongo",
    metadata: list[str] | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    embedding: str | None = "embedding",
    re_embed: bool = True,
    share_copies: bool = False,
    error: str | None = None,
    cache: EmbeddingCache | None = None,
) -> DataFrame:
    """The points a bulk sync produces; replace those of the same documents with ``replace_docs``.

    With ``error`` failures of the provider are kept in that column, for :func:`settle`.
    With a ``cache`` only texts that it doesn't know reach the provider.
    """
    known = F.col(embedding) if embedding else F.lit(None)
    taken = docs.where(sync_action(F.col(text), known, re_embed) == "process")
    fields = [name for name in metadata or [] if name != text]
    chunks = chunk_documents(
        taken,
        doc_id=doc_id,
        text=text,
        chunk_tokens=options.chunk_tokens,
        overlap_percent=options.overlap_percent,
        keep_sentences=options.keep_sentences,
        keep=fields,
    )
    if cache is not None:
        points = cache.embed(chunks, factory, error=error)
    else:
        points = embed_texts(chunks, factory, share_copies=share_copies, error=error)
    composed = compose_payload(points, source=source, synced_at=synced_at, metadata=fields)
    return composed.withColumnRenamed("chunk_id", "id")


def settle(points: DataFrame, *, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """The points of documents embedded in full, and ``doc_id, error`` of each document that failed.

    The points are stored first, so the provider runs once.
    """
    tried = stored(points, "embedded")
    failed = failures(tried, error=error)
    return without_keys(tried.drop(error), failed, "doc_id"), failed


def failures(tried: DataFrame, *, error: str = "error") -> DataFrame:
    """``doc_id, error`` of each document of which a chunk failed."""
    return tried.where(F.col(error).isNotNull()).groupBy("doc_id").agg(F.min(error).alias("error"))


HASH = "content_hash"  # payload column: what a document's points were made from


def content_hash(docs: DataFrame, factory: Factory, options: ChunkOptions, *, text: str, metadata: list[str]) -> Column:
    """A number that changes with a document's text, its metadata, how it is cut, and the model."""
    provider = factory()
    how = (provider.name, provider.dimensions, options.chunk_tokens, options.overlap_percent, options.keep_sentences)
    fields = [F.coalesce(F.to_json(F.struct(F.col(f"`{name}`"))), F.lit("")) for name in metadata if name != text]
    return F.xxhash64(F.col(f"`{text}`"), *fields, F.lit(str(how)))


def compare_documents(docs: DataFrame, points: DataFrame, digest: Column, *, doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, state`` of every document of the source or of the table: new, changed, same or gone.

    ``digest`` is the documents' own; points carry theirs in ``content_hash``.  Only ids and digests are compared, in one
    full join; ids of the source must be unique.  Documents without a point are new, however often they are synced.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), digest.alias("own"))
    kept = F.col(HASH) if HASH in points.columns else F.lit(None).cast("bigint")
    known = points.select(F.col("doc_id").cast(own.schema["doc_id"].dataType).alias("doc_id"), kept.alias("kept"))
    one = F.when(F.min("kept") == F.max("kept"), F.min("kept")).alias("kept")
    known = known.groupBy("doc_id").agg(one, F.lit(True).alias("known"))
    state = (
        F.when(F.col("known").isNull(), F.lit("new"))
        .when(F.col("own").isNull(), F.lit("gone"))
        .when(F.coalesce(F.col("own") == F.col("kept"), F.lit(False)), F.lit("same"))
        .otherwise(F.lit("changed"))
    )
    return own.join(known, "doc_id", "full").select("doc_id", state.alias("state"))


def run_sync(
    docs: DataFrame,
    table: PointTable,
    factory: Factory,
    options: ChunkOptions = ChunkOptions(),
    *,
    synced_at: Column,
    re_embed: bool = True,
    doc_id: str = "doc_id",
    text: str = "text",
    embedding: str | None = "embedding",
    metadata: list[str] | None = None,
    only_changed: bool = False,
    drop_gone: bool = False,
    **more,
) -> tuple[DataFrame, DataFrame]:
    """A bulk sync from documents to the points table: one row of counts of what was done, and ``doc_id, error``.

    A document of which any chunk fails keeps its old points; those of all others that are processed are replaced, also
    where a text has become blank and leaves none.  Points remember a digest of what they were made from: with
    ``only_changed`` documents whose digest is still the same are neither embedded nor rewritten, and with ``drop_gone``
    the points of documents that the source no longer has are deleted.  A document that was replaced has its old points
    nowhere else, as a document is one bucket of the table.
    """
    fields = list(metadata or [])
    digest = content_hash(docs, factory, options, text=text, metadata=fields)
    action = sync_action(F.col(text), F.col(embedding) if embedding else F.lit(None), re_embed)
    taken, same, gone = docs.where(action == "process"), 0, None
    if only_changed or drop_gone:
        states = stored(compare_documents(docs, table.read(), digest, doc_id=doc_id), "states")
        if only_changed:
            unchanged = states.where("state = 'same'").select(F.col("doc_id").alias(doc_id))
            same = docs.where(action == "process").join(unchanged, doc_id, "left_semi").count()
            taken = taken.join(small_side(states.where("state in ('new', 'changed')").select(F.col("doc_id").alias(doc_id))), doc_id, "left_semi")
        if drop_gone:
            gone = states.where("state = 'gone'").select("doc_id")
    taken = taken.withColumn(HASH, digest)
    points = sync_points(
        taken, factory, options, synced_at=synced_at, re_embed=re_embed, doc_id=doc_id, text=text, embedding=embedding, error="error",
        metadata=[*fields, HASH], **more,
    )
    tried = stored(points, "embedded")
    failed = stored(failures(tried), "failed")
    new = without_keys(tried.drop("error"), failed, "doc_id")  # read from there again; a copy would only take room
    written = new.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim")).first()
    replaced = without_keys(taken.select(F.col(doc_id).alias("doc_id")), failed, "doc_id")
    if gone is not None:
        replaced = replaced.unionByName(gone)
    if written.n:
        table.ensure(written.dim, (table.spec() or (None, "cosine"))[1])
    if written.n or table.spec() is not None:
        table.replace(new, replaced, kept=True)
    errors = failed.count()
    stats = docs.agg(
        (F.count_if(action == "process") - errors - same).alias("documents_processed"),
        F.lit(written.n).cast("bigint").alias("chunks_created"),
        F.lit(written.n).cast("bigint").alias("points_upserted"),
        F.count_if(action != "process").alias("documents_skipped"),
        F.lit(errors).cast("bigint").alias("errors"),
    )
    if only_changed or drop_gone:
        dropped = gone.count() if gone is not None else 0
        stats = stats.withColumns({"documents_unchanged": F.lit(same).cast("bigint"), "documents_dropped": F.lit(dropped).cast("bigint")})
    return stats, failed


def sync_sheet(
    rows: DataFrame,
    factory: Factory,
    options: ChunkOptions = ChunkOptions(),
    *,
    spreadsheet: str,
    sheet: str,
    key: str,
    text_columns: list[str],
    metadata_columns: list[str] | None = None,
    order: list[str],
    synced_at: Column,
    error: str | None = None,
) -> DataFrame:
    """The points of a sheet: the last row of each key, chunked and embedded.

    With ``error`` failures of the provider are kept in that column, for :func:`settle`.
    """
    metadata = metadata_columns or []
    docs = sheet_documents(
        rows, sheet=sheet, key=key, text_columns=text_columns, metadata_columns=metadata, order=order
    )
    chunks = chunk_documents(
        docs,
        chunk_tokens=options.chunk_tokens,
        overlap_percent=options.overlap_percent,
        keep_sentences=options.keep_sentences,
        keep=["row_key", *metadata],
    )
    return embed_texts(chunks, factory, error=error).select(
        F.col("chunk_id").alias("id"),
        "doc_id",
        F.lit("google_sheets").alias("source"),
        F.lit(spreadsheet).alias("spreadsheet_id"),
        F.lit(sheet).alias("sheet_name"),
        synced_at.alias("synced_at"),
        "row_key",
        "chunk_index",
        "start_index",
        "end_index",
        "text",
        "vector",
        *metadata,
        *([error] if error else []),
    )
