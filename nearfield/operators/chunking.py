"""Split documents into overlapping chunks."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from nearfield.functions import text as tx

SEARCH_RADIUS = 200  # fixed value: furthest a sentence end is looked for, in characters
RADIUS_SHARE = 0.1  # fixed value: ... and at most this share of the text
TEXTS = 64  # texts that a task has in hand at a time
SHIFT_SHARE = 0.3  # fixed value: a sentence end must lie within this share of the chunk size


def chunk_sizes(chunk_tokens: int, overlap_percent: float) -> tuple[int, int]:
    """Chunk length and overlap in characters."""
    if chunk_tokens < 1 or not 0 <= overlap_percent < 100:
        raise ValueError("chunk_tokens must be positive and overlap_percent in [0, 100)")
    size = tx.tokens_to_chars(chunk_tokens)
    return size, math.floor(size * (overlap_percent / 100))


def chunk_documents(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    chunk_tokens: int = tx.DEFAULT_CHUNK_TOKENS,
    overlap_percent: float = tx.DEFAULT_OVERLAP_PERCENT,
    keep_sentences: bool = True,
    min_chars: int = tx.DEFAULT_MIN_CHARS,
    keep: list[str] | None = None,
    keep_empty: bool = False,
) -> DataFrame:
    """One row per chunk: ``doc_id, chunk_id, chunk_index, start_index, end_index, text, tokens``.

    A text shorter than ``min_chars`` is one chunk; otherwise chunks whose
    trimmed text is shorter are dropped.  Indexes count the untrimmed text.
    ``chunk_id`` depends only on the document id, the position and the options.
    ``keep`` names further document columns to carry along (not the text itself).
    ``keep_empty`` keeps one row without a chunk for a document that has none.
    """
    size, overlap = chunk_sizes(chunk_tokens, overlap_percent)
    options = f"{chunk_tokens}/{overlap_percent:g}/{int(keep_sentences)}/{min_chars}"
    source = docs if keep_empty else docs.where(F.col(text).isNotNull())
    kept = [F.col(name) for name in keep or []]
    key = F.col(doc_id).alias("doc_id")
    if keep_sentences:
        cut = _sentence_cutter(size, overlap, min_chars)
        explode = F.inline_outer if keep_empty else F.inline
        rows = source.select(key, *kept, explode(cut(F.col(text))))
    else:
        explode = F.posexplode_outer if keep_empty else F.posexplode
        rows = _fixed_chunks(source, key, kept, F.col(text), size, overlap, min_chars, explode)
    chunk_id = tx.name_uuid(F.col("doc_id"), F.col("chunk_index"), F.col("start_index"), F.lit(options))
    return rows.select(
        "doc_id",
        F.when(F.col("chunk_index").isNotNull(), chunk_id).alias("chunk_id"),
        "chunk_index",
        "start_index",
        "end_index",
        F.col("chunk_text").alias("text"),
        "tokens",
        *(keep or []),
    )


def _fixed_chunks(
    source: DataFrame, key: Column, kept: list[Column], text: Column, size: int, overlap: int, min_chars: int, explode
) -> DataFrame:
    """Fixed-size chunks inside the JVM.

    One regex pass cuts the text into strides of ``size - overlap``; a chunk is
    a stride and the head of what follows, so the cost is linear in the text.
    """
    stride = size - overlap
    length = F.length(text)
    heads = math.ceil(overlap / stride)  # following strides a chunk reaches into
    pieces = source.select(
        key,
        *kept,
        length.alias("_length"),
        F.when(length < min_chars, F.array(text))
        .otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{stride}}}"), F.lit(0)))
        .alias("_pieces"),
    )
    count = F.when(F.col("_length") <= size, 1).otherwise(
        F.lit(1) + F.ceil((F.col("_length") - size) / F.lit(stride)).cast("int")
    )

    def assemble(piece: Column, index: Column) -> Column:
        following = [F.coalesce(F.get(F.col("_pieces"), index + i), F.lit("")) for i in range(1, heads + 1)]
        body = tx.trim(F.concat(piece, F.substring(F.concat(*following), 1, overlap)) if heads else piece)
        start = index * stride
        return F.struct(
            start.alias("start_index"),
            F.least(start + size, F.col("_length")).alias("end_index"),
            body.alias("chunk_text"),
        )

    chunks = F.transform(F.slice(F.col("_pieces"), F.lit(1), count), assemble)
    long_enough = F.filter(chunks, lambda c: (F.col("_length") < min_chars) | (F.length(c["chunk_text"]) >= min_chars))
    numbered = pieces.select("doc_id", *kept, "_length", explode(long_enough).alias("chunk_index", "c"))
    counted = F.when(F.col("_length") < min_chars, F.col("_length")).otherwise(F.length("c.chunk_text"))
    tokens = F.ceil(counted / F.lit(tx.CHARS_PER_TOKEN)).cast("int")
    return numbered.select("doc_id", *kept, "chunk_index", "c.*", tokens.alias("tokens"))


CHUNK_TYPE = "array<struct<chunk_index:int,start_index:int,end_index:int,chunk_text:string,tokens:int>>"


def _cutter(size: int, overlap: int, min_chars: int, keep_sentences: bool = True):
    """The function that cuts a text into ``(start, end, trimmed text)``."""
    sentence_end = re.compile(f"[.!?]{tx.WHITESPACE_CLASS}+")
    blank = tx.WHITESPACE
    radius_cap, radius_share, shift = SEARCH_RADIUS, RADIUS_SHARE, SHIFT_SHARE * size

    def end_near(text: str, target: int, radius: int) -> int:
        window = sentence_end.finditer(text, max(0, target - radius), min(len(text), target + radius))
        nearest = min((m.end() for m in window), key=lambda at: abs(at - target), default=target)
        return nearest if abs(nearest - target) < min(radius, shift) else target

    def spans(text: str) -> Iterator[tuple[int, int]]:
        if not keep_sentences:
            for start in range(0, max(1, len(text) - overlap), size - overlap):
                yield start, min(start + size, len(text))
            return
        last, radius = len(text), min(radius_cap, int(len(text) * radius_share))
        start = end = 0
        while end < last:
            end = start + size
            end = last if end >= last else end_near(text, end, radius)
            yield start, end
            start = max(start + 1, end - overlap)

    def cut(text: str) -> list[tuple[int, int, str]]:
        if len(text) < min_chars:
            return [(0, len(text), text.strip(blank))]
        trimmed = ((s, e, text[s:e].strip(blank)) for s, e in spans(text))
        return [chunk for chunk in trimmed if len(chunk[2]) >= min_chars]

    return cut


def _chunk_counter(size: int, overlap: int, min_chars: int, keep_sentences: bool):
    """Arrow UDF from texts to numbers of chunks."""
    cut, most = _cutter(size, overlap, min_chars, keep_sentences), TEXTS

    @arrow_udf("int")
    def chunk_count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            for at in range(0, len(column), most):
                yield pa.array([0 if text is None else len(cut(text)) for text in column.slice(at, most).to_pylist()], pa.int32())

    return chunk_count


def _sentence_cutter(size: int, overlap: int, min_chars: int):
    """An Arrow UDF: text -> array of chunks that end at sentence ends where one is near."""
    cut, per_token, most = _cutter(size, overlap, min_chars), tx.CHARS_PER_TOKEN, TEXTS

    @arrow_udf(CHUNK_TYPE)
    def sentence_chunks(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in (column.slice(at, most) for column in columns for at in range(0, len(column), most)):
            offsets, index, start, end, body, tokens = [0], [], [], [], [], []
            for text in texts.to_pylist():
                chunks = cut(text) if text is not None else []
                for i, (s, e, piece) in enumerate(chunks):
                    counted = len(text) if len(text) < min_chars else len(piece)
                    index.append(i)
                    start.append(s)
                    end.append(e)
                    body.append(piece)
                    tokens.append(-(-counted // per_token))
                offsets.append(len(index))
            fields = [pa.array(v, t) for v, t in (
                (index, pa.int32()), (start, pa.int32()), (end, pa.int32()), (body, pa.string()), (tokens, pa.int32()))]
            rows = pa.StructArray.from_arrays(
                fields, ["chunk_index", "start_index", "end_index", "chunk_text", "tokens"])
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)

    return sentence_chunks


def with_chunk_count(
    docs: DataFrame,
    *,
    text: str = "text",
    name: str = "chunks",
    chunk_tokens: int = tx.DEFAULT_CHUNK_TOKENS,
    overlap_percent: float = tx.DEFAULT_OVERLAP_PERCENT,
    keep_sentences: bool = True,
    min_chars: int = tx.DEFAULT_MIN_CHARS,
) -> DataFrame:
    """Add the number of chunks of each text (0 for NULL), without a shuffle and without making the chunks."""
    size, overlap = chunk_sizes(chunk_tokens, overlap_percent)
    return docs.withColumn(name, _chunk_counter(size, overlap, min_chars, keep_sentences)(F.col(text)))


def split_sentences(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per sentence: ``doc_id, sentence_index, sentence``."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.posexplode(tx.sentences(F.col(text))).alias("sentence_index", "sentence")
    )


def chunk_stats(chunks: DataFrame, *by: str) -> DataFrame:
    """Number of chunks and average chunk length, overall or per ``by``; NULL average of no chunks."""
    return chunks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("chunks"), F.avg(F.length("text")).alias("avg_chunk_chars")
    )
