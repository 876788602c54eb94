"""Turn texts into vectors through a pluggable provider."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import Protocol, runtime_checkable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from nearfield.functions.vectors import arrow_vectors
from nearfield.session import stored

SLICE = 100  # fixed value: texts per provider call
WORD_GAP = "[ \\t\\n\\v\\f\\r]+"
BLOCK = 256  # texts whose words, or rows whose vectors, are held at a time


@runtime_checkable
class EmbeddingProvider(Protocol):
    """What an embedding model offers.  One instance is made per task, on the executor."""

    name: str
    dimensions: int
    max_input_tokens: int
    # A provider may also set ``slice_size``, the most texts per call (100 unless set), and for calls that may fail for a
    # while ``retries`` (0 unless set) and ``retry_wait``, the seconds before the first one, doubled before each further one.

    def embed_batch(self, texts: Sequence[str]) -> np.ndarray:
        """A ``len(texts) x dimensions`` matrix, rows in the order of ``texts``."""


class HashingProvider:
    """Deterministic bag of hashed words; no model, no network.

    A lower-cased word adds +1 or -1 to one of ``dimensions`` buckets, both taken
    from its md5.  Texts sharing words come out close; meaning plays no part.
    """

    name = "hashing"
    max_input_tokens = 8191
    slice_size = 2048

    def __init__(self, dimensions: int = 64, normalize: bool = True):
        self.dimensions = dimensions
        self.normalize = normalize
        self._slot = lru_cache(maxsize=1 << 15)(self._hash_word)

    def _hash_word(self, word: str) -> tuple[int, float]:
        if not word:
            return 0, 0.0
        digest = hashlib.md5(word.encode()).hexdigest()
        return int(digest[:8], 16) % self.dimensions, 1.0 if int(digest[8], 16) < 8 else -1.0

    def embed_batch(self, texts: Sequence[str]) -> np.ndarray:
        parts = [self._embed_block(texts[at : at + BLOCK]) for at in range(0, len(texts), BLOCK)]
        return np.concatenate(parts) if parts else np.zeros((0, self.dimensions))

    def _embed_block(self, texts: Sequence[str]) -> np.ndarray:
        words = pc.split_pattern_regex(pc.utf8_lower(pa.array(texts, pa.string())), WORD_GAP)
        coded = words.flatten().dictionary_encode()
        slots = np.array([self._slot(word) for word in coded.dictionary.to_pylist()]).reshape(-1, 2)[coded.indices]
        text = np.repeat(np.arange(len(texts)), pc.list_value_length(words))
        cell = text * self.dimensions + slots[:, 0].astype(np.int64)
        sums = np.bincount(cell, slots[:, 1], len(texts) * self.dimensions)
        vectors = sums.astype(np.float64).reshape(len(texts), self.dimensions)
        if self.normalize:
            norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
            np.divide(vectors, norms, out=vectors, where=norms > 0)
        return vectors


_PROVIDERS: dict[str, Callable[..., EmbeddingProvider]] = {"hashing": HashingProvider}


def register_provider(name: str, factory: Callable[..., EmbeddingProvider]) -> None:
    _PROVIDERS[name] = factory


def provider_factory(name: str, **options) -> Callable[[], EmbeddingProvider]:
    """A zero-argument factory for a registered provider."""
    if name not in _PROVIDERS:
        raise ValueError(f"unknown embedding provider '{name}'; known: {', '.join(sorted(_PROVIDERS))}")
    make = _PROVIDERS[name]
    return lambda: make(**options)


def embed_texts(
    df: DataFrame,
    factory: Callable[[], EmbeddingProvider],
    *,
    text: str = "text",
    vector: str = "vector",
    error: str | None = None,
    share_copies: bool = False,
) -> DataFrame:
    """Add ``vector``: the provider's vector of ``text`` (NULL for a NULL text).

    Within an Arrow batch each distinct text is sent once, in slices.
    ``share_copies`` first brings equal texts together (one shuffle), which pays
    for a costly model; adaptive execution splits the partition of a text that
    makes up much of the data, and each part sends it once.  With ``error`` a text the provider fails on gets a NULL vector and the message in that
    column; without, it fails the job.
    """

    def attempt(provider: EmbeddingProvider, texts: list[str]) -> np.ndarray:
        for left in range(getattr(provider, "retries", 0), -1, -1):
            try:
                return provider.embed_batch(texts)
            except Exception:
                if not left:
                    raise
                time.sleep(getattr(provider, "retry_wait", 0.5) * 2 ** (provider.retries - left))
        raise AssertionError

    def call(provider: EmbeddingProvider, texts: list[str]) -> tuple[np.ndarray, list[str | None]]:
        try:
            return attempt(provider, texts), [None] * len(texts)
        except Exception as problem:  # find the texts at fault by halves; the others get their vectors
            if error is None:
                raise
            if len(texts) == 1:
                return np.zeros((1, provider.dimensions)), [str(problem) or type(problem).__name__]
            half = len(texts) // 2
            parts = [call(provider, texts[:half]), call(provider, texts[half:])]
            return np.concatenate([rows for rows, _ in parts]), [m for _, found in parts for m in found]

    @arrow_udf("struct<vector:array<double>,error:string>")
    def embed(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        provider = factory()
        size = getattr(provider, "slice_size", SLICE)
        last: tuple[str, np.ndarray, str | None] | None = None
        for column in columns:
            codes = column.dictionary_encode()
            texts = codes.dictionary
            table = np.zeros((len(texts), provider.dimensions))
            failures: list[str | None] = [None] * len(texts)
            todo = list(range(len(texts)))
            if last is not None and len(texts) and texts[0].as_py() == last[0]:  # a run of copies goes on
                table[0], failures[0] = last[1:]
                todo = todo[1:]
            for at in range(0, len(todo), size):
                part = todo[at : at + size]
                table[part], messages = call(provider, texts.slice(part[0], len(part)).to_pylist())
                for i, message in zip(part, messages):
                    failures[i] = message
            if len(texts):
                tail = int(pc.max(codes.indices).as_py())  # new texts are coded in order of appearance
                last = (texts[tail].as_py(), table[tail].copy(), failures[tail])
            messages = pa.array([*failures, None], pa.string())
            table = np.vstack([table, np.zeros((1, provider.dimensions))])
            places = codes.indices.fill_null(len(texts)).to_numpy()
            for at in range(0, len(places), BLOCK):
                rows = places[at : at + BLOCK]
                vectors = arrow_vectors(table[rows])
                found = messages.take(pa.array(rows))
                absent = np.equal(rows, len(texts)) | found.is_valid().to_numpy(zero_copy_only=False)
                if absent.any():
                    vectors = pc.if_else(pa.array(absent), pa.scalar(None, vectors.type), vectors)
                yield pa.StructArray.from_arrays([vectors, found], ["vector", "error"])
            del column, codes, texts, table, messages
        pa.default_memory_pool().release_unused()

    if share_copies:
        together = df.withColumn("_copies", F.xxhash64(text)).hint("rebalance", F.col("_copies"))
        df = together.sortWithinPartitions("_copies").drop("_copies")
    both = df.withColumn("_result", embed.asNondeterministic()(F.col(text)))
    both = both.withColumn(vector, F.col("_result.vector"))
    return (both.withColumn(error, F.col("_result.error")) if error else both).drop("_result")


def attach_vectors(df: DataFrame, vectors: DataFrame, on: str, vector: str = "vector") -> DataFrame:
    """Add precomputed vectors by key; a row without one gets an empty vector."""
    joined = df.join(vectors.select(on, F.col(vector).alias("vector")), on, "left")
    empty = F.array().cast(vectors.schema[vector].dataType)
    return joined.withColumn("vector", F.coalesce("vector", empty))


def embed_summary(chunks: DataFrame, dimensions: int, *by: str) -> DataFrame:
    """Chunks, tokens and vector size, overall or per ``by``."""
    return chunks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("total_tokens"),
        F.lit(dimensions).alias("embedding_dimensions"),
    )


class EmbeddingCache:
    """Vectors of texts that were embedded before, in a table below ``path`` keyed by the digest of the text.

    A provider, by name and size, has a table of its own, so another model never gets its vectors.  One job at a time may
    add to a cache; a job that fails leaves it as it was or with whole new vectors, which the next one then finds.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, provider: EmbeddingProvider) -> str:
        return f"{self.path}/{provider.name}-{provider.dimensions}"

    def known(self, provider: EmbeddingProvider) -> DataFrame:
        """(digest, vector)"""
        try:
            return self.spark.read.schema("digest binary, vector array<double>").parquet(self._folder(provider))
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], "digest binary, vector array<double>")

    def embed(
        self,
        df: DataFrame,
        factory: Callable[[], EmbeddingProvider],
        *,
        text: str = "text",
        vector: str = "vector",
        error: str | None = None,
    ) -> DataFrame:
        """``embed_texts`` through the cache: only texts it doesn't know reach the provider, each of them once.

        What the provider returns is added before the result is put together; texts that fail are not, so they are
        tried again by the next run.  Equal texts are told apart before the vectors join them, and adaptive execution
        splits those that make up much of the data.
        """
        provider = factory()
        rows = df.withColumn("_digest", F.unhex(F.sha2(F.col(text), 256)))
        texts = rows.where(F.col(text).isNotNull()).select("_digest", F.col(text).alias("text")).dropDuplicates(["_digest"])
        unknown = texts.join(self.known(provider).select(F.col("digest").alias("_digest")), "_digest", "left_anti")
        tried = embed_texts(unknown, factory, vector="vector", error="error" if error else None)
        tried = stored(tried.drop("text"), "embedded")
        good = tried.where(F.col("error").isNull()) if error else tried
        good.select(F.col("_digest").alias("digest"), F.col("vector")).write.mode("append").parquet(self._folder(provider))
        found = self.known(provider).select(F.col("digest").alias("_digest"), F.col("vector").alias(vector))
        joined = rows.join(found, "_digest", "left")
        if error:
            failed = tried.where(F.col("error").isNotNull()).select("_digest", F.col("error").alias(error))
            joined = joined.join(failed, "_digest", "left")
        return joined.select(*df.columns, vector, *([error] if error else []))
