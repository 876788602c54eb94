"""Answer a table of queries: embed, filter, search, re-rank, project."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.filters import Filter, check
from nearfield.operators.embedding import EmbeddingProvider, embed_texts
from nearfield.operators.index import search_index
from nearfield.operators.rerank import (
    DEFAULT_DIVERSITY_WEIGHT,
    DEFAULT_FETCH_K,
    DEFAULT_LAMBDA,
    rerank_diversity,
    rerank_mmr,
)
from nearfield.operators.search import BROADCAST_ROWS, MAX_K, attach_payload, search, small_batch
from nearfield.session import stored


@dataclass(frozen=True)
class QueryOptions:
    """One request's settings, shared by all queries of the table."""

    top_k: int = 10
    where: Filter | None = None
    metric: str = "cosine"
    threshold: float | None = None
    payload: list[str] = field(default_factory=list)
    with_vectors: bool = False
    mmr: bool = False
    mmr_lambda: float = DEFAULT_LAMBDA
    fetch_k: int = DEFAULT_FETCH_K
    diversity: bool = False
    diversity_weight: float = DEFAULT_DIVERSITY_WEIGHT
    probes: int | None = 4  # cells of an index that a query reads; None is all
    wanted_recall: float | None = None  # ... or as many as reach this by measurement

    def __post_init__(self):
        for name, value, low, high in (
            ("top_k", self.top_k, 1, MAX_K),
            ("fetch_k", self.fetch_k, 1, MAX_K),
            ("mmr_lambda", self.mmr_lambda, 0, 1),
            ("diversity_weight", self.diversity_weight, 0, 1),
            ("probes", 1 if self.probes is None else self.probes, 1, float("inf")),
            ("wanted_recall", 0 if self.wanted_recall is None else self.wanted_recall, 0, 1),
            ("threshold", 0 if self.threshold is None or self.metric != "cosine" else self.threshold, 0, 1),
        ):
            if not low <= value <= high:
                raise ValueError(f"{name} must be between {low} and {high}")
        if self.where is not None:
            check(self.where)

    @property
    def reranks(self) -> bool:
        return self.mmr or self.diversity

    @property
    def fetch(self) -> int:
        """Hits to fetch before re-ranking."""
        return max(self.top_k, self.fetch_k) if self.reranks else self.top_k


def query_vectors(
    queries: DataFrame,
    factory: Callable[[], EmbeddingProvider] | None = None,
    *,
    text: str = "text",
    vector: str = "vector",
) -> DataFrame:
    """``query_id, vector``: a query's own vector where it has one, else its embedded text.

    Embedded texts are stored, so that the provider runs once however often the result is read.
    """
    if text not in queries.columns:
        return queries.select("query_id", vector)
    if factory is None:
        raise ValueError("text queries need an embedding provider")
    if vector not in queries.columns:
        embedded = embed_texts(queries.select("query_id", text), factory, text=text, vector=vector)
        return stored(embedded.drop(text), "queries")
    missing = F.when(F.col(vector).isNull(), F.col(text))
    embedded = embed_texts(queries.withColumn("_text", missing), factory, text="_text", vector="_embedded")
    own = F.col(vector).cast("array<double>")
    return stored(embedded.select("query_id", F.coalesce(own, F.col("_embedded")).alias(vector)), "queries")


def run_queries(
    points: DataFrame | None,
    queries: DataFrame,
    options: QueryOptions = QueryOptions(),
    *,
    index: str | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``query_id, rank, id, score`` plus payload, plus ``original_score, mmr_score`` after re-ranking.

    Points carry ``id, vector`` and payload columns, queries ``query_id, vector``.
    MMR wins where both re-rankers are on.  Vectors and payload join only the hits.
    With ``index``, the path of a cell index, its points are searched (with its
    metric), filter, threshold and re-ranking included; ``points`` is not used.
    """
    if index is not None:
        spark = queries.sparkSession
        points = spark.read.parquet(f"{index}/points")
        number = queries.count()
        few = number <= broadcast_rows
        hits = search_index(
            spark,
            index,
            queries,
            options.fetch,
            probes=options.probes,
            wanted_recall=options.wanted_recall,
            where=options.where,
            threshold=options.threshold,
            broadcast_rows=broadcast_rows,
        )
        most = options.fetch * number if few else None
    else:
        batch = small_batch(queries, "query_id", "vector", broadcast_rows)
        few = batch is not None
        hits = search(
            points,
            queries,
            options.fetch,
            metric=options.metric,
            where=options.where,
            threshold=options.threshold,
            broadcast_rows=broadcast_rows,
            batch=batch,
        )
        # A proven bound on the hits, where the queries are few.
        most = options.fetch * len(batch) if few else None
    columns = list(dict.fromkeys([*options.payload, *(["vector"] if options.with_vectors else [])]))
    if not options.reranks:
        return attach_payload(hits, points, columns, most_hits=most) if columns else hits

    # Vectors and payload of all hits in one read; both steps below take them from here.
    with_vectors = stored(attach_payload(hits, points, list(dict.fromkeys(["vector", *columns])), most_hits=most), "hits")
    if options.mmr:
        own = queries.select("query_id", F.col("vector").alias("query_vector"))
        paired = with_vectors.join(F.broadcast(own) if few else own, "query_id")
        picked = rerank_mmr(paired, top_k=options.top_k, lambda_=options.mmr_lambda, fetch_k=options.fetch_k)
    else:
        picked = rerank_diversity(with_vectors, top_k=options.top_k, weight=options.diversity_weight)
    ranked = picked.select(
        "query_id", F.col("mmr_rank").alias("rank"), "id", F.col("original_score").alias("score"), "mmr_score"
    )
    if not columns:
        return ranked
    found = with_vectors.select("query_id", "id", *columns)
    return ranked.join(F.broadcast(found) if most is not None and most <= 1_000_000 else found, ["query_id", "id"]).select(
        *ranked.columns, *columns
    )


def query_summary(results: DataFrame, queries: DataFrame, options: QueryOptions) -> DataFrame:
    """One row per query: hits asked for and returned, and which re-ranker ran (none on an empty result)."""
    counts = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    actual = F.coalesce("n", F.lit(0))
    return queries.select("query_id").join(counts, "query_id", "left").select(
        "query_id",
        F.lit(options.top_k).alias("top_k"),
        actual.alias("actual_k"),
        ((actual > 0) & F.lit(options.mmr)).alias("mmr_applied"),
        ((actual > 0) & F.lit(options.diversity and not options.mmr)).alias("diversity_applied"),
    )
