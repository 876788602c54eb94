"""Exact similarity search of a table of queries against a table of points."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.filters import Filter, compile_filter
from nearfield.functions.vectors import METRICS, matrix
from nearfield.operators.blockjoin import block_counts, block_rows, meet
from nearfield.operators.topk import BestK, partial_rows

MAX_K = 1000  # fixed value: largest topK and fetchK of a request
BROADCAST_ROWS = 8192  # most queries that are sent to every task
BROADCAST_BYTES = 128 << 20  # ... and most bytes of query vectors
STATE_ROWS = 4_000_000  # most hits a task keeps at a time, over all its queries
MERGE_SPREAD = 64  # first-level groups per query when partial results are merged


@dataclass(frozen=True)
class QueryBatch:
    """A set of queries small enough for every task."""

    ids: pa.Array
    vectors: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)


def fetch_batch(queries: DataFrame, query_id: str = "query_id", vector: str = "vector") -> QueryBatch:
    table = queries.select(query_id, vector).where(F.col(vector).isNotNull()).toArrow()
    ids = table.column(0).combine_chunks()
    if not table.num_rows:
        return QueryBatch(ids, np.zeros((0, 1)))
    vectors = table.column(1).combine_chunks()
    return QueryBatch(ids, matrix(vectors, len(vectors[0])))


def batch_rows(width: int, k: int, most: int = BROADCAST_ROWS) -> int:
    """How many queries of ``width`` values one batch may hold."""
    return max(1, min(most, STATE_ROWS // k, BROADCAST_BYTES // (8 * max(1, width))))


def measure(queries: DataFrame, vector: str) -> tuple[int, int]:
    """Number of queries and the longest vector, before any is fetched."""
    row = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size(vector)), F.lit(1)).alias("width")).first()
    return row["n"], max(1, row["width"])


def small_batch(
    queries: DataFrame, query_id: str, vector: str, max_rows: int = BROADCAST_ROWS, k: int = 1
) -> QueryBatch | None:
    """The queries, if they fit one batch: counted and measured first, and fetched only then."""
    n, width = measure(queries, vector)
    return fetch_batch(queries, query_id, vector) if n <= min(max_rows, batch_rows(width, k)) else None


def search(
    points: DataFrame,
    queries: DataFrame,
    k: int = 10,
    *,
    metric: str = "cosine",
    where: Filter | None = None,
    threshold: float | None = None,
    id: str = "id",
    vector: str = "vector",
    query_id: str = "query_id",
    query_vector: str = "vector",
    broadcast_rows: int = BROADCAST_ROWS,
    batch: QueryBatch | None = None,
) -> DataFrame:
    """The ``k`` best points of every query: ``query_id, rank, id, score``.

    ``where`` is applied before ranking, ``threshold`` keeps scores at or above
    it (distances at or below it).  Ties go to the smaller id.  Query ids must be
    unique.  At most ``broadcast_rows`` queries go to every task and the points stay
    where they are; more of them meet the points block by block (``blockjoin``).
    ``batch`` is what ``small_batch`` returned for the queries, if already at hand.
    """
    check_request(k, metric)
    if batch is None or len(batch) > min(broadcast_rows, STATE_ROWS // k):
        batch = small_batch(queries, query_id, query_vector, broadcast_rows, k)
    candidates = points.where(compile_filter(where, points.schema)) if where else points
    candidates = candidates.where(F.col(vector).isNotNull()).select(F.col(id).alias("id"), F.col(vector).alias("vector"))
    asked = queries.where(F.col(query_vector).isNotNull()).select(
        F.col(query_id).alias("query_id"), F.col(query_vector).alias("vector")
    )
    schema = partial_schema(candidates, asked)
    if batch is not None:
        partial = scan_points(candidates, batch, k, metric, threshold, schema)
    else:
        n, width = measure(asked, "vector")
        partial = _by_blocks(candidates, asked, n, width, k, metric, threshold, schema)
    return merge_best(partial, k, metric)


def check_request(k: int, metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"unknown metric '{metric}'; use {', '.join(METRICS)}")
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be between 1 and {MAX_K}")


def partial_schema(points: DataFrame, queries: DataFrame) -> str:
    id_type = points.schema["id"].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()
    return f"query_id {query_type}, id {id_type}, score double, part int"


def scan_points(
    points: DataFrame,
    batch: QueryBatch,
    k: int,
    metric: str,
    threshold: float | None,
    schema: str,
    routes: np.ndarray | None = None,
) -> DataFrame:
    """One pass over the points; a task returns at most ``k`` rows per query, however many points it reads.

    With ``routes`` (queries x cells, boolean) points carry a ``cell`` and meet
    only the queries routed to it.
    """
    context = points.sparkSession.sparkContext
    shared = context.broadcast((batch.ids, batch.vectors, routes))

    def scan(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vectors, allowed = shared.value
        best = BestK(vectors, k, metric, threshold)
        id_type = None
        for block in blocks:
            if not block.num_rows or not len(query_ids):
                continue
            id_type = block.column(0).type
            ids = block.column(0).to_numpy(zero_copy_only=False)
            rows = matrix(block.column(1), vectors.shape[1])
            if allowed is None:
                best.offer(ids, rows)
                continue
            cells = block.column(2).to_numpy()
            for cell in np.unique(cells):
                here = cells == cell
                best.offer(ids[here], rows[here], np.nonzero(allowed[:, cell])[0])
        if id_type is not None:
            yield partial_rows(best, query_ids, id_type, TaskContext.get().partitionId())

    return points.mapInArrow(scan, schema)


def _by_blocks(
    points: DataFrame, queries: DataFrame, n: int, width: int, k: int, metric: str, threshold: float | None, schema: str
) -> DataFrame:
    """Queries that are too many for one batch meet the points block by block, in tasks."""
    sizes = [(0, n, points.count())]
    parts = block_counts(sizes, block_rows(width, k), 2 * points.sparkSession.sparkContext.defaultParallelism)
    cell = F.lit(0).alias("cell")
    asked = queries.select(cell, "query_id", "vector")
    return meet(points.select(cell, "id", "vector"), asked, parts, k, metric, threshold, width, schema)


def merge_best(partial: DataFrame, k: int, metric: str) -> DataFrame:
    """Rank partial results (``query_id, id, score, part``) and keep the ``k`` best per query.

    Three levels: a query's partial results meet in groups of tasks, those in
    ``MERGE_SPREAD`` groups, and those in one, so no step sees more than a few
    thousand of its rows however many tasks scanned points.
    """
    best_first = F.col("score").asc() if metric == "euclid" else F.col("score").desc()
    some = partial
    for group in (F.pmod(F.col("part"), F.lit(MERGE_SPREAD**2)), F.pmod(F.col("part"), F.lit(MERGE_SPREAD))):
        near = Window.partitionBy("query_id", group).orderBy(best_first, F.col("id"))
        some = some.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).drop("rank")
    some = some.drop("part")
    final = Window.partitionBy("query_id").orderBy(best_first, F.col("id"))
    ranked = some.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")


def attach_payload(
    hits: DataFrame, points: DataFrame, columns: list[str], *, id: str = "id", most_hits: int | None = None
) -> DataFrame:
    """Add point columns to hits.

    ``most_hits`` is a proven bound on the number of hits; where it is small the
    hits go to the points and the points are not shuffled.
    """
    side = points.select(F.col(id).alias("id"), *columns)
    small = F.broadcast(hits) if most_hits is not None and most_hits <= 1_000_000 else hits
    return side.join(small, "id").select(*hits.columns, *columns)
