"""Re-rank the hits of each query for diversity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.vectors import row_cosine

DEFAULT_LAMBDA = 0.5  # fixed values: request defaults
DEFAULT_FETCH_K = 50
DEFAULT_DIVERSITY_WEIGHT = 0.3


def rerank_mmr(
    hits: DataFrame, *, top_k: int, lambda_: float = DEFAULT_LAMBDA, fetch_k: int = DEFAULT_FETCH_K
) -> DataFrame:
    """Maximal marginal relevance.

    Takes ``query_id, rank, id, score, vector, query_vector`` and returns
    ``query_id, id, original_score, mmr_score, mmr_rank``; ranks start at 1.  Of the first
    ``fetch_k`` hits it picks, one at a time, the one with the best
    ``lambda * cos(query, hit) - (1 - lambda) * max cos(hit, picked)``; ties go to
    the earlier hit.  Hits without a vector are left out; if none has one, the
    first ``top_k`` hits come back as they are.
    """
    if not 0 <= lambda_ <= 1:
        raise ValueError("lambda must be between 0 and 1")

    def pick(scores: np.ndarray, vectors: np.ndarray, query: np.ndarray) -> tuple[list[int], list[float]]:
        relevance = row_cosine(vectors, query)
        closest = np.full(len(vectors), -1.0)  # fixed value: similarity never falls below this
        return _greedy(
            len(vectors),
            top_k,
            lambda picked: lambda_ * relevance - (1 - lambda_) * (closest if picked else 0.0),
            lambda at, _: np.maximum(closest, row_cosine(vectors, vectors[at]), out=closest),
        )

    return _per_query(hits.where(F.col("rank") <= fetch_k), hits, top_k, pick)


def rerank_diversity(
    hits: DataFrame, *, top_k: int, weight: float = DEFAULT_DIVERSITY_WEIGHT
) -> DataFrame:
    """Score against mean similarity to what is already picked.

    Same columns as :func:`rerank_mmr` (``query_vector`` is not needed).  Starts
    with the first hit at its own score, then takes the best
    ``(1 - weight) * score - weight * mean cos(hit, picked)``.
    """
    if not 0 <= weight <= 1:
        raise ValueError("weight must be between 0 and 1")

    def pick(scores: np.ndarray, vectors: np.ndarray, query: np.ndarray | None) -> tuple[list[int], list[float]]:
        total = np.zeros(len(vectors))

        def standing(picked: int) -> np.ndarray:
            if not picked:
                return np.where(np.arange(len(scores)) == 0, scores, -np.inf)
            return scores * (1 - weight) - total / picked * weight

        return _greedy(
            len(vectors), top_k, standing, lambda at, _: np.add(total, row_cosine(vectors, vectors[at]), out=total)
        )

    return _per_query(hits, hits, top_k, pick)


def _greedy(n: int, top_k: int, standing, picked_now) -> tuple[list[int], list[float]]:
    """Up to ``top_k`` positions, each the first with the highest standing left."""
    order: list[int] = []
    values: list[float] = []
    left = np.ones(n, dtype=bool)
    for step in range(min(top_k, n)):
        now = np.where(left, standing(step), -np.inf)
        at = int(np.argmax(now))
        left[at] = False
        order.append(at)
        values.append(float(now[at]))
        picked_now(at, step)
    return order, values


def _per_query(considered: DataFrame, hits: DataFrame, top_k: int, pick) -> DataFrame:
    """Run ``pick`` on the hits of each query, which stand together in rank order within a partition."""
    fields = {f.name: f.dataType.simpleString() for f in hits.schema.fields}
    schema = (
        f"query_id {fields['query_id']}, id {fields['id']}, "
        "original_score double, mmr_score double, mmr_rank int"
    )
    needed = [F.col(name) for name in ("query_id", "rank", "id", "score", "vector")]
    if "query_vector" in fields:  # one copy per query is enough
        needed.append(F.when(F.col("rank") == 1, F.col("query_vector")).alias("query_vector"))
    together = considered.select(*needed).repartition("query_id").sortWithinPartitions("query_id", "rank")

    def rerank(table: pa.Table, starts: list[int]) -> pa.RecordBatch:
        """The picks of all queries of ``table``; ``starts`` are their first rows and the end."""
        scores = np.nan_to_num(table.column("score").to_numpy())
        sizes = pc.fill_null(pc.list_value_length(table.column("vector")), 0).to_numpy()
        values = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        values = np.nan_to_num(values.astype(np.float64), posinf=0.0, neginf=0.0)
        ends = np.cumsum(sizes)
        taken, standing, places = [], [], []
        for first, last in zip(starts, starts[1:]):
            rows = first + np.nonzero(sizes[first:last])[0]
            if len(rows):
                dim = sizes[rows[0]]
                if (sizes[rows] != dim).any():
                    raise ValueError("vectors must have the same length")
                vectors = values[ends[rows[0]] - dim : ends[rows[-1]]].reshape(len(rows), dim)
                query = None
                if "query_vector" in table.column_names:
                    query = np.array(table.column("query_vector")[first].as_py(), dtype=np.float64)
                    query = np.nan_to_num(query, posinf=0.0, neginf=0.0)
                    if query.shape != (dim,):
                        raise ValueError("vectors must have the same length")
                order, values_at = pick(scores[rows], vectors, query)
                at = rows[order]
            else:
                at = np.arange(first, min(last, first + top_k))
                values_at = scores[at]
            taken.append(at)
            standing.append(values_at)
            places.append(np.arange(1, len(at) + 1))
        at = np.concatenate(taken)
        return pa.RecordBatch.from_arrays(
            [
                table.column("query_id").combine_chunks().take(pa.array(at)),
                table.column("id").combine_chunks().take(pa.array(at)),
                pa.array(scores[at]),
                pa.array(np.concatenate(standing)),
                pa.array(np.concatenate(places), pa.int32()),
            ],
            ["query_id", "id", "original_score", "mmr_score", "mmr_rank"],
        )

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last query so far; more of its hits may follow
        for block in blocks:
            table = pa.Table.from_batches([block])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            if not table.num_rows:
                continue
            ids = table.column("query_id")
            changes = np.nonzero(pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy())[0] + 1
            starts = [0, *changes.tolist()]
            held = table.slice(starts[-1])
            if len(starts) > 1:
                yield rerank(table.slice(0, starts[-1]), starts)
        if held is not None and held.num_rows:
            yield rerank(held, [0, held.num_rows])

    return together.mapInArrow(run, schema)
