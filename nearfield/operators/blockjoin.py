"""Top-k of a large table of queries against a table of points, block by block.

Both tables carry a ``cell`` and only rows of one cell meet (one cell for an exact search).  Within a cell the queries
are cut into blocks and the points into blocks, by a hash; every block of queries meets every block of points by an
equi-join on the two block numbers, and one task keeps the best points of one such pair.  No query passes through the
driver, no pair of a query and a point leaves a task unless it is among the best there, and no cell, however large, is one
task's work.  Rows travel in packs, so a block that is needed in several places is a few wide rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.vectors import matrix
from nearfield.operators.topk import BestK, partial_rows

PACK_ROWS = 1024
BLOCK_POINTS = 250_000  # about as many points meet a block of queries in one task
BLOCK_QUERIES = 1 << 16  # most queries of a block; every point travels once for each block of queries
BLOCK_BYTES = 32 << 20  # ... and most bytes of their vectors
BLOCK_HITS = 1_000_000  # ... and most hits that a task keeps for them
MOST_PARTITIONS = 20_000


def _pack(rows: DataFrame, width: int, ids: str) -> DataFrame:
    """Rows (cell, block, id, vector) as packs (cell, block, first id, ids, vectors)."""
    id_type = rows.schema["id"].dataType.simpleString()
    single = rows.schema["vector"].dataType.elementType.simpleString() == "float"
    most = PACK_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, blocks = (batch.column(n).to_numpy() for n in ("cell", "block"))
            order = np.lexsort((blocks, cells))
            cells, blocks = cells[order], blocks[order]
            edges = np.flatnonzero(np.r_[True, (np.diff(cells) != 0) | (np.diff(blocks) != 0), True])
            cuts = [(at, min(at + most, b)) for a, b in zip(edges, edges[1:]) for at in range(a, b, most)]
            vectors = matrix(batch.column("vector"), width)[order].astype(np.float32 if single else np.float64)
            known = batch.column("id").take(pa.array(order))
            starts = pa.array([a for a, _ in cuts], pa.int32())
            lists = pa.ListArray.from_arrays(pa.array([*starts.to_pylist(), len(order)], pa.int32()), known)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cells[starts]), pa.array(blocks[starts]), known.take(starts), lists,
                    pa.array([vectors[a:b].tobytes() for a, b in cuts], pa.binary()),
                ],
                names=["cell", "block", "first", ids, "vectors"],
            )

    return rows.select("cell", "block", "id", "vector").mapInArrow(
        run, f"cell int, block int, first {id_type}, {ids} array<{id_type}>, vectors binary"
    )


def block_rows(width: int, k: int) -> int:
    """How many queries of ``width`` values a block holds.

    What fits a task's memory, however few queries would be sent to every task: smaller blocks only copy the points
    more often.
    """
    return max(1, min(BLOCK_QUERIES, BLOCK_HITS // k, BLOCK_BYTES // (8 * max(1, width))))


def block_counts(sizes: list[tuple[int, int, int]], query_rows: int, tasks: int) -> list[tuple[int, int, int]]:
    """(cell, blocks of queries, blocks of points) for cells of (cell, queries, points).

    Both get blocks until all cells together keep ``tasks`` tasks busy, as far as a cell's share of the work goes: queries
    about the root of twice its tasks, as each block of points copies them and adds hits, and points what is left.
    """
    work = sum(q * p for _, q, p in sizes) or 1
    out = []
    for cell, queries, points in sizes:
        share = -(-tasks * queries * points // work)
        q_parts = max(1, -(-queries // query_rows), min(math.isqrt(2 * share), queries // PACK_ROWS))
        fair = -(-share // q_parts)
        out.append((cell, q_parts, max(1, -(-points // BLOCK_POINTS), min(fair, -(-points // PACK_ROWS)))))
    return out


def meet(
    points: DataFrame,
    queries: DataFrame,
    parts: list[tuple[int, int, int]],
    k: int,
    metric: str,
    threshold: float | None,
    width: int,
    schema: str,
) -> DataFrame:
    """Partial results (query_id, id, score, part) of points (cell, id, vector) and queries (cell, query_id, vector).

    ``parts`` has a row (cell, blocks of queries, blocks of points) for every cell that takes part.
    """
    spark = points.sparkSession

    def counted(rows: DataFrame) -> DataFrame:
        if len(parts) == 1:
            return rows.withColumns({"q_parts": F.lit(parts[0][1]), "p_parts": F.lit(parts[0][2])})
        return rows.join(F.broadcast(spark.createDataFrame(parts, "cell int, q_parts int, p_parts int")), "cell")  # a row per cell

    hashed = lambda name, of: F.pmod(F.xxhash64(name), F.col(of)).cast("int")
    asked = counted(queries).select("cell", hashed("query_id", "q_parts").alias("block"), F.col("query_id").alias("id"), "vector")
    all_ = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    q_packs = counted(_pack(asked.repartition("cell", "block"), width, "query_ids"))
    q_packs = q_packs.select("cell", F.col("block").alias("q"), all_("p_parts").alias("p"), F.lit(0).alias("kind"), "query_ids", "vectors")
    p_packs = counted(_pack(points.select("cell", F.lit(0).alias("block"), "id", "vector"), width, "ids"))
    p_packs = p_packs.select("cell", all_("q_parts").alias("q"), hashed("first", "p_parts").alias("p"), F.lit(1).alias("kind"), "ids", "vectors")
    both = q_packs.unionByName(p_packs, allowMissingColumns=True)
    number = min(MOST_PARTITIONS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(q * p for _, q, p in parts)))
    both = both.repartition(number, "cell", "q", "p").sortWithinPartitions("cell", "q", "p", "kind")
    kinds = {name: df.schema["vector"].dataType.elementType.simpleString() == "float" for name, df in (("q", queries), ("p", points))}
    types = [np.float32 if kinds[name] else np.float64 for name in ("q", "p")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        query_ids: list[pa.Array] = []
        vectors: list[np.ndarray] = []
        best: BestK | None = None
        id_type = None

        def done() -> Iterator[pa.RecordBatch]:
            if best is not None:
                part = hash(group[::2]) & 0x7FFFFFFF  # the cell and the block of points
                yield partial_rows(best, pa.concat_arrays(query_ids), id_type, part)

        for batch in batches:
            columns = [batch.column(n).to_numpy() for n in ("cell", "q", "p", "kind")]
            id_type = batch.schema.field("ids").type.value_type
            for at in range(batch.num_rows):
                *key, kind = (int(c[at]) for c in columns)
                if tuple(key) != group:
                    yield from done()
                    group, query_ids, vectors, best = tuple(key), [], [], None
                data = np.frombuffer(batch.column("vectors")[at].as_buffer(), types[kind]).astype(np.float64).reshape(-1, width)
                if kind == 0:
                    query_ids.append(batch.column("query_ids")[at].values)
                    vectors.append(data)
                elif vectors:
                    if best is None:
                        best = BestK(np.concatenate(vectors), k, metric, threshold)
                    best.offer(batch.column("ids")[at].values.to_numpy(zero_copy_only=False), data)
        yield from done()

    return both.mapInArrow(run, schema)
