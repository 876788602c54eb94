"""A cell index of points, and search that reads only the cells nearest to a query.

``probes`` trades recall for speed; all cells together are the exact search.  ``fit_recall`` measures what each number of
probes finds.  Cells know the extent of the payload columns they keep, so a filter leaves out cells before any is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from nearfield.functions.filters import Filter, cells_may_hold, compile_filter
from nearfield.functions.vectors import arrow_vectors, matrix
from nearfield.operators.blockjoin import block_counts, block_rows, meet
from nearfield.operators.search import (
    BROADCAST_ROWS,
    attach_payload,
    batch_rows,
    check_request,
    fetch_batch,
    measure,
    merge_best,
    partial_schema,
    scan_points,
    search,
)
from nearfield.session import stored

MAX_CENTRE_BYTES = 64 << 20
FILE_POINTS = 1_000_000  # about as many points per index file
ROUTE_VALUES = 16 << 20  # most entries of a table of queries and cells
RECALL_QUERIES = 1000  # most points that are searched for to measure recall
PLAIN = (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType)


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (rows * rows).sum(axis=1)[:, None] - 2 * rows @ centres.T + (centres * centres).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(squares, 0.0))


def build_index(
    points: DataFrame,
    path: str,
    cells: int,
    *,
    metric: str = "cosine",
    id: str = "id",
    vector: str = "vector",
    keep: list[str] | None = None,
    seed: int = 7,
    centres: np.ndarray | None = None,
) -> None:
    """Write points partitioned by nearest centre, with the centres and the extent of each cell.

    Centres are fitted on all points, unless given; every point is indexed.  A cell that holds much of the data is spread
    over many files.  Of the columns to ``keep`` each cell knows the least and greatest value and which values it may hold.
    """
    if metric not in ("cosine", "euclid"):
        raise ValueError("a cell index needs the cosine or euclid metric")
    spark = points.sparkSession
    source = points.where(F.col(vector).isNotNull()).select(
        F.col(id).alias("id"), F.col(vector).alias("vector"), *(keep or [])
    )
    train = source.select("vector")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    if metric == "cosine":  # zero vectors have no direction and get a cell of their own
        train = train.where(length > 0).withColumn("vector", F.transform("vector", lambda x: x / length))
    if centres is None:
        features = stored(train.select(F.col("vector").cast("array<double>").alias("vector")), "train")  # read every round
        fitted = KMeans(k=cells, seed=seed, maxIter=10, initMode="random").fit(
            features.select(array_to_vector("vector").alias("features"))
        )
        centres = np.array(fitted.clusterCenters())
    if centres.nbytes > MAX_CENTRE_BYTES:
        raise ValueError("too many cells for this vector size")
    placed = stored(_assign(source, centres, metric), "placed")
    kept = [f for f in placed.schema if f.name in (keep or []) and isinstance(f.dataType, PLAIN)]
    extents = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("points"), F.max("distance").alias("radius"), *[e for f in kept for e in _extent(f)]
    )
    extents = stored(extents, "extents")  # a row per cell
    _small_table(spark, centres, metric, extents).write.mode("overwrite").parquet(f"{path}/cells")
    files = extents.select("cell", F.ceil(F.col("points") / FILE_POINTS).alias("files"))
    spread = placed.join(F.broadcast(files), "cell")
    spread = spread.repartition("cell", F.pmod(F.xxhash64("id"), F.col("files"))).drop("distance", "files")
    spread.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/points")


def _extent(column: T.StructField) -> list[Column]:
    """Least and greatest value of a column, and a bit for each value's hash."""
    value = F.col(f"`{column.name}`")
    place = F.pmod(F.xxhash64(value), F.lit(63)).cast("int")
    seen = F.bit_or(F.when(value.isNotNull(), F.call_function("shiftleft", F.lit(1).cast("bigint"), place)))
    return [F.min(value).alias(f"low_{column.name}"), F.max(value).alias(f"high_{column.name}"), seen.alias(f"seen_{column.name}")]


def _small_table(spark: SparkSession, centres: np.ndarray, metric: str, extents: DataFrame) -> DataFrame:
    rows = [(cell, metric, centre) for cell, centre in enumerate(centres.tolist())]
    known = spark.createDataFrame([*rows, (-1, metric, [])], "cell int, metric string, centre array<double>")
    known = known.join(extents, "cell", "left").where("cell >= 0 or points > 0")
    return known.withColumns({"points": F.coalesce("points", F.lit(0)), "radius": F.coalesce("radius", F.lit(0.0))}).coalesce(1)


def _assign(source: DataFrame, centres: np.ndarray, metric: str) -> DataFrame:
    shared = source.sparkSession.sparkContext.broadcast(centres)

    @arrow_udf("struct<cell:int,distance:double>")
    def nearest(blocks: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for block in blocks:
            rows = matrix(block, shared.value.shape[1])
            zero = ~(rows != 0).any(axis=1) if metric == "cosine" else np.zeros(len(rows), dtype=bool)
            gaps = _distances(_unit(rows) if metric == "cosine" else rows, shared.value)
            cell = gaps.argmin(axis=1)
            distance = gaps[np.arange(len(rows)), cell]
            cell[zero] = -1
            yield pa.StructArray.from_arrays(
                [pa.array(cell, pa.int32()), pa.array(distance)], ["cell", "distance"]
            )

    return source.withColumn("_at", nearest("vector")).select(*source.columns, "_at.cell", "_at.distance")


class Cells:
    """The cells of an index, small enough for every task, and the way from a query to those it reads."""

    def __init__(self, spark: SparkSession, path: str, where: Filter | None = None):
        table = spark.read.parquet(f"{path}/cells")
        self.points = spark.read.parquet(f"{path}/points")
        shape = T.StructType([f for f in self.points.schema if f.name != "cell"])
        may = cells_may_hold(where, shape) if where else F.lit(True)
        rows = table.select("cell", "metric", "centre", F.when(may, F.col("points")).otherwise(0).alias("points")).orderBy("cell").collect()
        self.metric = rows[0]["metric"]
        counts = {r["cell"]: r["points"] for r in rows}
        self.total = table.agg(F.sum("points")).first()[0]
        self.centres = np.array([r["centre"] for r in rows if r["cell"] >= 0])
        if where:
            # How many points of each remaining cell pass; only payload columns are read.
            self.points = self.points.where(F.col("cell").isin([c for c, n in counts.items() if n])).where(compile_filter(where, shape))
            passed = {r["cell"]: r["n"] for r in self.points.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
            counts = {c: passed.get(c, 0) for c in counts}
        self.extra = counts.get(-1, 0)  # points without a direction are always looked at
        self.counts = np.array([counts[c] for c in range(len(self.centres))])

    def order(self, vectors: np.ndarray) -> np.ndarray:
        """The cells of each query, the nearest first and those with nothing to find last."""
        gaps = _distances(_unit(vectors) if self.metric == "cosine" else vectors, self.centres)
        return np.argsort(np.where(self.counts > 0, gaps, np.inf), axis=1, kind="stable")

    def routes(self, vectors: np.ndarray, probes: int | None, enough: int) -> np.ndarray:
        """Queries x cells: the ``probes`` nearest ones, and further ones until they hold ``enough`` points; the last is the extra one."""
        order = self.order(vectors)
        held = np.cumsum(self.counts[order], axis=1)
        place = np.arange(order.shape[1])[None, :]
        wanted = (place < (order.shape[1] if probes is None else probes)) | (held - self.counts[order] < enough)
        out = np.zeros((len(vectors), len(self.centres) + 1), dtype=bool)
        np.put_along_axis(out, order, wanted & (self.counts[order] > 0), axis=1)
        out[:, -1] = self.extra > 0
        return out


def search_index(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    k: int = 10,
    *,
    probes: int | None = 4,
    wanted_recall: float | None = None,
    where: Filter | None = None,
    threshold: float | None = None,
    query_id: str = "query_id",
    query_vector: str = "vector",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The ``k`` best points of every query in its ``probes`` nearest cells: ``query_id, rank, id, score``.

    None probes all cells, which is the exact search; ``wanted_recall`` takes as many probes as ``fit_recall`` found to
    be enough for it.  With ``where`` (on columns the index keeps) cells that can hold no such point are left out, and a
    query goes on to further cells until those it reads hold ``k`` points that pass, or all are read.  What a query finds
    depends on no other query.  At most ``broadcast_rows`` queries go to every task; more are sent to their cells and
    meet the points there, block by block.
    """
    cells = Cells(spark, path, where)
    metric = cells.metric
    check_request(k, metric)
    if wanted_recall is not None:
        probes = fitted_probes(spark, path, wanted_recall)
    enough = k if where else 0
    points = cells.points.select("id", "vector", "cell")
    asked = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("vector"))
    schema = partial_schema(points, asked)
    rows = min(batch_rows(cells.centres.shape[1], k, broadcast_rows), max(1, ROUTE_VALUES // len(cells.centres)))
    n, width = measure(asked, "vector")
    if n <= rows:
        batch = fetch_batch(asked)
        routes = cells.routes(batch.vectors, probes, enough) if len(batch) else np.zeros((0, len(cells.centres) + 1), dtype=bool)
        wanted = [int(c) for c in np.flatnonzero(routes[:, :-1].any(axis=0))] + ([-1] if cells.extra else [])
        partial = scan_points(points.where(F.col("cell").isin(wanted)), batch, k, metric, threshold, schema, routes)
        return merge_best(partial, k, metric)
    if probes is None:  # every query reads every cell, so they are one: queries travel, and keep their hits, once
        together, number = F.lit(0).alias("cell"), int(cells.counts.sum()) + cells.extra
        parts = block_counts([(0, n, number)], block_rows(width, k), 2 * spark.sparkContext.defaultParallelism)
        points, asked = points.select("id", "vector", together), asked.select(together, "query_id", "vector")
        return merge_best(meet(points, asked, parts, k, metric, threshold, width, schema), k, metric)
    routed = _routed(asked, cells, probes, enough, width)
    demand = {r["cell"]: r["n"] for r in routed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per cell
    sizes = [(c, q, int(cells.counts[c]) if c >= 0 else cells.extra) for c, q in sorted(demand.items())]
    parts = block_counts(sizes, block_rows(width, k), 2 * spark.sparkContext.defaultParallelism)
    points = points.where(F.col("cell").isin([c for c, _, _ in sizes]))
    return merge_best(meet(points, routed, parts, k, metric, threshold, width, schema), k, metric)


def _routed(queries: DataFrame, cells: Cells, probes: int | None, enough: int, width: int) -> DataFrame:
    """A row (cell, query_id, vector) for each cell that a query reads."""
    sent = queries.sparkSession.sparkContext.broadcast((cells.centres, cells.counts, cells.extra, cells.metric))
    step = max(1, ROUTE_VALUES // (8 * len(cells.centres)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Cells.__new__(Cells)
        own.centres, own.counts, own.extra, own.metric = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                vectors = matrix(part.column("vector"), width)
                query, cell = np.nonzero(own.routes(vectors, probes, enough))
                cell[cell == len(own.centres)] = -1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell, pa.int32()), part.column("query_id").take(pa.array(query)), arrow_vectors(vectors[query])],
                    names=["cell", "query_id", "vector"],
                )

    id_type = queries.schema["query_id"].dataType.simpleString()
    return queries.mapInArrow(run, f"cell int, query_id {id_type}, vector array<double>")


def fit_recall(spark: SparkSession, path: str, k: int = 10, *, queries: DataFrame | None = None) -> DataFrame:
    """Measure the index: ``probes, recall, points_read`` for every number of probes, kept beside it.

    ``queries`` (query_id, vector; RECALL_QUERIES at most) are searched exactly; without them that many points are
    drawn by a hash of the id, and a point is no hit of its own.  ``recall`` is the share of their ``k`` best points that
    lie in the cells probed, ``points_read`` the share of all points in these.
    """
    cells = Cells(spark, path)
    drawn = queries is None
    if drawn:
        points = cells.points.select(F.col("id").alias("query_id"), "vector")
        queries = points.orderBy(F.xxhash64("query_id"), "query_id").limit(RECALL_QUERIES)
    queries = stored(queries.select("query_id", "vector").where(F.col("vector").isNotNull()), "recall-queries")
    if (n := queries.count()) > RECALL_QUERIES:
        raise ValueError(f"give at most {RECALL_QUERIES} queries")
    batch = fetch_batch(queries)
    hits = search(cells.points, queries, min(1000, k + drawn), metric=cells.metric)
    hits = attach_payload(hits, cells.points, ["cell"], most_hits=n * (k + drawn))
    if drawn:
        hits = hits.where("query_id <> id")
    # At most k hits of a bounded number of queries.
    best: dict = {}
    for row in hits.select("query_id", "rank", "cell").orderBy("query_id", "rank").collect():
        best.setdefault(row["query_id"], []).append(row["cell"])
    order = cells.order(batch.vectors) if n else np.zeros((0, len(cells.centres)), int)
    place = np.argsort(order, axis=1)
    found, hits_in_all = np.zeros(len(cells.centres) + 1), 0
    for at, query in enumerate(batch.ids.to_pylist()):
        for cell in best.get(query, [])[:k]:
            found[0 if cell < 0 else place[at, cell] + 1] += 1
            hits_in_all += 1
    read = (np.cumsum(cells.counts[order], axis=1).mean(axis=0) if n else np.zeros(len(cells.centres))) + cells.extra
    shares = np.cumsum(found)[1:] / max(1, hits_in_all)
    rows = [(p + 1, float(shares[p]), float(read[p] / max(1, cells.total))) for p in range(len(shares))]
    table = spark.createDataFrame(rows, "probes int, recall double, points_read double")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/recall")
    return spark.read.parquet(f"{path}/recall")


def fitted_probes(spark: SparkSession, path: str, wanted: float) -> int | None:
    """The fewest probes whose measured recall is ``wanted`` or more; None (all cells) if there are none."""
    return spark.read.parquet(f"{path}/recall").where(F.col("recall") >= wanted).agg(F.min("probes")).first()[0]


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of exact hits the approximate search found."""
    hit = approximate.select("query_id", "id").withColumn("hit", F.lit(1))
    return exact.join(hit, ["query_id", "id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
