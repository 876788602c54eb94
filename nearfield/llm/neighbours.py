"""Approximate nearest neighbours over balanced posting lists.

Centroids come from a bounded sample by balanced bisection: a cluster is cut where two means leave equal halves, until
there are enough.  A graph over the centroids, searched in memory best first, finds those near a vector.  A vector goes
to the list of its nearest centroid and, near a boundary, to further ones not much farther away (each closer to the
vector than to a centroid chosen before).  A query reads all lists whose centroid is at most so many times as far as its
nearest; that ratio is fitted on the sample to the wanted recall.  Lists with many vectors or queries are split by
hashes of ids and vectors, so a group meets in memory only up to about GROUP_ROWS of either, whatever the data.

Nearness is the Euclidean distance in double precision, ties to the smaller id.  Vectors that are null, zero, or have
null or non-finite components, null ids, and vectors of another than the most frequent dimension take no part.  Rows
with one id are one candidate, of its least distance; a query's own id is none.  Equal rows count once, but for the
most frequent dimension.  With few vectors all are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.session import stored

#: Vectors that centroids are fitted on, at most, in rows and bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 65_536, 64 << 20
LIST_ROWS, MAX_LISTS = 1024, 16_384
LEAST_LISTS = 8
COPIES, BOUNDARY = 4, 1.03  # lists of one vector at most, and how much farther their centroids may be
RECALL = 0.96  # aimed at on the sample
TRIALS = 256  # sample rows that the ratio is fitted on
GRAPH_LINKS = 16
GROUP_ROWS = 4096


def balanced_centroids(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Means of clusters of equal size, from cutting in two again and again."""
    random, parts = np.random.default_rng(seed), [sample]
    while len(parts) < lists and max(map(len, parts)) > 1:
        parts.sort(key=len)
        part = parts.pop()
        a, b = part[random.choice(len(part), 2, replace=False)].astype(np.float64)
        for _ in range(6):
            side = part @ (b - a)
            order = np.argsort(side, kind="stable")
            low, high = part[order[: len(part) // 2]], part[order[len(part) // 2 :]]
            a, b = low.mean(axis=0), high.mean(axis=0)
        parts += [low, high]
    return np.array([p.mean(axis=0) for p in parts])


class Graph:
    """Links between near centroids, and a few far ones; searched best first for many vectors at once."""

    def __init__(self, centroids: np.ndarray, links: int = GRAPH_LINKS, seed: int = 7):
        self.centroids = centroids.astype(np.float32)
        n = len(centroids)
        self.norms = (self.centroids**2).sum(axis=1)
        near = np.empty((n, min(links, n - 1) if n > 1 else 0), np.int64)
        for at in range(0, n, 1024):
            d = self.norms[None, :] - 2 * self.centroids[at : at + 1024] @ self.centroids.T
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            if near.shape[1]:
                near[at : at + len(d)] = np.argpartition(d, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
        # A ring and random links keep all centroids within reach.
        far = np.random.default_rng(seed).integers(0, n, (n, 3))
        self.links = np.concatenate([near, ((np.arange(n) + 1) % n)[:, None], far], axis=1)
        self.least = 1e-12  # a vector that is its centroid counts as so far from it
        self.entries = np.unique(np.linspace(0, n - 1, 8).astype(np.int64))

    def _squares(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self.norms[ids] - 2 * np.einsum("bd,bmd->bm", x, self.centroids[ids])

    def nearest(self, vectors: np.ndarray, n: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of about the ``n`` nearest centroids, nearest first, for each vector."""
        n = min(n, len(self.centroids))
        width = min(len(self.centroids), max(2 * n, 16))
        x = vectors.astype(np.float32)
        rows = np.arange(len(x))[:, None]
        seen = np.zeros((len(x), len(self.centroids) + 1), bool)
        ids = np.full((len(x), width), len(self.centroids))
        squares, open_ = np.full(ids.shape, np.inf, np.float32), np.zeros(ids.shape, bool)
        fresh = np.broadcast_to(self.entries, (len(x), len(self.entries)))
        while True:
            d = self._squares(x, fresh)
            d[seen[rows, fresh]] = np.inf
            # A centroid met twice in one step counts once.
            order = np.argsort(fresh, axis=1, kind="stable")
            twice = np.zeros(fresh.shape, bool)
            ordered = np.take_along_axis(fresh, order, 1)
            np.put_along_axis(twice, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
            d[twice] = np.inf
            seen[rows, fresh] = True
            ids, squares = np.concatenate([ids, fresh], 1), np.concatenate([squares, d], 1)
            open_ = np.concatenate([open_, np.isfinite(d)], 1)
            best = np.argsort(squares, axis=1, kind="stable")[:, :width]
            ids, squares, open_ = (np.take_along_axis(a, best, 1) for a in (ids, squares, open_))
            if not open_.any():
                break
            place = np.argsort(~open_, axis=1, kind="stable")[:, :expand]
            chosen = np.take_along_axis(ids, place, 1)
            live = np.take_along_axis(open_, place, 1)
            np.put_along_axis(open_, place, False, 1)
            # Rows that are done meet their first entry again, which changes nothing.
            chosen = np.where(live, chosen, self.entries[0])
            fresh = self.links[chosen].reshape(len(x), -1)
        distance = np.sqrt(np.maximum(squares[:, :n] + (x**2).sum(axis=1)[:, None], 0))
        return ids[:, :n], distance

    def within(self, vectors: np.ndarray, ratio: float) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of all centroids at most ``ratio`` times as far as the nearest, as far as the search goes."""
        left, n = np.arange(len(vectors)), 32
        while len(left):
            ids, distance = self.nearest(vectors[left], n)
            reach = distance <= np.maximum(distance[:, :1], self.least) * ratio
            done = ~reach[:, -1] | (n >= len(self.centroids))
            for row in np.flatnonzero(done):
                yield int(left[row]), ids[row][reach[row]]
            left, n = left[~done], 4 * n

    def boundary(self, vectors: np.ndarray, copies: int, ratio: float) -> Iterator[tuple[int, list[int]]]:
        """(row, ids) of the lists that a vector is put in."""
        ids, distance = self.nearest(vectors, 2 * copies)
        for row, (near, far) in enumerate(zip(ids, distance)):
            kept: list[int] = []
            for i, d in zip(near.tolist(), far.tolist()):
                if len(kept) == copies or (kept and d > far[0] * ratio):
                    break
                if all(((self.centroids[i] - self.centroids[k]) ** 2).sum() > d * d for k in kept):
                    kept.append(i)
            yield row, kept


def fitted_ratio(graph: Graph, sample: np.ndarray, recall: float, k: int) -> float:
    """The least distance ratio at which sample rows' nearest sample rows are in the lists that are read.

    Distances to the nearest centroid count as the usual one at least, which the graph keeps.
    """
    trials = sample[:: max(1, len(sample) // TRIALS)][:TRIALS].astype(np.float64)
    if len(sample) <= k + 1:
        return np.inf
    data = sample.astype(np.float64)
    d = (data**2).sum(axis=1)[None, :] - 2 * trials @ data.T
    near = np.argpartition(d, k + 1, axis=1)[:, : k + 1]  # themselves too
    lists = {int(i): [] for i in np.unique(near)}
    wanted = np.array(sorted(lists))
    for row, ids in graph.boundary(data[wanted], COPIES, BOUNDARY):
        lists[int(wanted[row])] = ids
    to = np.sqrt(np.maximum((graph.norms[None, :] - 2 * trials @ graph.centroids.T) + (trials**2).sum(axis=1)[:, None], 0))
    graph.least = max(graph.least, float(np.median(to.min(axis=1))))
    needed = [min(to[t, i] for i in lists[int(j)]) / max(to[t].min(), graph.least) for t in range(len(trials)) for j in near[t]]
    return float(np.quantile(needed, recall)) * 1.001


def _first(q: np.ndarray, c: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest candidates of each query, ties to smaller ids, an id once."""
    order = np.lexsort((c, d, q))
    q, c, d = q[order], c[order], d[order]
    again = np.lexsort((d, c, q))  # repeated rows of one id: the least distance
    new = np.r_[True, (q[again][1:] != q[again][:-1]) | (c[again][1:] != c[again][:-1])] if len(q) else np.empty(0, bool)
    keep = np.sort(again[new])
    q, c, d = q[keep], c[keep], d[keep]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], c[keep], d[keep]


def _best(q_ids, queries, c_ids, candidates, k):
    """(query, candidate, distance) of each query's ``k`` nearest, its own id left out."""
    # Rows of one id stand together, so that a block's limit can be taken over ids.
    order = np.argsort(c_ids, kind="stable")
    c_ids, candidates = c_ids[order], candidates[order]
    norms, best = (queries**2).sum(axis=1), (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    for at in range(0, len(candidates), 512):
        ids, block = c_ids[at : at + 512], candidates[at : at + 512]
        d = norms[:, None] + (block**2).sum(axis=1)[None, :] - 2 * queries @ block.T
        d[q_ids[:, None] == ids[None, :]] = np.inf
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        least = np.minimum.reduceat(d, first, axis=1) if len(first) < len(ids) else d
        limit = np.partition(least, k - 1, axis=1)[:, k - 1] if len(first) > k else np.full(len(d), np.finfo(np.float64).max)
        # The product is rounded, so all that might be among the nearest are measured exactly.
        near = d <= (limit + 1e-9 * (1 + norms + np.minimum(np.abs(limit), 1e300)))[:, None]
        q, c = np.nonzero(near & np.isfinite(d))
        exact = np.empty(len(q))
        for part in range(0, len(q), 1 << 16):
            a, b = q[part : part + (1 << 16)], c[part : part + (1 << 16)]
            exact[part : part + (1 << 16)] = np.sqrt(((queries[a] - block[b]) ** 2).sum(axis=1))
        best = _first(*(np.concatenate(x) for x in zip(best, (q, ids[c], exact))), k)
    return q_ids[best[0]], best[1], best[2]


def search(vectors: DataFrame, is_query, k: int = 10, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``vectors`` (vec_id, embedding) of which those in ``is_query`` ask."""
    spark = vectors.sparkSession
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    element = "float" if kind == "<f4" else "double"
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(f"array<{element}>").alias("embedding"))
    rows = rows.where("vec_id is not null and size(embedding) > 0")
    rows = rows.where(F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))
    rows = rows.groupBy("vec_id", "embedding").agg(F.count(F.lit(1)).alias("copies"))
    rows = stored(rows.withColumn("asks", is_query(F.col("vec_id"))), "vectors")
    sizes = rows.groupBy(F.size("embedding").alias("size")).agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("distinct"))
    common = sizes.orderBy(F.desc("n"), "size").first()
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if common is None:
        return spark.createDataFrame([], empty)
    rows, width, total = rows.where(F.size("embedding") == common["size"]), common["size"], common.distinct

    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * width)))
    picked = rows.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(most).select("embedding").toArrow()
    sample = np.asarray(picked.column("embedding").combine_chunks().flatten(), dtype=kind).reshape(-1, width)
    graph = Graph(balanced_centroids(sample, max(LEAST_LISTS, min(MAX_LISTS, total // LIST_ROWS))))
    ratio = fitted_ratio(graph, sample, recall, k)

    names = ["list", "asks", "id", "vector"]
    kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.binary())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = np.asarray(batch.column("embedding").flatten(), dtype=kind).reshape(-1, width)
            ids, asks = batch.column("vec_id").to_pylist(), np.asarray(batch.column("asks").to_pylist(), bool)
            for at in range(0, len(data), 512):
                part = data[at : at + 512]
                out = [(i, False, ids[at + row], part[row].tobytes()) for row, lists in graph.boundary(part, COPIES, BOUNDARY) for i in lists]
                mine = np.flatnonzero(asks[at : at + 512])
                for row, lists in graph.within(part[mine], ratio):
                    out += [(i, True, ids[at + mine[row]], part[mine[row]].tobytes()) for i in lists.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    lists = rows.mapInArrow(place, "list int, asks boolean, id bigint, vector binary")
    lists = stored(lists, "posting-lists")
    counts = lists.groupBy("list").agg(F.count(F.when(F.col("asks"), 1)).alias("q"), F.count(F.when(~F.col("asks"), 1)).alias("c"))
    # At most MAX_LISTS rows.
    splits = counts.select("list", *[F.greatest(F.lit(1), F.ceil(F.col(n) / GROUP_ROWS)).cast("int").alias(f"{n}_parts") for n in "qc"])
    mine = lambda parts: F.pmod(F.xxhash64("id", "vector"), F.col(parts)).cast("int")
    all_ = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    dealt = lists.join(F.broadcast(splits), "list")
    dealt = dealt.withColumn("q_part", F.when(F.col("asks"), mine("q_parts"))).withColumn("c_part", F.when(~F.col("asks"), mine("c_parts")))
    asked = dealt.where("asks").select("list", "q_part", all_("c_parts").alias("c_part"), "asks", "id", "vector")
    told = dealt.where("not asks").select("list", all_("q_parts").alias("q_part"), "c_part", "asks", "id", "vector")
    groups = asked.unionByName(told).repartition("list", "q_part", "c_part")
    groups = groups.sortWithinPartitions("list", "q_part", "c_part", F.desc("asks"))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, q, c = None, [], []

        def matrix(found: list) -> tuple[np.ndarray, np.ndarray]:
            ids = np.array([i for i, _ in found], np.int64)
            return ids, np.frombuffer(b"".join(v for _, v in found), kind).reshape(-1, width).astype(np.float64)

        def done():
            if q and c:
                a, b, d = _best(*matrix(q), *matrix(c), k)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for *key, asks, i, vector in zip(*(batch.column(n).to_pylist() for n in range(6))):
                if key != group:
                    yield from done()
                    group, q, c = key, [], []
                (q if asks else c).append((i, vector))
        yield from done()

    pairs = groups.mapInArrow(nearest, "query_id bigint, vec_id bigint, score double")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
