"""Vector compression: PARTS codebooks of ENTRIES entries, fitted in ROUNDS rounds, and the codes of all vectors.

A component x becomes the integer floor(SCALE * x); a vector is cut into PARTS equal consecutive parts.  A part's codebook
starts with that part of the ENTRIES smallest ids; each round assigns every part to its nearest entry (squared distance, ties
to the lower index) and replaces an entry by the componentwise floor of the mean of its parts (unused entries stay).

Distances: vectors are stored once in slices, per dimension as a dictionary of the distinct integers in the slice and a
code into it per vector.  For each dimension the squared differences of every dictionary value to all entries are
tabulated; the distances of a part are then gathers of table rows by code, added over its dimensions.  Tasks send the sums
and counts of entries, never vectors, so a pass shuffles a bounded number of rows per task and the driver sees one
codebook.

Vectors that are null, empty, or hold a null or an element that isn't finite are dropped, and so are those whose length is
not that of the vector with the smallest id (ties: the smallest vector).  A length that PARTS doesn't divide is an error.
Integers are kept within +-2^27, so that no sum leaves 64 bits.  Of rows with one id the smallest vector can start an
entry; rows without an id come last there.  With fewer ids than ENTRIES there are fewer entries.  Repeated rows are
encoded each.  A table without vectors gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm import shared
from nearfield.session import stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
SLICE_ROWS = 4096
_MOST = 1 << 27

_SLICE = "ids binary, id_known binary, labels binary, label_known binary, dictionary array<binary>, codes array<binary>"


def _vectors(table: DataFrame) -> DataFrame:
    """(vec_id, label, embedding as doubles) of the vectors that take part."""
    doubles = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), doubles.alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(vectors * scale), -_MOST, _MOST).astype(np.int64)


def _first(rows: DataFrame, entries: int) -> list[np.ndarray]:
    """The vectors of the smallest ids; a task passes on no more than ``entries`` of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[bool, int], list[float]] = {}
        for batch in batches:
            ids = batch.column("vec_id")
            order = pc.sort_indices(ids, null_placement="at_end")
            for at in order.to_pylist():
                key = (ids[at].as_py() is None, ids[at].as_py() or 0)
                if len(best) >= entries and key not in best and key > max(best):
                    break
                own = batch.column("embedding")[at].as_py()
                best[key] = min(own, best.get(key, own))
                if len(best) > entries:
                    del best[max(best)]
        keys = sorted(best)
        columns = [pa.array([None if k[0] else k[1] for k in keys], pa.int64()), pa.array([best[k] for k in keys], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "embedding"])

    own = rows.select("vec_id", "embedding").mapInArrow(run, "vec_id bigint, embedding array<double>")
    first = own.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy(F.asc_nulls_last("vec_id")).limit(entries)
    return [np.array(r.embedding) for r in first.collect()]


def _slices(rows: DataFrame, length: int, scale: int) -> DataFrame:
    """Vectors in slices, by dimension: the distinct integers and each vector's place among them."""
    most = SLICE_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column("embedding")), length))
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                n = part.num_rows
                data = integers(part.column("embedding").flatten().to_numpy().reshape(n, length), scale)
                dictionary, codes = zip(*(np.unique(data[:, d], return_inverse=True) for d in range(length)))
                columns = []
                for name in ("vec_id", "label"):
                    column = part.column(name)
                    columns.append(pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes())
                    columns.append(pc.is_valid(column).to_numpy(zero_copy_only=False).tobytes())
                columns += [[x.tobytes() for x in dictionary], [x.astype(np.uint16).tobytes() for x in codes]]
                kinds = [pa.binary()] * 4 + [pa.list_(pa.binary())] * 2
                names = ["ids", "id_known", "labels", "label_known", "dictionary", "codes"]
                yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds)], names=names)

    return stored(rows.mapInArrow(run, _SLICE), "vector-slices")


def assign(dictionary: list[np.ndarray], codes: list[np.ndarray], books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each part's nearest entry; ``books`` is (parts, entries, dimensions of a part)."""
    parts, _, width = books.shape
    index, distance = [], []
    for p in range(parts):
        total = 0
        for j in range(width):
            d = p * width + j
            table = (dictionary[d][:, None] - books[p, :, j]) ** 2
            total = total + table[codes[d]]
        nearest = total.argmin(axis=1)  # the first of the smallest
        index.append(nearest)
        distance.append(total[np.arange(len(nearest)), nearest])
    return np.stack(index, axis=1), np.stack(distance, axis=1)


def _read(row: dict) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [np.frombuffer(x, np.int64) for x in row["dictionary"]], [np.frombuffer(x, np.uint16) for x in row["codes"]]


def _next(slices: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for at in range(batch.num_rows):
                dictionary, codes = _read({n: batch.column(n)[at].as_py() for n in ("dictionary", "codes")})
                index, _ = assign(dictionary, codes, books)
                for p in range(parts):
                    counts[p] += np.bincount(index[:, p], minlength=entries)
                    for j in range(width):
                        d = p * width + j
                        np.add.at(sums[p, :, j], index[:, p], dictionary[d][codes[d]])
        used = np.flatnonzero(counts.ravel())
        columns = [used, counts.ravel()[used]]
        sums = sums.reshape(-1, width)[used]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(sums.tolist(), pa.list_(pa.int64()))], names=["entry", "n", "sums"])

    found = slices.select("dictionary", "codes").mapInArrow(run, "entry bigint, n bigint, sums array<bigint>")
    found = found.groupBy("entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"sum_{j}") for j in range(width)])
    out = books.reshape(-1, width).copy()
    for row in found.collect():  # at most one row per entry
        out[row.entry] = [row[f"sum_{j}"] // row.n for j in range(width)]
    return out.reshape(books.shape)


def _encoded(slices: DataFrame, books: np.ndarray) -> DataFrame:
    parts = books.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(n)[at].as_py() for n in batch.schema.names}
                index, distance = assign(*_read(row), books)
                digits = index.astype(np.uint8).tobytes().hex()
                code = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
                columns = []
                for name, known in (("ids", "id_known"), ("labels", "label_known")):
                    columns.append(pa.array(np.frombuffer(row[name], np.int64), mask=~np.frombuffer(row[known], bool)))
                columns += [pa.array(code), pa.array(distance.sum(axis=1))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    return slices.mapInArrow(run, "vec_id bigint, label bigint, code string, error bigint")


def fit(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """The stored slices of all vectors, and the codebooks."""
    rows = _vectors(table)
    first = _first(rows, entries)
    length = len(first[0]) if first else parts
    if length % parts:
        raise ValueError(f"{parts} parts don't divide a vector of {length} elements")
    start = [integers(v, scale).reshape(parts, -1) for v in first if len(v) == length]
    books = np.stack(start, axis=1) if start else np.zeros((parts, 1, length // parts), np.int64)
    slices = _slices(rows, length, scale)
    for _ in range(rounds):
        books = _next(slices, books)
    return slices, books


def encode(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per vector: vec_id, label, code, error, label_error (summed over equal labels), codebooks_sha256."""
    slices, books = fit(table, parts, entries, rounds, scale)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    rows = stored(_encoded(slices, books), "vector-codes")
    rows = rows.withColumn("key", F.coalesce(F.col("label").cast("string"), F.lit("")))
    labels = rows.groupBy("key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("size"))
    labels = stored(labels, "label-errors")
    joined = shared.attach(rows, labels, "key", "size", rows.count())
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
