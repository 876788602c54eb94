"""Maintain a table of points: upsert, delete, replace, check.

Every function returns the new state of the table as a DataFrame; the caller
writes it where it belongs (see ``nearfield.sources.tables``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.filters import Filter, compile_filter

SMALL_KEYS = 1_000_000  # most keys that are sent to every task
UUID_SHAPE = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def small_side(keys: DataFrame, most: int = SMALL_KEYS) -> DataFrame:
    """``keys``, marked to go to every task if there are at most ``most`` rows.

    A plain count runs in parallel; counting behind a limit would bring the rows to one task.
    """
    return F.broadcast(keys) if keys.count() <= most else keys


def without_keys(df: DataFrame, keys: DataFrame, on: str, small: int = SMALL_KEYS) -> DataFrame:
    """Rows whose key is not among ``keys``.

    Keys are counted to choose the join: few go to every task
    and the table is not shuffled; many meet it in a shuffled anti join.
    """
    return df.join(small_side(keys.select(on).distinct(), small), on, "left_anti")


def latest(df: DataFrame, key: str | list[str], order: Column) -> DataFrame:
    """The last row per key.

    Every task first keeps one row per key of its own, so a key with very many
    rows costs no more than any other.
    """
    # Rows that tie are told apart by what they hold, so a repeated task chooses the same one.
    plain = [f.name for f in df.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    content = F.xxhash64(*[F.col(f"`{name}`") for name in plain])
    window = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(order.desc(), content)
    return df.withColumn("_place", F.row_number().over(window)).where(F.col("_place") == 1).drop("_place")


def upsert_points(
    points: DataFrame, new: DataFrame, *, order: str | None = None, id: str = "id", dim: int | None = None
) -> DataFrame:
    """Points after an upsert: a new point replaces the whole old one of the same id.

    Of new points sharing an id the last by ``order`` counts; rows that tie, or all without an ``order``, are told
    apart by their content, the same way in every run.
    With ``dim`` a vector of another size fails the job; columns the new points
    lack become NULL.
    """
    position = F.col(order) if order else F.lit(0)
    fresh = latest(new.withColumn("_order", position), id, F.col("_order")).drop("_order")
    if order and order not in points.columns:
        fresh = fresh.drop(order)
    if dim is not None:
        right = F.coalesce(F.size("vector") == dim, F.lit(False))
        message = F.concat(F.lit(f"expected {dim} values in the vector of point "), F.col(id).cast("string"))
        fresh = fresh.withColumn("vector", F.when(right, F.col("vector")).otherwise(F.raise_error(message)))
    return without_keys(points, fresh, id).unionByName(fresh, allowMissingColumns=True)


def replace_docs(points: DataFrame, new: DataFrame, docs: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """Points after all points of ``docs`` gave way to the ones in ``new``."""
    return without_keys(points, docs, doc_id).unionByName(new, allowMissingColumns=True)


@dataclass(frozen=True)
class Deletion:
    remaining: DataFrame
    deleted: DataFrame
    deleted_by: str

    def count(self) -> int:
        return self.deleted.count()


def delete_points(
    points: DataFrame,
    *,
    ids: Sequence | DataFrame | None = None,
    doc_id: object = None,
    where: Filter | None = None,
    id: str = "id",
    doc_column: str = "doc_id",
) -> Deletion:
    """Delete by ids, else by document, else by filter: the first criterion given decides.

    An empty list of ids counts as not given; a DataFrame of ids may be of any size.
    """
    if isinstance(ids, DataFrame):
        side = small_side(ids.select(id).distinct())
        return Deletion(points.join(side, id, "left_anti"), points.join(side, id, "left_semi"), "ids")
    if ids:
        condition, by = F.col(id).isin(list(ids)), "ids"
    elif doc_id is not None and doc_id != "":
        condition, by = F.col(doc_column) == F.lit(doc_id), "doc_id"
    elif where:
        condition, by = compile_filter(where, points.schema), "filter"
    else:
        raise ValueError("give ids, doc_id or where")
    condition = F.coalesce(condition, F.lit(False))
    return Deletion(points.where(~condition), points.where(condition), by)


def check_dims(points: DataFrame, dim: int, *, vector: str = "vector") -> DataFrame:
    """Points whose vector is missing or not of size ``dim``."""
    return points.where(F.coalesce(F.size(vector) != dim, F.lit(True)))


def check_ids(points: DataFrame, *, id: str = "id") -> DataFrame:
    """Points whose id is not shaped like a UUID."""
    return points.where(~F.coalesce(F.col(id).rlike(UUID_SHAPE), F.lit(False)))


def points_info(points: DataFrame, *, vector: str = "vector") -> DataFrame:
    """One row: number of points, smallest and largest vector size."""
    return points.agg(
        F.count(F.lit(1)).alias("points"),
        F.min(F.size(vector)).alias("min_dim"),
        F.max(F.size(vector)).alias("max_dim"),
    )
