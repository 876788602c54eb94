"""Documents and points kept as tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.vectors import METRICS
from nearfield.operators.points import check_ids, delete_points, replace_docs, small_side, upsert_points, without_keys
from nearfield.session import remove, settings, stored


def scan_documents(docs: DataFrame, *, only_missing: bool = False, embedding: str = "embedding") -> DataFrame:
    """Documents to sync; with ``only_missing`` those without an embedding."""
    return docs.where(F.col(embedding).isNull()) if only_missing else docs


def source_status(docs: DataFrame, *, embedding: str = "embedding") -> DataFrame:
    """One row: documents in all, with and without an embedding."""
    total, present = F.count(F.lit(1)), F.count(F.col(embedding))
    return docs.agg(
        total.alias("total_documents"),
        present.alias("documents_with_embeddings"),
        (total - present).alias("documents_without_embeddings"),
    )


FILE_POINTS = 1_000_000  # about as many points per file of a bucket
SIZE = "vector_size"  # a column of the stored points
#: Parquet as a source that answers counts and extremes from the footers of its files.
FOOTERS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


class PointTable:
    """A points table on disk: ``<path>/spec`` (vector size, metric, buckets) and parquet in buckets.

    A point's bucket is a hash of its document (of its id, if it has none), so all points of a document are in one bucket,
    and replacing or deleting by document reads and rewrites the buckets of those documents only.  A bucket has as many
    files as its number of points asks for.  Changes by id look the ids up first, reading no column but these.

    A change rewrites the buckets it touches and no other file.  Their new content is written in full beside the old one
    and takes its place when the job ends (a dynamic overwrite of partitions); one job at a time may change a table.  Choose the number of ``buckets`` for
    the size that is to come: what a change rewrites is at least one of them.
    """

    def __init__(self, spark: SparkSession, path: str, *, buckets: int = 64):
        self.spark = spark
        self.path = path.rstrip("/")
        self._new_buckets = buckets

    def _spec(self) -> tuple[int, str, int] | None:
        try:
            rows = self.spark.read.schema("dim int, metric string, buckets int").json(f"{self.path}/spec").collect()
        except AnalysisException as problem:
            if problem.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        return tuple(rows[0]) if rows else None

    def spec(self) -> tuple[int, str] | None:
        found = self._spec()
        return found[:2] if found else None

    def ensure(self, dim: int, metric: str = "cosine", *, create_if_missing: bool = True) -> bool:
        """True if the table was made just now; raises if it is missing or was made differently."""
        if metric not in METRICS:
            raise ValueError(f"unknown metric '{metric}'; use {', '.join(METRICS)}")
        if not isinstance(dim, int) or dim < 1:
            raise ValueError("vectors need at least one value")
        found = self.spec()
        if found is None and not create_if_missing:
            raise ValueError(f"no points table at {self.path}")
        if found is None:
            row = [(dim, metric, self._new_buckets)]
            self.spark.createDataFrame(row, "dim int, metric string, buckets int").coalesce(1).write.json(f"{self.path}/spec")
            return True
        if found != (dim, metric):
            raise ValueError(f"points table at {self.path} has {found}, not {(dim, metric)}")
        return False

    def _hash(self, key: Column) -> Column:
        spec = self._spec()
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(spec[2] if spec else self._new_buckets)).cast("int")

    def _bucket(self, rows: DataFrame) -> Column:
        own = F.col("id").cast("string")
        return self._hash(F.coalesce(F.col("doc_id").cast("string"), own) if "doc_id" in rows.columns else own)

    def _all(self) -> DataFrame:
        try:
            return self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/points")
        except AnalysisException as problem:
            if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return self.spark.createDataFrame([], f"id string, doc_id string, vector array<double>, bucket int, {SIZE} int")

    def read(self) -> DataFrame:
        return self._all().drop("bucket", SIZE)

    def _distinct(self, buckets: DataFrame) -> list[int]:
        """The buckets in a column of them; as many as the table has, at most."""
        return sorted(r.bucket for r in buckets.select("bucket").distinct().collect())

    def _holding(self, ids: DataFrame) -> DataFrame:
        """The buckets that hold points of these ids."""
        return self._all().select("id", "bucket").join(small_side(ids.select("id").distinct()), "id", "left_semi").select("bucket")

    def _rewrite(self, points: DataFrame, touched: list[int]) -> None:
        """Put ``points``, all of which belong to the ``touched`` buckets, in place of what these hold."""
        fresh = points.withColumn("bucket", self._bucket(points))
        sizes = fresh.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per bucket
        files = self.spark.createDataFrame([(r.bucket, -(-r.n // FILE_POINTS)) for r in sizes], "bucket int, files int")
        dealt = fresh.join(F.broadcast(files), "bucket").withColumn("file", F.pmod(F.xxhash64(F.col("id").cast("string")), F.col("files")))
        dealt = dealt.repartition("bucket", "file").select(*points.columns, F.size("vector").alias(SIZE), "bucket")
        writer = dealt.write.mode("overwrite").options(partitionOverwriteMode="dynamic", maxRecordsPerFile=FILE_POINTS, compression="zstd")
        writer.partitionBy("bucket").parquet(f"{self.path}/points")
        for bucket in set(touched) - {r.bucket for r in sizes}:
            remove(self.spark, f"{self.path}/points/bucket={bucket}")

    def _in(self, touched: list[int]) -> DataFrame:
        return self._all().where(F.col("bucket").isin(touched)).drop("bucket", SIZE)

    def upsert(
        self, new: DataFrame, *, order: str | None = None, metric: str = "cosine", create_if_missing: bool = True, uuids: bool = False
    ) -> tuple[int, bool]:
        """Upsert points; returns how many were submitted and whether the table was made just now.

        Vectors (and with ``uuids`` the shape of the ids) are checked before anything is written.
        """
        new = stored(new, "submitted")
        spec = self.spec()
        seen = new.agg(
            F.count(F.lit(1)).alias("n"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high"),
            F.count_if(F.col("vector").isNull() | F.col("id").isNull()).alias("bad"),
        ).first()
        if not seen.n:
            raise ValueError("give at least one point")
        if seen.bad:
            raise ValueError(f"{seen.bad} points have no id or no vector")
        dim = spec[0] if spec else seen.low
        if (seen.low, seen.high) != (dim, dim) or dim < 1:
            raise ValueError(f"expected {dim} values in every vector, found {seen.low} to {seen.high}")
        if uuids and (wrong := check_ids(new).count()):
            raise ValueError(f"{wrong} ids are not shaped like a UUID")
        created = self.ensure(dim, spec[1] if spec else metric, create_if_missing=create_if_missing)
        own = new.select(self._bucket(new).alias("bucket"))
        touched = self._distinct(own.unionByName(self._holding(new)))  # a point may come under another document
        old = self._in(touched)
        if not old.columns or self._is_empty():
            old = new.drop(*[order] if order else []).limit(0)
        self._rewrite(upsert_points(old, new, order=order, dim=dim), touched)
        return seen.n, created

    def _is_empty(self) -> bool:
        return self._all().isEmpty()

    def delete(self, **criteria) -> tuple[str, int]:
        """Delete points (see ``delete_points``); returns what decided and how many went."""
        found = delete_points(self._scan(criteria), **criteria)
        gone = stored(found.deleted.select("id", "bucket"), "deleted")
        count = gone.count()
        if count:
            touched = self._distinct(gone)
            self._rewrite(without_keys(self._in(touched), gone, "id"), touched)
        return found.deleted_by, count

    def _scan(self, criteria: dict) -> DataFrame:
        """The points that a deletion may concern: of one bucket, if it is by document."""
        all_ = self._all()
        doc_id = criteria.get("doc_id")
        by_document = doc_id is not None and doc_id != "" and criteria.get("ids") in (None, [], ()) and criteria.get("doc_column", "doc_id") == "doc_id"
        return all_.where(F.col("bucket") == self._hash(F.lit(doc_id))) if by_document else all_

    def replace(self, new: DataFrame, docs: DataFrame, *, doc_id: str = "doc_id", kept: bool = False) -> None:
        """Replace all points of ``docs`` by ``new``; with ``kept`` these come from a stored table, not to be stored again."""
        new, docs = new if kept else stored(new, "replacing"), stored(docs.select(doc_id).distinct(), "replaced")
        own = new.select(self._bucket(new).alias("bucket"))
        if self._is_empty():
            self._rewrite(new, self._distinct(own))
            return
        if doc_id == "doc_id":
            theirs = docs.select(self._hash(F.col(doc_id)).alias("bucket"))
        else:  # buckets don't go by this column
            theirs = self._all().select(doc_id, "bucket").join(small_side(docs), doc_id, "left_semi").select("bucket")
        touched = self._distinct(own.unionByName(theirs))
        self._rewrite(replace_docs(self._in(touched), new, docs, doc_id=doc_id), touched)

    def totals(self) -> DataFrame:
        """One row: number of points, smallest and largest vector size, to be planned within ``FOOTERS``.

        Sizes are a column of their own, so these come from the footers of the files and no point is read.
        """
        return self._all().agg(F.count(F.lit(1)).alias("points"), F.min(SIZE).alias("min_dim"), F.max(SIZE).alias("max_dim"))

    def info(self) -> DataFrame:
        """One row: number of points, vector size and metric."""
        dim, metric = self.spec() or (None, None)
        with settings(self.spark, FOOTERS):
            points = self.totals().first().points
        return self.spark.createDataFrame([(points, dim, metric)], "points bigint, dim int, metric string")

    def fits(self) -> bool:
        """Whether all vectors have the table's size."""
        with settings(self.spark, FOOTERS):
            found = self.totals().first()
        return not found.points or (found.min_dim, found.max_dim) == (self.spec()[0],) * 2
