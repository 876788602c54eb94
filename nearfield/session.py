"""Session settings for local runs, and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "nearfield", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")  # one core per task: keep BLAS inside it
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """The session with other settings for a while; what is run inside is planned with them."""
    before = {key: spark.conf.get(key, None) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only where the session names none (a local run) a temporary one is made.
    """
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="nearfield-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return _own_folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder or file on whatever file system the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_stored: list[str] = []


def remove_stored(spark: SparkSession) -> None:
    """Delete everything that ``stored`` wrote so far; call it when no result that reads from it is needed any more."""
    while _stored:
        remove(spark, _stored.pop())


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, safe against lost executors."""
    path = scratch_path(df.sparkSession, name)
    _stored.append(path)
    df.write.option("compression", "zstd").parquet(path)  # texts take about two thirds of the room that snappy leaves them
    return df.sparkSession.read.schema(df.schema).parquet(path)
