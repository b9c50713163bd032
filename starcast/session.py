"""Session defaults for local runs, and tables written to storage that every executor can reach."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and the bench. On a cluster the caller passes its own session to every function."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("starcast")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        # Small written tables are still read by all cores.
        .config("spark.sql.files.openCostInBytes", str(256 * 1024))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables and checkpoints.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master, where driver and executors are one process,
    gets a temporary folder of its own; ``local-cluster`` does not.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="starcast-"))
    return context.getCheckpointDir()


# The paths handed out, job by job: the last list belongs to the innermost scope.
_scopes: list[list[str]] = [[]]


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below :func:`shared_dir`, for a table that is needed as long as the current job."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _scopes[-1].append(path)
    return path


def _delete(spark: SparkSession, paths: list[str]) -> int:
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    deleted = 0
    while paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
        deleted += path.getFileSystem(configuration).delete(path, True)
    return deleted


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """A job: what is written to :func:`shared_path` inside is deleted at the end, once the results are stored. Tables
    of other jobs stay."""
    own: list[str] = []
    _scopes.append(own)
    try:
        yield
    finally:
        _scopes[:] = [scope for scope in _scopes if scope is not own]
        _delete(spark, own)


def discard_intermediates(spark: SparkSession) -> int:
    """Delete what the current job has written so far, once the results that read it are stored."""
    return _delete(spark, _scopes[-1])


@contextmanager
def _own_shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries inside go as soon as each query ends, since its result is stored by then."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Rows of a file of a training table. Learners keep a part of their input as one block, many times as large as its file.
ROWS_PER_TRAINING_FILE = 50_000


@contextmanager
def a_task_per_file(spark: SparkSession) -> Iterator[None]:
    """Reads inside give each file its own task, so what a task reads of a training table has a bound of rows."""
    name = "spark.sql.files.openCostInBytes"
    before, largest = spark.conf.get(name), spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(name, largest)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize_training(df: DataFrame, label: str) -> DataFrame:
    """As :func:`materialize`, in files of a bounded number of rows, for :func:`a_task_per_file`."""
    return materialize_measured(df, label, ROWS_PER_TRAINING_FILE)[0]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to shared storage and read it back.

    For results that several later stages, or an iterative fit, read again. Unlike cached blocks the table outlives a
    lost executor, and unlike a checkpointed RDD it keeps column pruning and filter push-down.
    """
    return materialize_measured(df, label)[0]


def materialize_measured(
    df: DataFrame, label: str, rows_per_file: int = 0, **measures: Column
) -> tuple[DataFrame, dict]:
    """As :func:`materialize`; also returns aggregates of the written rows, which cost no further pass.

    ``rows_per_file``: the most rows of a file, 0 for no bound.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    observed: dict = {}
    with _own_shuffles_deleted(spark):
        if measures:
            observation = Observation()
            df.observe(observation, *[measure.alias(name) for name, measure in measures.items()]).write.option(
                "maxRecordsPerFile", rows_per_file
            ).parquet(path)
            observed = observation.get
        else:
            df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path), observed


def materialize_parts(spark: SparkSession, builds: Sequence[Callable[[], DataFrame]], label: str) -> DataFrame:
    """The rows of several tables, as :func:`materialize` of their union, made one after the other.

    What a part wrote on its way and its shuffle files are gone before the next part begins.
    """
    paths, schema = [], None
    for build in builds:
        path = shared_path(spark, label)
        with intermediates(spark), _own_shuffles_deleted(spark):
            part = build()
            part.write.parquet(path)
        paths, schema = [*paths, path], part.schema
    return spark.read.schema(schema).parquet(*paths)


def row_count() -> Column:
    return F.count(F.lit(1))
