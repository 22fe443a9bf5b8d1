"""Session defaults and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("newsignal")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names.

    A temporary one is made only in local mode, where one machine is all there is.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or context.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


# Paths that the innermost scope deletes; None outside of scopes.
WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def materialise(df: DataFrame, **options: object) -> DataFrame:
    """Cut the lineage of a table that several later jobs read.

    The rows are written as a Parquet table in the shared folder, so a lost
    executor does not lose them and later reads prune columns. Inside of
    `scratch` the table lives as long as the scope. `options` are those of the
    writer.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    written = WRITTEN.get()
    if written is not None:
        written.append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs run inside of it send batches of some `most` bytes to Python, of one row at least."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A scope whose written tables are deleted at its end.

    Yields a function that writes a table for the scope around this one: what
    is to be read after the end must go through it, because a DataFrame that
    reads a deleted table cannot run.
    """
    outer, inner = WRITTEN.get(), []
    token = WRITTEN.set(inner)

    def keep(df: DataFrame) -> DataFrame:
        here = WRITTEN.set(outer)
        try:
            return materialise(df)
        finally:
            WRITTEN.reset(here)

    try:
        yield keep
    finally:
        WRITTEN.reset(token)
        hadoop = spark._jvm.org.apache.hadoop
        for path in inner:
            folder = hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def at_once(spark: SparkSession, steps: Sequence[Callable[[], DataFrame]], threads: int = 4) -> list[DataFrame]:
    """Runs independent steps that start jobs of their own side by side."""
    scope = copy_context()
    with ThreadPool(min(threads, max(len(steps), 1))) as pool:
        return pool.map(lambda step: scope.copy().run(inheritable_thread_target(spark)(step)), steps)
