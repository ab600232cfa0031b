"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from functools import partial

from pyspark.sql import DataFrame, SparkSession

#: Used only by sessions of a single machine that name no shared folder.
DEFAULT_DIR = "file:///tmp/checkpoints"
#: Folder of the run in progress, below the shared one.
_RUN: ContextVar[str | None] = ContextVar("run", default=None)


def shared_path(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or DEFAULT_DIR
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends here. A ``lasting`` table outlives :func:`passing`."""
    run = None if lasting else _RUN.get()
    path = f"{run}/{name}-{uuid.uuid4().hex}" if run else shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_once[T](calls: Sequence[Callable[[], T]]) -> list[T]:
    """The results of ``calls``, whose Spark jobs are small and independent, run at the same time."""
    with ThreadPoolExecutor(len(calls) or 1) as pool:
        jobs = [pool.submit(copy_context().run, call) for call in calls]
    return [job.result() for job in jobs]


def settle_all(tables: Sequence[DataFrame], name: str) -> list[DataFrame]:
    """:func:`settle` for independent ``tables``, at the same time."""
    return at_once([partial(settle, t, name) for t in tables])


def remove(spark: SparkSession, path: str) -> None:
    """Delete the folder ``path``, if it is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def passing(spark: SparkSession, name: str) -> Iterator[str]:
    """Tables settled inside lie in one folder, which is removed at the end: nothing may read them afterwards."""
    path = shared_path(spark, name)
    token = _RUN.set(path)
    try:
        yield path
    finally:
        _RUN.reset(token)
        remove(spark, path)
