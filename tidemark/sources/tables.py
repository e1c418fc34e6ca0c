"""Parquet tables by folder and name, and tables that cut a plan in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Let Python workers that share this machine's files import the library; elsewhere it comes by ``--py-files``."""
    paths = spark.sparkContext.environment.setdefault("PYTHONPATH", _ROOT)
    if _ROOT not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{paths}:{_ROOT}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share; where it is unset a local one, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = context.get() if context.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"


def new_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Bytes of the batches that Python kernels get; their workers and the executors' buffers hold several of them at a time.
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 1 << 20

#: While a table is written: its plan's shuffle files go when it stands, as no later plan reads them, and Python gets batches of bounded size.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", _BATCH: str(BATCH_BYTES)}

#: Folders cut by each operator that is under way, the innermost last.
_made: ContextVar[tuple[list[str], ...]] = ContextVar("made", default=())


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, so that lost executors cost no recomputation."""
    spark, path = df.sparkSession, new_dir(df.sparkSession, what)
    before = {key: spark.conf.get(key, None) for key in _WRITING}
    for key, value in _WRITING.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    for made in _made.get()[-1:]:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose session hands Python batches of BATCH_BYTES from now on, unless it was told a size.

    For kernels whose rows are handed on unwritten: Spark asks for the size when they run, after the operator has returned.
    """
    if df.sparkSession.conf.get(_BATCH, None) is None:
        df.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))
    return df


#: Bytes of a plan's estimated size for a partition of rows dealt out by key. The estimate is of packed files; rows in a sort are some ten times as large.
SPREAD_BYTES = 4 << 20


MOST_PARTS = 4_000


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` dealt out by key, in as many partitions as its size asks for where those are more than the cores, so that a task's rows don't grow with it.

    For plans over files: of other sources, and of joins, Spark's estimate says nothing; beyond a petabyte it isn't heeded.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = min(size // SPREAD_BYTES, MOST_PARTS) if size < 1 << 50 else 0
    return df.repartition(parts, *keys) if parts > df.sparkSession.sparkContext.defaultParallelism else df.repartition(*keys)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def standing(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Let ``operator`` return a table of its own, and delete the tables that it and what it calls cut their plans with."""

    @wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        inner: list[str] = []
        token = _made.set((*_made.get(), inner))
        try:
            out = cut(operator(*args, **kwargs), operator.__name__)
            whole = inner.pop()
        finally:
            _made.reset(token)
            for path in inner:
                delete(SparkSession.active(), path)
        for made in _made.get()[-1:]:
            made.append(whole)
        return out

    return run
