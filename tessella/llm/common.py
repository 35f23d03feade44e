"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import functools
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the Arrow batches that reach Python workers, unless the session already chose a size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) == 10000:
        spark.conf.set(key, str(rows))


def use_checkpoints(spark: SparkSession) -> None:
    """Use the folder that the cluster names; only a local session gets a private one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessella-checkpoints-"))


def let(value, body):
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable.

    Catalyst may inline a projected expression into every use of it; a lambda variable cannot be inlined.
    """
    return F.transform(F.array(value), body)[0]


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, after which the worker gives memory that it has freed back to the system.

    Workers outlive their tasks; without this each keeps the most that any task has used.
    """

    @functools.wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return inner
