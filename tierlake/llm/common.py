"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on one machine (a local master) and where the session leaves it unset, a temporary folder is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set, and executors do not see the driver's folders")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tierlake-')}")
    return jsc.getCheckpointDir().get().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The table, written to a new path in the shared folder and read again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str) -> bool:
    system, there = _hadoop(spark, path)
    return system.exists(there)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    system, there = _hadoop(spark, path)
    system.delete(there, True)


def dropped(df: DataFrame) -> None:
    """Delete what ``saved`` wrote, once nothing reads it any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        removed(df.sparkSession, folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, which survives lost executors."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_of(col: str | Column = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def id_remainder(col: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id has remainder 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % n, F.lit(0))


#: Bytes of a batch that goes to a Python worker, so that long texts do not meet in one batch by the thousand.
BATCH_BYTES = 4 << 20


def _release() -> None:
    """Give memory that is free, but kept by the allocators, back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: What empties a cache of this worker, and the stage that filled the caches.
_CACHES: list[Callable[[], None]] = []
_STAGE: list[int] = []


def register_cache(forget: Callable[[], None]) -> None:
    """A cache that may live as long as its stage: the worker's first task of another stage calls ``forget``."""
    _CACHES.append(forget)


def _enter() -> None:
    context = TaskContext.get()
    stage = context.stageId() if context else -1
    if _STAGE != [stage]:
        _STAGE[:] = [stage]
        for forget in _CACHES:
            forget()
        _release()


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with batches bounded in bytes as well as in rows, in workers that keep no memory between stages.

    The bound is a setting of the session, which is lowered where it is larger and stays so: plans read it when they run.
    Workers are reused by later tasks and stages; what one stage has freed must not add to the next, and caches that
    ``register_cache`` knows, which are bounded in bytes, are emptied when another stage begins.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(key)
    if not now.isdigit() or int(now) > BATCH_BYTES:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _enter()
        try:
            yield from run(batches)
        finally:
            _release()

    return df.mapInArrow(whole, schema)
