"""Helpers shared by the training-data operators.

Nothing here collects rows: intermediate results are written as Parquet to the
folder that the cluster names in ``spark.checkpoint.dir``, so that a lost
executor costs a re-read and not a re-run.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words as the contracts of the size, quality and SimHash operators define them.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: A side is broadcast only if its counted rows stay below this many.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; where that is unset, one of its own.

    Results are read lazily, so nothing is deleted while the application runs;
    ``clear_shared`` deletes the folder, and a temporary one goes at exit.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir")
    if base:
        return f"{base.rstrip('/')}/codeloom-{spark.sparkContext.applicationId}"
    known = spark.conf.get("codeloom.scratch", None)
    if known:
        return known
    master = spark.sparkContext.master
    if master.startswith("local") and "cluster" not in master:
        folder = tempfile.mkdtemp(prefix="codeloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = "file://" + folder
    else:
        base = spark.conf.get("spark.sql.warehouse.dir") + "/_codeloom_scratch"
    spark.conf.set("codeloom.scratch", base)
    return base


def clear_shared(spark: SparkSession) -> None:
    """Delete what ``materialize`` wrote; results that were not read yet are lost."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that go to a Python worker at once. Texts are long: the default of 10,000 rows
#: takes tens of megabytes on either side of the pipe, in several copies.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Plans that run inside send at most BATCH_ROWS rows to Python at once."""
    before = spark.conf.get(_BATCH)
    try:
        if not 0 < int(before) <= BATCH_ROWS:
            spark.conf.set(_BATCH, str(BATCH_ROWS))
        yield
    finally:
        spark.conf.set(_BATCH, before)


def trim() -> None:
    """Give freed memory of this Python worker back: workers live on and serve the next operator."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


#: What libraries call the function that sets their number of threads.
_SET_THREADS = ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads", "MKL_Set_Num_Threads")


@functools.cache
def single_thread() -> None:
    """Let the matrix products of this Python worker use one thread.

    A task has one core; threads of small products mostly wait for each other, and the
    waiting is paid for in CPU time. Where no such library is found nothing changes.
    """
    with contextlib.suppress(OSError):
        with open("/proc/self/maps", encoding="utf-8", errors="replace") as f:
            paths = {line.split()[-1] for line in f if "blas" in line.lower() or "mkl_rt" in line}
        for path in paths:
            with contextlib.suppress(OSError):
                library = ctypes.CDLL(path)
                for name in _SET_THREADS:
                    if hasattr(library, name):
                        getattr(library, name)(1)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_join(left: DataFrame, right: DataFrame, on: Column | list[str], how: str, rows: int) -> DataFrame:
    """Join with ``right`` broadcast if its counted ``rows`` allow it, else by a shuffle."""
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right, on, how)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def running_total(df: DataFrame, group: str, order: list[str], value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` within ``group`` in ``order``.

    A plain window would gather a group in one task. Here rows are dealt by range
    over (group, order), so a hot group spreads over many tasks; each slice is
    summed, slice offsets are added up (one row for each slice and group), and the
    window runs inside a slice only.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(partitions(spark), group, *order).withColumn("_slice", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    before = W.partitionBy(group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_slice", group)
        .agg(F.sum(value).alias("_sum"))
        .select(
            F.col("_slice").alias("_s"),
            F.col(group).alias("_g"),
            F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"),
        )
    )
    inside = W.partitionBy("_slice", group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = ranged.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = local.join(offsets, (local["_slice"] == offsets["_s"]) & local[group].eqNullSafe(offsets["_g"]), "left")
    return joined.withColumn(out, F.col("_local") + F.coalesce("_offset", F.lit(0))).drop("_slice", "_local", "_s", "_g", "_offset")
