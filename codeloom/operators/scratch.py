"""Where iterative operators write their rounds."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; where that is unset, one of its own.

    Results are read lazily, so nothing is deleted while the application runs;
    ``clear_scratch`` deletes the folder, and a temporary one goes at exit.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return f"{base.rstrip('/')}/codeloom-{spark.sparkContext.applicationId}"
    known = spark.conf.get("codeloom.rounds", None)
    if known:
        return known
    master = spark.sparkContext.master
    if master.startswith("local") and "cluster" not in master:
        folder = tempfile.mkdtemp(prefix="codeloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = "file://" + folder
    else:
        base = spark.conf.get("spark.sql.warehouse.dir") + "/_codeloom_rounds"
    spark.conf.set("codeloom.rounds", base)
    return base


def clear_scratch(spark: SparkSession) -> None:
    """Delete what ``materialize`` wrote; results that were not read yet are lost."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark, schema = df.sparkSession, df.schema
    path = f"{scratch_dir(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path), path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; lineage ends here."""
    return _written(df)[0]


#: Rows up to which the planner may broadcast a written table.
SMALL_ROWS = 10_000


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of ``rows`` rows, which the planner does not broadcast if they are many.

    It goes by the size of files, which for names and paths that are much alike can be a
    hundredth of what the driver has to hold. The hint holds for joins of ``df`` and of
    what is selected, exploded or grouped from it; an explicit broadcast goes before it.
    """
    return df if rows <= SMALL_ROWS else df.hint("merge")


def _rows(spark: SparkSession, path: str) -> int:
    """Rows of the files under ``path`` by their footers, which take no job; beyond ``SMALL_ROWS`` no more files are looked at."""
    jvm, conf, rows = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    folder = jvm.org.apache.hadoop.fs.Path(path)
    for status in folder.getFileSystem(conf).listStatus(folder):
        if rows <= SMALL_ROWS and status.getPath().getName().endswith(".parquet"):
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromStatus(status, conf))
            rows += reader.getRecordCount()
            reader.close()
    return rows


def materialize_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``materialize``, ``bounded`` by the rows that were written, and their number; beyond ``SMALL_ROWS`` only that there are more."""
    written, path = _written(df)
    rows = _rows(df.sparkSession, path)
    return bounded(written, rows), rows


def materialize_bounded(df: DataFrame) -> DataFrame:
    return materialize_counted(df)[0]
