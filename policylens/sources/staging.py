"""Intermediate tables in the folder the cluster shares, so that losing an executor loses nothing."""

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

_scratch = ContextVar("scratch", default=None)


def shared_folder(spark):
    """Folder for intermediate tables: `spark.checkpoint.dir`, or a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="policylens-"))
    return context.getCheckpointDir()


def _own_folder(spark):
    return f"{shared_folder(spark)}/policylens/{spark.sparkContext.applicationId}"


def new_path(spark, label):
    return f"{_scratch.get() or _own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _delete(spark, folder):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove_intermediate(spark):
    """Delete this application's intermediate tables, once no result that reads them is needed."""
    _delete(spark, _own_folder(spark))


@contextmanager
def scratch(spark):
    """Intermediate tables written inside are deleted at the end, also after an error.

    For jobs: what they return must be read from where they store it, not from these tables.
    """
    folder = new_path(spark, "scratch")
    token = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(token)
        _delete(spark, folder)


def stage(df, label, partition_by=()):
    """Write `df` once and return the stored table: columnar, prunable, and cut from its lineage."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df):
    """A table of totals, written once so that no later stage derives it again.

    Whether it is broadcast is left to Spark, which knows its bytes.
    """
    return stage(df, "totals")
