"""Where lineage is cut and scratch tables go.

One rule on every master: the shared folder that the session names in
``spark.checkpoint.dir``. Only where it is unset and the master is local (as in
tests) a private temporary folder is set for it; on a cluster an unset folder
is an error. Scratch tables of an application are deleted when it ends.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex
_cleaned: set[str] = set()


def checkpoint_dir(spark: SparkSession) -> str:
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        sc = spark.sparkContext
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = sc.getCheckpointDir()
        if not conf:
            conf = tempfile.mkdtemp(prefix="tablelens-ckpt-")
            sc.setCheckpointDir(conf)
    return conf.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    root = f"{checkpoint_dir(spark)}/tablelens-scratch-{_RUN}"
    if root not in _cleaned:
        _cleaned.add(root)
        atexit.register(_drop, spark, root)
    return f"{root}/{uuid.uuid4().hex}/{name}"


def _drop(spark: SparkSession, root: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        _delete(spark, root)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_table(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows written once to the shared folder and read back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def drop_tables(*tables: DataFrame) -> None:
    """Deletes scratch tables that nothing reads any more, so that a job of many
    steps holds the disk of a few."""
    for table in tables:
        _delete(table.sparkSession, table.scratch_path)


def free_shuffles(spark: SparkSession) -> None:
    """Spark deletes the files of a shuffle when the driver no longer holds its plan:
    the plans of jobs that have ended go at once."""
    gc.collect()
    spark._jvm.System.gc()


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never localCheckpoint."""
    spark = df.sparkSession
    base = checkpoint_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint(eager=True)
