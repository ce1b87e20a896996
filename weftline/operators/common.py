"""Helpers of the operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir. On one machine (local masters) a folder of its own
    will do where none is named; on a cluster that would be lost with the machine, and is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not (sc.master or "").startswith("local[") and sc.master != "local":
                raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
            named = tempfile.mkdtemp(prefix="weftline-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of what is run go when it has run, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise into the shared folder and cut the lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same as a table in the shared folder: compressed, and read by column."""
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table that `stored` made and nothing reads any more."""
    jvm = table.sparkSession.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0]).getParent() if table.inputFiles() else None
    if folder is not None:
        folder.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame) -> DataFrame:
    """Small inputs come in fewer splits than there are cores; then the rows are dealt out, or one core would do the work of
    all. Results do not depend on it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2) if df.rdd.getNumPartitions() < cores else df
