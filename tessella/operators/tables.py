"""Durable intermediate tables: written to the cluster's shared folder, so that a lost executor costs no lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a temporary one only where none is set, as in local tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


#: Shuffle files of an execution go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage and survives lost executors.

    The shuffle files of the write, which nothing reads again, go with its end, so that disks hold one step's at a time."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a join, a window or an aggregate that a task gets on average, where the session's partitions would give it more.
PER_PARTITION = 500_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to a partition for each ``PER_PARTITION`` of ``rows``, so that what a task sorts doesn't grow with the table.

    Two tables dealt by the same keys and number of rows are joined as they lie. Where the session's partitions get fewer rows, nothing is dealt."""
    parts = -(-rows // PER_PARTITION)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that goes by shuffle, whatever the planner takes its size for: files with codes for repeated values are a tenth of what
    a broadcast of them takes in the driver, so a table that grows with the input must not be sent out."""
    return df.hint("merge")


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a table that ``materialize`` wrote and no later step reads."""
    context = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tessella/" in folder:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
