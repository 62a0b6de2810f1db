"""Helpers shared by the corpus operators: input reading, slices of Arrow batches, joins on very common keys."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.tables import drop_table, materialize, shared_dir, shuffled  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that a task turns into Python strings at once.
SLICE_BYTES = 2_000_000
#: Shares of the rows above which a key is split: at most so many keys are.
SHARES = 10_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of text in a column, one row at least."""
    at, size = 0, 0
    for i, text in enumerate(batch.column(column)):
        n = len(text.as_buffer()) if text.is_valid else 0
        if i > at and size + n > most:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    if batch.num_rows > at:
        yield batch.slice(at)


def join_counted(rows: DataFrame, table: DataFrame, key: str, total: int, salt: Column, how: str = "left") -> DataFrame:
    """``rows`` joined with ``table`` on ``key``, which is distinct there; its column ``_n`` counts the key's rows of ``total``.

    Keys that hold more than one ``SHARES``-th of the rows are split so that no task gets more of one key. There are at most
    ``SHARES`` of them, so their list is broadcast. ``salt``: a number that differs among rows; rows without a key are spread alike."""
    heavy = table.filter(F.col("_n") * SHARES > total).select(key, F.ceil(F.col("_n") * SHARES / F.lit(max(1, total))).cast("int").alias("_splits"))
    left = rows.join(F.broadcast(heavy), key, "left").withColumn("_salt", F.pmod(salt, F.when(F.col(key).isNull(), SHARES).otherwise(F.coalesce("_splits", F.lit(1)))).cast("int")).drop("_splits")
    right = table.drop("_n").join(F.broadcast(heavy), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_splits", F.lit(1)) - 1))).drop("_splits")
    return left.join(shuffled(right), [key, "_salt"], how).drop("_salt")
