"""What the operators of this subpackage share: reading, staging, Arrow helpers."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import stratalens
from stratalens.plans.staging import drop as drop
from stratalens.plans.staging import stage as stage

# Functions sent to executors travel by value, so that workers need no copy of the repository.
cloudpickle.register_pickle_by_value(stratalens)

#: Bounds of an Arrow batch, by rows and by bytes: whole texts may be long.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def tune(spark: SparkSession) -> None:
    """Keeps Arrow batches small enough for long texts: a batch closes at either bound, so only one long text overruns it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod(column: str, n: int):
    """crc32 of a column's text modulo ``n``; 0 for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % n, F.lit(0))


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list:
    """A string column as Python bytes; null stays None."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def worker_cache(key, make):
    """One object per Python worker process, made at first use."""
    held = sys.modules.setdefault("_stratalens_worker", type(sys)("_stratalens_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]
