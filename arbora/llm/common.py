"""What the operators share: the folder for cut lineage, prefix sums, sizes."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast: at some tens of bytes a row, a few MB.
BROADCAST_ROWS = 100_000
#: Seconds after which ``save`` calls ``release`` again.
RELEASE_S = 15
released = 0.0


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``. Where that is unset, a temporary one, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="arbora-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it back."""
    path = shared_dir(df.sparkSession, name)
    if time.monotonic() > released + RELEASE_S:
        release(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets go of what is no longer referred to: the driver's heap shrinks, and Spark's cleaner deletes shuffle files and broadcasts."""
    global released
    gc.collect()  # Python's handles keep JVM objects alive
    spark.sparkContext._jvm.java.lang.System.gc()
    released = time.monotonic()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows of texts that a Python worker is handed at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running_base(totals: DataFrame, order: list[str], value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before. ``totals`` has a row for each partition of the data, no more."""
    w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))


def join_small(big: DataFrame, small: DataFrame, on: list[str], rows: int, how: str = "inner") -> DataFrame:
    """Broadcasts ``small`` where its ``rows``, counted before, are few; shuffles beyond."""
    return big.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
