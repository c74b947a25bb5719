"""Helpers that several operators use: shared scratch tables, size-checked joins, numbering."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that a broadcast side may have at most, uncompressed, as Spark counts its columns.
BROADCAST_BYTES = 32 << 20
#: Bytes of an Arrow batch of rows on their way to Python; the JVM and the worker each hold one, and Spark's default is 64 MiB.
BATCH_BYTES = 8 << 20

_own_folders: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). A local session without one gets a temporary one, a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="fundloom-")
    return _own_folders[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; clear_scratch deletes what is written there."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH_BYTES meanwhile; the session's setting is put back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def saved(df: DataFrame, name: str) -> str:
    """Writes df as a table in the shared folder; its path."""
    path = scratch_path(df.sparkSession, name)
    with _small_batches(df.sparkSession):
        df.write.parquet(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Deletes the tables, archives and media that the operators of this application have left in the shared folder, and says how many.

    To be called when their results have been written elsewhere: a result that is still to be computed reads them.
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage, survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(saved(df, name))


def _bytes(table: DataFrame) -> Column:
    """Bytes of the rows: what arrays, strings and binaries hold, and 16 for each column of each row."""
    held = F.count("*") * 16 * len(table.columns)
    for f in table.schema.fields:
        kind = f.dataType.simpleString()
        if kind in ("string", "binary"):
            held = held + F.coalesce(F.sum(F.octet_length(f.name)), F.lit(0))
        elif kind.startswith("array"):
            held = held + F.coalesce(F.sum(F.size(f.name)), F.lit(0)) * 32
    return held


def small(table: DataFrame) -> DataFrame:
    """The written table, marked for broadcast if its measured size is within BROADCAST_BYTES; as it is otherwise."""
    return F.broadcast(table) if table.agg(_bytes(table)).first()[0] <= BROADCAST_BYTES else table


def attach(big: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Joins big rows (whole texts) with a narrow written table: broadcast if it is small, else both sides are shuffled."""
    return big.join(small(table), on, how)


def attach_null_safe(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Joins each row with the table's row of an equal or equally missing `on`; rows keeps the column."""
    other = small(table.withColumnRenamed(on, "_on"))
    return rows.join(other, F.col(on).eqNullSafe(F.col("_on"))).drop("_on")


def numbered(df: DataFrame, order: Column) -> DataFrame:
    """df with nth, from 1 in the given order of its rows: ranges are numbered each by itself and moved by the sizes of those before."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per part
    before = before.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return ranged.withColumn("_nth", within).join(F.broadcast(before), "_part").select(*df.columns, (F.col("_nth") + F.col("_before")).alias("nth"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
