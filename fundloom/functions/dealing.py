"""Rows dealt by a key to a number of tasks that grows with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

#: Rows to which a task of its own is worth while.
FEW = 50


def parts_of(spark: SparkSession, rows: int, at_once: int) -> int:
    """Tasks for so many rows: as many as the session shuffles to or has cores, and more where each would have over at_once."""
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(1, min(least, rows // FEW), -(-rows // at_once))


def dealt(rows: DataFrame, parts: int, key: str | Column) -> DataFrame:
    """The rows with equal keys together. The number of tasks is said, as Spark puts tasks together by bytes: a few narrow rows, from which much is made, would be one task, and a task's rows would grow with the input."""
    return rows.repartition(parts, key)
