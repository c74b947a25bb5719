"""Entities kept from run to run, by the hash of their text: a run extracts only from texts that no run before has seen."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundloom.operators.extract import text_entities


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def update(docs: DataFrame, store: str, kinds: set[str] | None = None) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, content_hash, redone) of the documents with a text, whose entities the store then holds.

    store: a folder with two tables, `seen` (content_hash, run) and `entities` (content_hash and an entity). Equal texts
    are one text. Texts are marked as seen after their entities are written, so a run that was broken off is repeated;
    `entities` may then hold some twice, of which `entities` (the function) gives each once.
    """
    spark = docs.sparkSession
    hashed = docs.where("text is not null").select("doc_id", F.sha2("text", 256).alias("content_hash"), "text")
    seen = _stored(spark, f"{store}/seen")
    known = spark.createDataFrame([], "content_hash string, run long") if seen is None else seen
    run = (known.agg(F.max("run")).first()[0] or 0) + 1
    fresh = hashed.join(known, "content_hash", "left_anti").groupBy("content_hash").agg(F.first("text").alias("text"))
    found = text_entities(fresh.select(F.col("content_hash").alias("doc_id"), "text"), kinds)
    found.withColumnRenamed("doc_id", "content_hash").write.mode("append").parquet(f"{store}/entities")
    hashed.join(known, "content_hash", "left_anti").select("content_hash", F.lit(run).cast("long").alias("run")).distinct().write.mode("append").parquet(f"{store}/seen")
    now = spark.read.parquet(f"{store}/seen")
    return hashed.select("doc_id", "content_hash").join(now, "content_hash").select("doc_id", "content_hash", (F.col("run") == run).alias("redone"))


def entities(docs: DataFrame, store: str) -> DataFrame:
    """Entities of docs (doc_id, text) out of the store, like those of `text_entities`."""
    held = docs.sparkSession.read.parquet(f"{store}/entities").dropDuplicates(["content_hash", "seq"])
    return docs.where("text is not null").select("doc_id", F.sha2("text", 256).alias("content_hash")).join(held, "content_hash").drop("content_hash")
