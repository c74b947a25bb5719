"""The stateless stages on a stream: folders of pages or texts to entities, as files come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundloom.operators.extract import text_entities
from fundloom.sources.html import parse_pages

PAGE = "page_id long, url string, html string"


def stream_pages(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """Pages (page_id, url, html) from the parquet files of a folder, as they come."""
    return spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def page_entities(pages: DataFrame) -> DataFrame:
    """Entities of the texts of pages, stream or not: no state, so no watermark is needed."""
    return text_entities(parse_pages(pages, "text").select(F.col("page_id").alias("doc_id"), "text"))


def write_available(entities: DataFrame, path: str, checkpoint: str) -> None:
    """Takes what has come since the last call, appends its entities under path and ends. Each file counts once, whatever is repeated."""
    entities.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
