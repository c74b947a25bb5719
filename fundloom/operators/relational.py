"""What happens to entities as rows: keep-best dedup, threshold, counts, histogram, display."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 0.65


def keep_best(entities: DataFrame) -> DataFrame:
    """Of equal (entity_type, value_str) in a document the most confident stays, the first in a tie, at the first one's place."""
    same = Window.partitionBy("doc_id", "entity_type", "value_str")
    ranked = entities.withColumn("_rank", F.row_number().over(same.orderBy(F.desc("confidence"), "seq"))).withColumn("_first", F.min("seq").over(same))
    return ranked.where("_rank = 1").withColumn("seq", F.col("_first")).drop("_rank", "_first")


def confident(entities: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return entities.where(F.col("confidence") >= threshold)


def entity_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("entity_type").agg(F.count("*").alias("n"))


def ranked_counts(counts: DataFrame) -> DataFrame:
    """counts (entity_type, n) with place, the most frequent first; a row per type, so one window holds them."""
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "entity_type")).cast("long"))


def totals(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, text_length, total_entities, n_types) of docs (doc_id, text) and their entities."""
    found = entities.groupBy("doc_id").agg(F.count("*").alias("total_entities"), F.count_distinct("entity_type").alias("n_types"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return docs.select("doc_id", F.length("text").cast("long").alias("text_length")).join(found, "doc_id", "left").select("doc_id", "text_length", zero("total_entities"), zero("n_types"))


def histogram(entities: DataFrame, bins: int = 20) -> DataFrame:
    slot = F.least(F.width_bucket("confidence", F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins))
    return entities.groupBy(slot.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def display(entities: DataFrame, longest: int = 80) -> DataFrame:
    value = F.when(F.length("value") > longest, F.concat(F.left("value", F.lit(longest)), F.lit("..."))).otherwise(F.col("value"))
    return entities.select("doc_id", "seq", "entity_type", value.alias("value"), F.concat(F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%")).alias("confidence"))
