"""From raw documents to packed sequences. Every stage takes what its predecessor kept, all but the last return documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fundloom.llm.jaccard import near_copies
from fundloom.llm.mixing import mixed_documents
from fundloom.llm.packing import pack
from fundloom.llm.quality import keep_quality
from fundloom.llm.queries import tokenizer_path
from fundloom.llm.shared import attach, materialize, scratch_path, table
from fundloom.llm.substring import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word Jaccard 0.8 or more) the document with the least doc_id stays; rows without doc_id stay too."""
    gone = materialize(near_copies(docs).where("doc_id > component_id").select("doc_id").distinct(), "near_copies")
    return attach(docs, gone, ["doc_id"], "left_anti").select(*docs.columns)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document before has go from the text."""
    return without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, rather those that look like labelled good ones; the weight is fitted on the corpus as it came, as bad documents are gone here."""
    return mixed_documents(docs, labels=table(spark, sf_dir, "labels"), fit_on=table(spark, sf_dir, "documents"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its place in a sequence."""
    return pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_spans", repeated_spans),
    ("mixture", mixture),
    ("packing", packing),
]

#: Hashes, fingerprints and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
