"""Text features: the first 512 bytes through a fixed random multilayer perceptron, and the confidence boost from them."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAYERS = (512, 1024, 1024, 512, 256, 128)


@functools.cache
def weights() -> tuple[np.ndarray, ...]:
    """He-normal weights from seed 42, drawn layer by layer; made once in each worker, biases are zero."""
    rng = np.random.default_rng(42)
    return tuple((rng.standard_normal((a, b)) * np.sqrt(2.0 / a)).astype(np.float32) for a, b in zip(LAYERS[:-1], LAYERS[1:], strict=True))


def encode(texts: pd.Series) -> np.ndarray:
    raw = b"".join((t or "").encode()[:512].ljust(512, b"\0") for t in texts)
    return np.frombuffer(raw, np.uint8).reshape(-1, 512).astype(np.float32) / np.float32(255)


def infer(x: np.ndarray) -> np.ndarray:
    *hidden, last = weights()
    for w in hidden:
        x = np.maximum(x @ w, 0)
    return 1 / (1 + np.exp(-(x @ last)))


def _features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(list(infer(encode(texts)))) if len(texts) else pd.Series([], dtype=object)


def text_features(docs: DataFrame) -> DataFrame:
    """(doc_id, features, mean) per document; a null text is empty."""
    features = F.pandas_udf(_features, "array<float>")
    out = docs.select("doc_id", features(F.coalesce("text", F.lit(""))).alias("features"))
    return out.select("doc_id", "features", (F.aggregate("features", F.lit(0.0), lambda a, x: a + x) / F.size("features")).alias("mean"))


def boost(entities: DataFrame, means: DataFrame) -> DataFrame:
    """Confidences raised by a twentieth of the document's feature mean, to one at most."""
    return entities.join(means.select("doc_id", "mean"), "doc_id", "left").withColumn("confidence", F.least(F.lit(1.0), F.col("confidence") + F.coalesce("mean", F.lit(0.0)) * 0.05)).drop("mean")


def performance_summary(runs: DataFrame) -> DataFrame:
    """runs (name, device cpu or npu, avg_ms, tokens_per_sec) -> per name the times and rates of both devices and the speedup, 0 where there is none."""
    of = lambda device, c: F.max(F.when(F.col("device") == device, F.col(c)))
    both = runs.groupBy("name").agg(of("cpu", "avg_ms").alias("cpu"), of("npu", "avg_ms").alias("npu"), of("cpu", "tokens_per_sec").alias("cpu_rate"), of("npu", "tokens_per_sec").alias("npu_rate"))
    zero = lambda c, places: F.coalesce(F.bround(c, places), F.lit(0.0))
    speedup = F.when(F.col("npu") > 0, F.bround(F.col("cpu") / F.col("npu"), 2)).otherwise(F.lit(0.0))
    return both.where("cpu is not null").select(
        "name", zero("cpu", 2).alias("cpu_avg_ms"), zero("npu", 2).alias("npu_avg_ms"), F.coalesce(speedup, F.lit(0.0)).alias("speedup"),
        zero("cpu_rate", 0).alias("cpu_tokens_sec"), zero("npu_rate", 0).alias("npu_tokens_sec"), F.col("npu").isNotNull().alias("npu_available"),
    )
