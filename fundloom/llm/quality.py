"""Quality classifier by importance resampling.

Two generative models of hashed n-grams are fitted: one of target text (labelled good documents, a bounded sample)
and one of the raw text (counts over all documents). A document's log ratio of the two, per n-gram, so that long and
short texts compare, times a temperature, is its log importance weight. The temperature, one number, and what is added
to all alike are such that on the labelled sample the weights are log odds of being a target; labelled bad documents
have no other part in it. Documents are resampled without replacement by Gumbel top-k: the k largest of log weight +
Gumbel noise. k is a given share of the documents, or by default the number of target documents that the weights
expect among all, the sum of w / (1 + w). Documents far from the border are taken or left whatever their noise; near
it the noise decides, in proportion to the odds.

The n-grams are byte trigrams, and per word whether it and its predecessor have been seen together before in the
document, which tells text that repeats itself; each kind has its own mean, and the log ratio is their sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundloom.llm.shared import materialize

#: Hash buckets of trigrams; two more count new and repeated word pairs.
TRIGRAMS = 1 << 15
BUCKETS = TRIGRAMS + 2
#: Labelled rows that the target model and the scale are fitted on, at most.
LABELLED = 5_000
#: Weight of the squared coefficients in the regression, which bounds them where good and bad are fully apart.
RIDGE = 1.0
SEED = 11


def trigrams(text: bytes | None) -> np.ndarray:
    """Bucket of each byte trigram."""
    data = np.frombuffer(text or b"", np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.uint32)
    code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(17)


def pairs(text: bytes | None) -> tuple[int, int]:
    """Pairs of neighbouring words that are new in the text, and repeated ones."""
    words = (text or b"").split()
    n = max(0, len(words) - 1)
    fresh = len(set(zip(words[:-1], words[1:], strict=True))) if n else 0
    return fresh, n - fresh


def _counts(texts: pa.Array, chosen: list[bool] | None = None) -> np.ndarray:
    """Counts by bucket over texts, those chosen."""
    total = np.zeros(BUCKETS, np.int64)
    for k, text in enumerate(texts):
        if chosen is None or chosen[k]:
            raw = text.as_py()
            found = trigrams(raw)
            if len(found) > 2000:
                total[:TRIGRAMS] += np.bincount(found, minlength=TRIGRAMS)
            else:
                np.add.at(total, found, 1)
            total[TRIGRAMS:] += pairs(raw)
    return total


def _summed(rows: DataFrame, of_good: bool) -> np.ndarray:
    """Counts over rows (text) or the good ones of rows (text, quality): summed in each task, then by bucket; BUCKETS rows at most reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            total += _counts(batch.column(0), [q == 1 for q in batch.column(1).to_pylist()] if of_good else None)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.float64)
    for row in rows.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def log_shares(counts: np.ndarray) -> np.ndarray:
    """Log probabilities, trigrams and word pairs each summing to one, half a count added to each bucket."""
    parts = [x + 0.5 for x in (counts[:TRIGRAMS], counts[TRIGRAMS:])]
    return np.concatenate([np.log(x / x.sum()) for x in parts])


@dataclass
class Model:
    """Log ratio of target to raw by bucket, and the temperature that makes a text's mean ratio its log weight."""

    ratio: np.ndarray
    temperature: float = 0.0
    base: float = 0.0
    centre: np.ndarray = field(default_factory=lambda: np.zeros(2))
    fitted: bool = False

    def means(self, text: bytes | None) -> np.ndarray:
        """Mean log ratio of trigrams and of word pairs; the labelled sample's mean where there are none."""
        found, (fresh, repeated) = trigrams(text), pairs(text)
        first = float(self.ratio[found].mean()) if len(found) else self.centre[0]
        second = float((self.ratio[TRIGRAMS:] @ (fresh, repeated)) / (fresh + repeated)) if fresh + repeated else self.centre[1]
        return np.array((first, second))

    def weight(self, text: bytes | None) -> float:
        return float(self.base + self.temperature * (self.means(text) - self.centre).sum())


def regress(x: np.ndarray, good: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Slopes and base of a logistic regression by Newton's method; x has columns of mean 0."""
    spread = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    rows = np.column_stack((x / spread, np.ones(len(x))))
    w, penalty = np.zeros(rows.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(rows @ w)))
        step = np.linalg.solve(rows.T @ (rows * (p * (1 - p))[:, None]) + penalty, rows.T @ (good - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-10:
            break
    return w[:-1] / spread, float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> Model:
    """docs (doc_id, text), labels (doc_id, quality 0 or 1). Without good and bad labels nothing is told apart."""
    known = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(limit)
    chosen = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(known), "doc_id")  # `limit` rows of 12 bytes
    model = Model(log_shares(_summed(chosen.select("text", "quality"), True)) - log_shares(_summed(docs.select(F.col("text").cast("binary")), False)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([model.means(t.as_py()) for t in batch.column(1)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found[:, 0]), pa.array(found[:, 1])], ["doc_id", "quality", "a", "b"])

    scored = chosen.where(F.octet_length("text") > 0).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "quality").mapInArrow(score, "doc_id long, quality int, a double, b double")
    # Repeated documents count as one: `limit` rows at most.
    rows = sorted(map(tuple, scored.groupBy("doc_id", "quality").agg(F.min("a").alias("a"), F.min("b").alias("b")).collect()))
    good = np.array([r[1] for r in rows], np.float64)
    if 0 < good.sum() < len(rows):
        x = np.array([r[2:] for r in rows])
        model.centre = x.mean(axis=0)
        slope, model.base = regress((x - model.centre).sum(axis=1, keepdims=True), good)
        model.temperature = float(slope[0])
        model.fitted = True
    return model


def log_weight(model: Model) -> Column:
    @F.pandas_udf("double")
    def weights(texts: pd.Series) -> pd.Series:
        return pd.Series([model.weight(t) for t in texts], dtype="float64")

    return weights(F.col("text").cast("binary"))


def gumbel() -> Column:
    """Noise by doc_id, or by the text where there is none."""
    own = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.lit(SEED))).otherwise(F.xxhash64("text", F.lit(SEED)))
    u = (F.shiftrightunsigned(own, 11).cast("double") + 0.5) / float(2**53)
    return -F.log(-F.log(u))


def top_cut(keys: DataFrame, k: int) -> float | None:
    """The k-th largest key, exactly; None if all are taken. keys (key double).

    Bins of the range that holds it are counted and refined, so at most 1,024 rows reach the driver at a time.
    """
    if k <= 0:
        return float("inf")
    stats = keys.agg(F.count("key"), F.min("key"), F.max("key")).first()
    if k >= stats[0]:
        return None
    low, high, above = stats[1], stats[2], 0
    while True:
        inside = keys.where(F.col("key").between(low, high))
        if low == high:
            return low
        width = (high - low) / 1022
        slot = F.least(F.lit(1022), F.floor((F.col("key") - low) / width)) if width > 0 else F.lit(0)
        bins = inside.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).orderBy(F.desc("slot")).collect()
        for r in bins:
            if above + r["n"] >= k:
                if (r["a"], r["b"]) == (low, high):  # keys a last bit apart: the highest goes if it isn't the one
                    n_high = inside.where(F.col("key") == high).count()
                    if above + n_high >= k:
                        return high
                    above, high = above + n_high, inside.where(F.col("key") < high).agg(F.max("key")).first()[0]
                    break
                low, high = r["a"], r["b"]
                break
            above += r["n"]


def expected(scored: DataFrame) -> int:
    """The number of target documents that the weights expect; summed in millionths, so in any order alike."""
    share = F.sum((1_000_000 / (1 + F.exp(-F.col("log_weight")))).cast("long"))
    return round((scored.agg(share).first()[0] or 0) / 1_000_000)


def effective_size(scored: DataFrame) -> float:
    """Kish's effective sample size of the documents under their weights: how many equal ones would tell as much."""
    w = F.exp("log_weight")
    a, b = scored.agg(F.sum(w), F.sum(w * w)).first()
    return a * a / b if b else 0.0


def resample(docs: DataFrame, labels: DataFrame, limit: int = LABELLED, rate: float | None = None) -> tuple[Model, float | None, DataFrame]:
    """The model, the least key that is taken (None: all are), and (doc_id, log_weight, key) of all documents."""
    model = fit(docs, labels, limit)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), log_weight(model).alias("log_weight"), gumbel().alias("noise"))
    scored = materialize(scored.select("doc_id", "log_weight", (F.col("log_weight") + F.col("noise")).alias("key")), "weights")
    if not model.fitted and rate is None:
        return model, None, scored
    k = expected(scored) if rate is None else round(rate * scored.count())
    return model, top_cut(scored.select("key"), k), scored


def select_quality(docs: DataFrame, labels: DataFrame, limit: int = LABELLED, rate: float | None = None) -> DataFrame:
    """(doc_id, log_weight, key) of the documents that are kept. rate: the share to keep; by default what the weights expect.

    A null or empty text has the weight of the average labelled document and is kept or not by its noise; the noise of
    a row without doc_id comes from its text. Equal keys at the cut are all kept, so repeated rows stay or go together.
    Labels that are null, of other values or of other documents are ignored; without both good and bad ones, all
    documents are kept. An empty table gives an empty result. Other columns are ignored.
    """
    _, cut, scored = resample(docs.select("doc_id", "text"), labels, limit, rate)
    return scored if cut is None else scored.where(F.col("key") >= cut)


def keep_quality(docs: DataFrame, labels: DataFrame, limit: int = LABELLED, rate: float | None = None) -> DataFrame:
    """The documents that are kept, with all columns of docs; they are scored again, which spares a join of whole texts."""
    model, cut, _ = resample(docs.select("doc_id", "text"), labels, limit, rate)
    if cut is None:
        return docs
    row = docs.select("doc_id", "text", F.struct("*").alias("row")).where(log_weight(model) + gumbel() >= cut)
    return row.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
