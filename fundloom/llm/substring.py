"""Substring dedup with difference-cover anchors.

A word is removed if a window of `window` words over it also starts in a document with a smaller doc_id. Anchors
are shorter runs of words, hashed only at the positions whose index modulo a period is in a difference cover: for
any two positions there is a shift below the period that puts both into the cover. With anchors of
window - period + 1 words, two equal windows therefore share an anchor at the same shift, wherever they start.
So windows are hashed (96 bits) only where an anchor occurs in two documents, and the least doc_id of each window
decides. Exact copies are settled before by their hashes, so that large groups of copies cost one document.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundloom.llm.shared import attach, materialize

WINDOW = 50
#: A perfect difference set modulo 31.
SINGER_31 = (1, 5, 11, 24, 25, 27)
#: Stands for a missing doc_id: behind all others.
LAST = 2**63 - 1


def cover(window: int) -> tuple[int, tuple[int, ...]]:
    """Period and cover: anchors of window - period + 1 words at these positions modulo the period."""
    if window >= 50:
        return 31, SINGER_31
    period = max(1, window // 2)
    step = math.isqrt(period - 1) + 1
    return period, tuple(sorted({*range(step), *(k * step % period for k in range(-(-period // step) + 1))}))


def _spans(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by single spaces, and where each starts and ends."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    return b" ".join(words), np.concatenate(([0], ends[:-1] + 1))[: len(words)], ends


def anchors(text: bytes | None, window: int = WINDOW) -> tuple[np.ndarray, list[int]]:
    """Positions and hashes of the anchors of a text."""
    words = (text or b"").split()
    if len(words) < window:
        return np.zeros(0, np.int64), []
    period, residues = cover(window)
    size = window - period + 1
    at = np.arange(len(words) - size + 1)
    at = at[np.isin(at % period, residues)]
    joined, starts, ends = _spans(words)
    digest = xxhash.xxh3_64_intdigest
    return at, [digest(joined[a:b]) for a, b in zip(starts[at].tolist(), ends[at + size - 1].tolist(), strict=True)]


def runs(places: str, gap: int) -> Column:
    """begin and end: the first and the last place of each run of an array's numbers; a step of more than gap ends a run."""

    def ends(order: Column) -> Column:
        back = F.filter(order, lambda x, i: (i == 0) | (x - F.get(order, i - 1) > gap))
        ahead = F.filter(order, lambda x, i: F.coalesce(F.get(order, i + 1) - x > gap, F.lit(True)))
        return F.struct(back.alias("begin"), ahead.alias("end"))

    return F.transform(F.array(F.array_sort(places)), ends)[0]  # binds the sorted array once


def _flags(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """n flags, set from begin to before end of each pair."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.clip(begin, 0, n), 1)
    np.add.at(edge, np.clip(end, 0, n), -1)
    return np.cumsum(edge)[:n] > 0


def window_starts(begin: np.ndarray, end: np.ndarray, n_words: int, window: int = WINDOW) -> np.ndarray:
    """Starts of the windows that hold an anchor of one of the runs of shared anchors."""
    period, _ = cover(window)
    return np.flatnonzero(_flags(begin - period + 1, end + 1, max(0, n_words - window + 1)))


def window_hashes(text: bytes, starts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    joined, begin, end = _spans(text.split())
    digest = xxhash.xxh3_128_digest
    raw = b"".join([digest(joined[a:b]) for a, b in zip(begin[starts].tolist(), end[starts + window - 1].tolist(), strict=True)])
    pairs = np.frombuffer(raw, "<i8").reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1].astype(np.int32)


def removed_words(begin: np.ndarray, end: np.ndarray, n_words: int, window: int = WINDOW) -> np.ndarray:
    """A flag per word: covered by a window that starts in one of the runs."""
    return _flags(begin, end + window, n_words)


def kept_text(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the flagged words; white space inside a kept run stays, runs are joined by one space."""
    out, at, start, end = [], 0, None, 0
    for word, drop in zip(text.split(), gone.tolist(), strict=True):
        at = text.index(word, at)
        if drop:
            if start is not None:
                out.append(text[start:end])
            start = None
        else:
            start = at if start is None else start
        at = end = at + len(word)
    if start is not None:
        out.append(text[start:end])
    return b" ".join(out)


def _keyed(docs: DataFrame) -> DataFrame:
    """did, h1, h2: the id and two hashes of the text, which together stand for a row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"), F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(7)).alias("h2"))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, sha = [], []
        for text in batch.column(3).to_pylist():
            words = (text or b"").split()
            n.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["did", "h1", "h2", "n_words", "sha"])


def _anchor_rows(window: int, places: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                found = [anchors(t, window) for t in batch.column(2).to_pylist()]
                sizes = [len(h) for _, h in found]
                row = np.repeat(np.arange(batch.num_rows), sizes)
                hashes = np.array([x for _, h in found for x in h], np.uint64).view(np.int64)
                columns = {"anchor": pa.array(hashes), "did": batch.column(0).take(pa.array(row))}
                if places:
                    columns |= {"h1": batch.column(1).take(pa.array(row)), "at": pa.array(np.concatenate([at for at, _ in found]).astype(np.int32) if found else np.zeros(0, np.int32))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _window_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 200):
                batch = whole.slice(k, 200)
                hi, lo, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
                sizes = []
                for text, begin, end in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                    starts = window_starts(np.array(begin, np.int64), np.array(end, np.int64), len(text.split()), window)
                    a, b = window_hashes(text, starts, window)
                    hi.append(a), lo.append(b), at.append(starts.astype(np.int32)), sizes.append(len(starts))
                row = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(hi)), pa.array(np.concatenate(lo)), batch.column(0).take(row), batch.column(1).take(row), pa.array(np.concatenate(at))],
                    ["hi", "lo", "did", "h1", "at"],
                )

    return run


def find_repeats(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """What goes: (did, h1, h2) of the exact copies of at least `window` words, and (did, h1, begin, end) of other documents: runs of window starts."""
    keyed = _keyed(docs.select("doc_id", "text"))
    first = keyed.groupBy("h1", "h2").agg(F.min("did").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = materialize(first, "first")  # written, so that both sides of the join are plain exchanges that AQE can split
    copies = materialize(keyed.select("did", "h1", "h2").join(first, ["h1", "h2"]).where("did > first").select("did", "h1", "h2").distinct(), "copies")
    texts = attach(keyed, copies, ["did", "h1", "h2"], "left_anti").select("did", "h1", F.col("text").cast("binary").alias("text"))
    once = texts.mapInArrow(_anchor_rows(window, False), "anchor long, did long")
    shared = once.groupBy("anchor").agg(F.min("did").alias("a"), F.max("did").alias("b")).where("a < b").select("anchor")
    shared = materialize(shared, "anchors")
    hit = texts.mapInArrow(_anchor_rows(window, True), "anchor long, did long, h1 long, at int").join(shared, "anchor", "left_semi")
    hit = materialize(hit.groupBy("did", "h1").agg(F.collect_set("at").alias("at")).select("did", "h1", runs("at", cover(window)[0]).alias("runs")).select("did", "h1", "runs.*"), "hits")
    windows = materialize(attach(texts, hit, ["did", "h1"]).select("did", "h1", "text", "begin", "end").mapInArrow(_window_rows(window), "hi long, lo int, did long, h1 long, at int"), "windows")
    least = windows.groupBy("hi", "lo").agg(F.min("did").alias("first"), F.max("did").alias("last")).where("first < last").drop("last")
    least = materialize(least, "least")
    gone = windows.join(least, ["hi", "lo"]).where("did > first").groupBy("did", "h1").agg(F.collect_set("at").alias("at"))
    return copies, materialize(gone.select("did", "h1", runs("at", window).alias("runs")).select("did", "h1", "runs.*"), "gone")


def span_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per document of docs (doc_id, text, ...).

    A null text has no words. A row without doc_id stands behind all ids and takes words from nobody but loses
    those that documents with ids have; rows of one id take nothing from each other. Repeated rows come out
    repeated. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    keyed = _keyed(docs.select("doc_id", "text"))
    plain = materialize(
        keyed.select("did", "h1", "h2", F.col("text").cast("binary").alias("text")).mapInArrow(_measure, "did long, h1 long, h2 long, n_words long, sha string"), "words"
    )
    copies, gone = find_repeats(docs, window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha = [], []
            for text, begin, end in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                words = text.split()
                drop = removed_words(np.array(begin, np.int64), np.array(end, np.int64), len(words), window)
                n.append(int(drop.sum()))
                sha.append(hashlib.sha256(b" ".join([w for w, d in zip(words, drop.tolist(), strict=True) if not d])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["did", "h1", "cut_n", "cut_sha"])

    some = attach(keyed, gone, ["did", "h1"]).select("did", "h1", F.col("text").cast("binary").alias("text"), "begin", "end")
    some = some.mapInArrow(cut, "did long, h1 long, cut_n long, cut_sha string").distinct()
    nothing = hashlib.sha256(b"").hexdigest()
    whole = F.col("copy").isNotNull() & (F.col("n_words") >= window)
    return (
        plain.join(some, ["did", "h1"], "left")
        .join(copies.withColumn("copy", F.lit(1)), ["did", "h1", "h2"], "left")
        .select(
            F.when(F.col("did") != LAST, F.col("did")).alias("doc_id"),
            "n_words",
            F.when(whole, F.col("n_words")).otherwise(F.coalesce("cut_n", F.lit(0))).alias("n_removed"),
            F.when(whole, F.lit(nothing)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        )
    )


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (all columns) with the repeated words taken out of text, n_chars (if there) of the new text; emptied documents go."""
    names = docs.columns
    copies, gone = find_repeats(docs, window)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.Series:
        out = texts.copy()
        for k, (text, begin, end) in enumerate(zip(texts, begins, ends, strict=True)):
            if begin is not None and text is not None:
                raw = text.encode()
                out.iat[k] = kept_text(raw, removed_words(np.array(begin, np.int64), np.array(end, np.int64), len(raw.split()), window)).decode()
        return out

    cut = cut.asNondeterministic()  # else the filter below would have it run a second time

    packed = docs.select("doc_id", "text", F.struct("*").alias("row"))  # other columns may have any names
    rest = attach(_keyed(packed), copies, ["did", "h1", "h2"], "left_anti")
    # Copies of fewer words than a window lose nothing.
    short = attach(_keyed(packed), copies, ["did", "h1", "h2"], "left_semi").where(F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) < window)
    marked = attach(rest, gone, ["did", "h1"], "left")
    marked = marked.withColumn("new", cut(F.when(F.col("begin").isNotNull(), F.col("text")), "begin", "end")).where("begin is null or new <> ''")
    fresh = F.col("row").withField("text", F.col("new"))
    if "n_chars" in names:
        fresh = fresh.withField("n_chars", F.length("new").cast(docs.schema["n_chars"].dataType))
    marked = marked.select(F.when(F.col("begin").isNotNull(), fresh).otherwise(F.col("row")).alias("row"))
    return marked.unionByName(short.select("row")).select(*[F.col("row").getField(c).alias(c) for c in names])
