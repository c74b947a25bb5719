"""SimHash near-dedup with covering locality-sensitive hashing.

Every document gets a 64-bit fingerprint. For a radius r there are 2^(r+1) - 1 bit masks. Bit i has a non-zero
vector of r+1 bits, and mask v holds the bits whose vector has an odd product with v. Whatever r bits two
fingerprints differ in, some v is orthogonal to all of their vectors, so the two agree under mask v: no pair
within the radius is missed.

Equal fingerprints are folded before the tables are filled. Buckets of more than HOT fingerprints get a second
set of masks on the bits that the first left out, after which a bucket agrees on so many bits that it can't hold
more than about 2^15 different fingerprints, whatever the input. Inside a bucket only the links of a spanning
forest are emitted, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundloom.llm.graph import components
from fundloom.llm.shared import materialize

BITS = 64
HOT = 1024


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of the word shingles; A-Z lower-cased; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[a:b], 42) for a, b in spans], dtype="<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long): one row per document; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """Masks over the given bit positions; any two words that differ in radius of these bits or fewer agree under one."""
    n = 2 ** (radius + 1) - 1
    return [sum(1 << b for k, b in enumerate(bits) if bin((k % n + 1) & v).count("1") % 2) for v in range(1, n + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def spanning_links(segment: np.ndarray, fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Positions (i, j) of a spanning forest of the pairs within the radius; segment: the bucket of each row, rows of one together."""
    n = len(fp)
    first = np.concatenate(([True], segment[1:] != segment[:-1]))
    start = np.flatnonzero(first)
    left = np.repeat(np.append(start[1:], n), np.diff(np.append(start, n))) - np.arange(n)  # rows of the bucket from here on
    parent, out, lag = np.arange(n), [], 1

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    live = np.flatnonzero(left > 1)
    while live.size:
        other = live + lag
        near = (np.bitwise_count(fp[live] ^ fp[other]) <= radius) & (parent[live] != parent[other])
        for i, j in zip(live[near].tolist(), other[near].tolist(), strict=True):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, j))
        if near.any():
            while (parent != (up := parent[parent])).any():
                parent = up
        lag += 1
        live = live[left[live] > lag]
    return out


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (mask, bucket, fp, rep) sorted by mask and bucket -> links between reps. Holds one Arrow batch and one bucket."""

    def done(rows: list[np.ndarray]) -> pa.RecordBatch:
        mask, bucket, fp, rep = rows
        change = np.concatenate(([True], (mask[1:] != mask[:-1]) | (bucket[1:] != bucket[:-1])))
        found = np.array(spanning_links(np.cumsum(change), fp.view(np.uint64), radius), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(rep[found[:, 0]]), pa.array(rep[found[:, 1]])], ["a", "b"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        if not len(held[0]):
            continue
        last = len(held[0]) - int(np.argmax(((held[0] != held[0][-1]) | (held[1] != held[1][-1]))[::-1]))
        if last == len(held[0]) and (held[0][0] == held[0][-1] and held[1][0] == held[1][-1]):
            continue  # a single bucket so far
        yield done([x[:last] for x in held])
        held = [x[last:] for x in held]
    if held is not None and len(held[0]):
        yield done(held)


def near_links(prints: DataFrame, radius: int = 3, hot: int = HOT) -> DataFrame:
    """prints (fp, rep): different fingerprints. Returns links (a, b) between reps; enough of them for all components."""
    masks = covering_masks(list(range(BITS)), radius)
    keyed = lambda df, at: df.select(*at, "fp", "rep")
    rows = keyed(
        prints.where("rep is not null").select("fp", "rep", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("mask", "bucket")),
        ["mask", "bucket"],
    )
    large = materialize(rows.groupBy("mask", "bucket").count().where(F.col("count") > hot).select("mask", "bucket"), "hot")
    if large.count():
        parts = []
        for k, m in enumerate(masks):
            finer = [m | x for x in covering_masks([b for b in range(BITS) if not m >> b & 1], radius)]
            parts.append(F.when(F.col("mask") == k, F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(x))) for x in finer])))
        fine = rows.join(large, ["mask", "bucket"], "left_semi").select("fp", "rep", "mask", F.posexplode(F.coalesce(*parts)).alias("sub", "bucket"))
        rows = rows.join(large, ["mask", "bucket"], "left_anti").unionByName(
            keyed(fine.select(((F.col("mask") + 1) * len(masks) + F.col("sub")).cast("int").alias("mask"), "bucket", "fp", "rep"), ["mask", "bucket"])
        )
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.repartition(n, "mask", "bucket").sortWithinPartitions("mask", "bucket", "fp").mapInArrow(lambda it: _links(it, radius), "a long, b long").distinct()
    )


def near_dedup(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) per document of docs (doc_id, text, ...).

    Nulls: a null or blank text has fingerprint zero and is linked like any other; a row without doc_id gets the
    component of its fingerprint, null if no document with an id has that fingerprint. Repeated rows come out
    repeated. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    marked = materialize(fingerprints(docs, shingle), "simhash")
    prints = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "prints")
    groups = components(near_links(prints, radius))
    known = prints.join(groups, prints.rep == groups.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
