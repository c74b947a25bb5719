"""Near copies by SimHash and the Jaccard similarity of word shingles: the sets themselves decide.

A text's different shingles are hashed to 64 bits; texts with the same set are folded. Candidates are what the covering
masks of `simhash` find, equal fingerprints and those within the radius, all of them. At a similarity of 0.8 fingerprints
differ in about ten bits, for which covering masks would take thousands of tables; so MinHash bands complete the
candidates: of each set BANDS x ROWS minima are taken, ROWS of them make a bucket. Two sets of similarity s share no
bucket with probability (1 - s^ROWS)^BANDS: 7 in 100,000 at 0.8, one in a billion at 0.9. Buckets with the same members
count once. The sets of a bucket are brought together, and a search from set to set emits the links of a spanning forest
of the pairs whose exact similarity reaches the least; a link is never taken from a candidate alone.

No bucket is capped. Those of more than CROWD sets or CROWD_HASHES hashes, large groups of copies or long texts as a
rule, are first compared with one of their sets, row by row. What is similar to it is linked and done among itself; the
rest is compared with itself and with the linked ones, in pairs of blocks of about BLOCK sets or BLOCK_HASHES hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundloom.llm.graph import components
from fundloom.llm.shared import attach, materialize
from fundloom.llm.simhash import near_links

SHINGLE, LEAST = 5, 0.8
ROWS, BANDS = 5, 24
#: Shingles that are put through all hash functions at a time.
AT_ONCE = 2048
#: Shingles of a text whose places are held as Python's numbers at a time.
SPANS = 1 << 15
#: Sets and hashes beyond which a bucket is crowded, and those in a block of its rest: a task holds a bucket's sets together.
CROWD, BLOCK = 2_000, 1_000
CROWD_HASHES, BLOCK_HASHES = 1 << 21, 1 << 20


def _mixed(first: int, n: int) -> np.ndarray:
    """n well-mixed 64-bit values (splitmix64 of first, first + 1, ...)."""
    z = np.arange(first, first + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


XOR, TIMES = _mixed(1, ROWS * BANDS)[:, None], _mixed(1001, ROWS * BANDS)[:, None] | np.uint64(1)


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the different word shingles; A-Z lower-cased; a text of fewer words is one shingle."""
    joined = b" ".join((text or b"").lower().split())
    if not joined:
        return np.zeros(0, np.uint64)
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == ord(" ")), len(joined))
    starts, size = np.concatenate(([0], ends[:-1] + 1)), min(shingle, len(ends))
    starts, ends, digest = starts[: len(ends) - size + 1], ends[size - 1 :], xxhash.xxh3_64_intdigest
    out = np.empty(len(starts), np.uint64)
    for k in range(0, len(starts), SPANS):
        out[k : k + SPANS] = [digest(joined[a:b]) for a, b in zip(starts[k : k + SPANS].tolist(), ends[k : k + SPANS].tolist(), strict=True)]
    return np.unique(out)


def _key(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes())


def buckets(hashes: np.ndarray) -> np.ndarray:
    """One number per band; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    least = np.full(ROWS * BANDS, 2**64 - 1, np.uint64)
    for k in range(0, len(hashes), AT_ONCE):
        np.minimum(least, ((hashes[k : k + AT_ONCE] ^ XOR) * TIMES).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(row.tobytes(), k) for k, row in enumerate(rows)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set of shingle hashes."""
    ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def similar_links(sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """Positions (i, j) of a spanning forest of the pairs of sets whose Jaccard similarity is least or more."""
    out, open_ = [], np.arange(len(sets))
    size = np.array([len(s) for s in sets])
    values, token = np.unique(np.concatenate(sets), return_inverse=True)
    token, ends = token.astype(np.int32), np.cumsum(size)
    owner, starts = np.repeat(np.arange(len(sets), dtype=np.int32), size), ends - size
    unseen = np.ones(len(sets), bool)

    def postings() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        live = unseen[owner]
        order = np.argsort(token[live], kind="stable")
        count = np.bincount(token[live], minlength=len(values))
        return owner[live][order], np.cumsum(count) - count, count

    posted, begin, count = postings()
    when_built = len(sets)
    while open_.size:
        queue = [int(open_[0])]
        unseen[queue[0]] = False
        while queue and unseen.any():
            if 2 * unseen.sum() < when_built:  # only the sets that are still to be found are looked up
                posted, begin, count = postings()
                when_built = int(unseen.sum())
            i = queue.pop()
            mine = token[starts[i] : ends[i]]
            n = count[mine]
            at = np.repeat(begin[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common = np.bincount(posted[at], minlength=len(sets))
            near = np.flatnonzero(unseen & (common > 0) & (common / (size[i] + size - common) >= least))
            unseen[near] = False
            out += [(i, j) for j in near.tolist()]
            queue += near.tolist()
        open_ = np.flatnonzero(unseen)
    return out


def _signed(values: np.ndarray) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)


def _marks(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, prints, lists = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64), []
        for k, text in enumerate(batch.column(1)):
            found = shingles(text.as_py(), shingle)
            keys[k], prints[k] = _key(found), fingerprint(found)
            lists.append(_signed(buckets(found)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_signed(keys)), pa.array(_signed(prints)), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "key", "fp", "buckets"])


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, whole.num_rows, 500):
            found = [shingles(text.as_py(), shingle) for text in whole.column(0).slice(k, 500)]
            keys = np.array([_key(s) for s in found], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(keys)), pa.array([len(s) for s in found], pa.int32()), pa.array([s.tobytes() for s in found], pa.binary())], ["key", "size", "hashes"])


def _links(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, key, hashes) with a bucket's together -> links between keys. Holds one Arrow batch and one bucket."""
    bucket, keys, sets = None, [], []

    def done() -> list[tuple[int, int]]:
        return [(keys[i], keys[j]) for i, j in similar_links(sets, least)] if len(sets) > 1 else []

    def table(rows: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        rows = []
        for b, key, hashes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if b != bucket:
                rows += done()
                bucket, keys, sets = b, [], []
            keys.append(key)
            sets.append(np.frombuffer(hashes.as_py(), np.uint64))
        yield table(rows)
    yield table(done())


def _beside(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, key, hashes, first, first_hashes) -> (bucket, key, first, size, near): whether the set is similar to the first one."""
    for batch in batches:
        near, size = [], []
        for a, b in zip(batch.column(2), batch.column(4), strict=True):
            a, b = (np.frombuffer(x.as_py(), np.uint64) for x in (a, b))
            common = len(np.intersect1d(a, b, assume_unique=True))
            near.append(common > 0 and common / (len(a) + len(b) - common) >= least)
            size.append(len(a))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(size, pa.int32()), pa.array(near, pa.bool_())], ["bucket", "key", "first", "size", "near"])


def _uncrowded(members: DataFrame, sets: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """members (bucket, key), crowded ones with links to their first set and dealt anew: (members, links). Members are as they are if none is crowded."""
    weighed = attach(members, sets.select("key", "size"), ["key"])
    sizes = weighed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("hashes"), F.min("key").alias("first"))
    sizes = materialize(sizes.where((F.col("n") > CROWD) | (F.col("hashes") > CROWD_HASHES)), "crowded")
    none = members.sparkSession.createDataFrame([], "a long, b long")
    if sizes.isEmpty():
        return members, none
    firsts = materialize(sizes.select("bucket", "first").join(sets.select(F.col("key").alias("first"), F.col("hashes").alias("first_hashes")), "first"), "firsts")
    crowd = attach(attach(members, firsts, ["bucket"]).where("key <> first"), sets, ["key"]).select("bucket", "key", "hashes", "first", "first_hashes")
    told = materialize(crowd.mapInArrow(lambda it: _beside(it, least), "bucket long, key long, first long, size int, near boolean"), "told")
    links = told.where("near").select(F.col("first").alias("a"), F.col("key").alias("b"))
    blocks = lambda which: F.ceil(F.greatest(F.count_if(which) / BLOCK, F.coalesce(F.sum(F.when(which, F.col("size"))), F.lit(0)) / BLOCK_HASHES)).cast("int")
    counts = told.groupBy("bucket").agg(blocks(F.col("near")).alias("near_blocks"), blocks(~F.col("near")).alias("rest_blocks")).where("rest_blocks > 0")
    dealt = attach(told, materialize(counts, "blocks"), ["bucket"])
    block = lambda n: F.pmod(F.xxhash64("key"), F.greatest(F.col(n), F.lit(1))).cast("int")
    to = lambda a, b: F.xxhash64(F.lit("blocks"), "bucket", a, b)
    every = lambda n: F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1)
    # A block of linked sets meets each block of the rest; blocks of the rest meet each other and themselves.
    near = dealt.where("near").select("key", F.explode(F.transform(every("rest_blocks"), lambda j: to(-1 - block("near_blocks"), j))).alias("bucket"))
    own = block("rest_blocks")
    rest = dealt.where("not near").select(
        "key",
        F.explode(F.concat(F.transform(every("rest_blocks"), lambda j: to(F.least(own, j), F.greatest(own, j))), F.when(F.col("near_blocks") > 0, F.transform(every("near_blocks"), lambda i: to(-1 - i, own))).otherwise(F.array().cast("array<bigint>")))).alias("bucket"),
    )
    plain = members.join(sizes.select("bucket"), "bucket", "left_anti").select("bucket", "key")
    return materialize(plain.unionByName(near).unionByName(rest).distinct(), "members"), links


def near_copies(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST, radius: int = 3) -> DataFrame:
    """(doc_id, component_id) of docs (doc_id, text, ...): the least doc_id that similar pairs lead to from the document.

    Nulls: null and blank texts have the empty set and are copies of each other; rows without doc_id are left out.
    Repeated rows come out repeated. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).where("doc_id is not null")
    marked = materialize(rows.mapInArrow(lambda it: _marks(it, shingle), "doc_id long, key long, fp long, buckets array<long>"), "minhash")
    keys = materialize(marked.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp"), F.first("buckets").alias("buckets")), "keys")
    # SimHash: the sets of one fingerprint are a bucket, and so are the first sets of each pair within the radius.
    prints = materialize(keys.where(F.size("buckets") > 0).groupBy("fp").agg(F.min("key").alias("rep"), F.count("*").alias("n")), "prints")
    pairs = materialize(near_links(prints.select("fp", "rep"), radius), "pairs")
    alike = keys.join(prints.where("n > 1").select("fp"), "fp", "left_semi").select("key", F.xxhash64(F.lit("print"), "fp").alias("bucket"))
    paired = pairs.select(F.explode(F.array("a", "b")).alias("key"), F.xxhash64(F.lit("pair"), "a", "b").alias("bucket"))
    held = keys.select("key", F.explode("buckets").alias("bucket")).unionByName(alike).unionByName(paired)
    shared = held.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.min("key").alias("least"), F.max("key").alias("most")).where("n > 1")
    once = materialize(shared.groupBy("n", "x", "least", "most").agg(F.min("bucket").alias("bucket")).select("bucket"), "buckets")
    members = materialize(attach(held, once, ["bucket"], "left_semi").select("bucket", "key"), "members")
    wanted = materialize(keys.join(members.select("key").distinct(), "key", "left_semi").select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    sets = materialize(attach(rows, wanted, ["doc_id"], "left_semi").select("text").mapInArrow(lambda it: _sets(it, shingle), "key long, size int, hashes binary").dropDuplicates(["key"]), "sets")
    members, links = _uncrowded(members, sets, least)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    brought = members.join(sets, "key").select("bucket", "key", "hashes").repartition(n, "bucket").sortWithinPartitions("bucket")
    found = brought.mapInArrow(lambda it: _links(it, least), "a long, b long").unionByName(links)
    groups = components(materialize(found.distinct(), "similar"))
    known = keys.select("key", "rep").join(groups, keys.key == groups.node, "left").select("key", "rep", F.coalesce("component", "key").alias("group"))
    first = known.groupBy("group").agg(F.min("rep").alias("component_id"))
    return marked.select("doc_id", "key").join(known.join(first, "group").select("key", "component_id"), "key").select("doc_id", "component_id")
