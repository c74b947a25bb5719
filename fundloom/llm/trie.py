"""Conversation prefix trie by a splitter skeleton.

A conversation is the path of its turns' digests. The paths are range-partitioned and sorted, so that each shard holds
neighbouring paths, and all conversations below a node stand side by side. Only prefixes of the splitters between
shards have members in several: the skeleton. Of each splitter's path what counts is how far the shards on its two
sides agree with it, a number for each side, which is broadcast. A shard finishes all other nodes by itself, as it
reads its paths once and keeps the open ones on a stack; of a skeleton node it tells its share, and the shares are
added up. A node is counted by the first shard that has it, and is a leaf if the last one has nothing below it, so
that the shares of all sums are simply added.

What is saved below a node is the words of all its members' turns from it on, less those of the nodes themselves:
both can be added up shard by shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundloom.llm.shared import attach, materialize

WORDS = r"[^\x20\x09-\x0D]+"
#: Bytes of a turn's digest, conversations that share beginnings, turns of a beginning at most plus one, ids of members in a row.
DIGEST, FAMILY, HEAD, IDS = 16, 20, 4, 4000


def paths(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) -> (conv_id, path binary, words array<int>): each conversation's turns by turn (none first), role and text, as digests of 16 bytes, and their words."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    turns = rows.select("conv_id", F.row_number().over(order).alias("nth"), digest.alias("digest"), F.regexp_count("text", F.lit(WORDS)).alias("words"))
    held = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("nth", "digest", "words"))).alias("t"))
    return held.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda x: x["digest"]), "")).alias("path"), F.transform("t", lambda x: x["words"]).alias("words"))


def rebuilt(own: DataFrame) -> DataFrame:
    """own (conv_id, path, words), each with the first turns of the conversation that begins its family in place of its own: as many as the crc32 of its id leaves when divided by HEAD."""
    heads = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.substring("path", 1, (HEAD - 1) * DIGEST).alias("head"), F.slice("words", 1, HEAD - 1).alias("head_words"))
    n = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("n", n).join(heads, "base", "left")
    begin = F.coalesce(F.expr(f"substring(head, 1, n * {DIGEST})"), F.unhex(F.lit("")))
    counts = F.coalesce(F.expr("slice(head_words, 1, n)"), F.array().cast("array<int>"))
    return both.select("conv_id", F.concat(begin, F.expr(f"substring(path, n * {DIGEST} + 1)")).alias("path"), F.concat(counts, F.expr("slice(words, n + 1, greatest(size(words) - n, 0))")).alias("words"))


def agreement(a: bytes, b: bytes) -> int:
    """How many turns two paths begin with alike."""
    n = min(len(a), len(b)) // DIGEST * DIGEST
    if a[:n] == b[:n]:
        return n // DIGEST
    low, high = 0, n // DIGEST  # the first `low` turns agree, not all of `high`
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[: mid * DIGEST] == b[: mid * DIGEST] else (low, mid)
    return low


@dataclass
class Node:
    """An open node: what is known of it in its shard. own: no shard before has it; first: the shard's first path leads through it."""

    words: int
    own: bool
    first: bool
    least: int | None = None
    members: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    grown: bool = False
    ends: list[int] = field(default_factory=list)
    waiting: list[tuple] = field(default_factory=list)


#: A finished node; one whose parent is in the skeleton, with the parent's key; a share of a skeleton node; some of its ends.
WHOLE, CHILD, SHARE, ENDS = range(4)
NAMES = ["kind", "key", "parent", "shard", "part", "ids", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
KINDS = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 7, pa.string()]
OUT = ", ".join(f"{n} {'int' if k == pa.int32() else 'string' if k == pa.string() else 'long'}" for n, k in zip(NAMES, KINDS, strict=True))


class Shard:
    """Reads the paths of a shard in order and tells of their nodes.

    left, right: how many turns its first path has in common with the last of the shard before, and its last one with
    the first of the shard behind; -1 where there is none.
    """

    def __init__(self, shard: int, left: int, right: int) -> None:
        self.shard, self.left, self.right = shard, left, right
        self.stack = [Node(0, left < 0, True)]
        self.last: bytes | None = None
        self.part, self.out = 0, []

    def key(self, depth: int) -> str:
        return f"{hashlib.md5(self.last[: depth * DIGEST]).hexdigest()}-{depth}"

    def read(self, conv_id: int, path: bytes, words: list[int]) -> None:
        first = self.last is None
        if not first:
            self.close(agreement(self.last, path), False)
        for depth in range(len(self.stack), len(path) // DIGEST + 1):
            self.stack[-1].grown = True
            self.stack.append(Node(words[depth - 1], not first or depth > self.left, first))
        self.last = path
        self.stack[-1].ends.append(conv_id)

    def shared(self, depth: int, node: Node, at_end: bool) -> bool:
        """Whether the node is in the skeleton."""
        return depth == 0 or (node.first and depth <= self.left) or (at_end and depth <= self.right)

    def close(self, upto: int, at_end: bool) -> None:
        """Closes the nodes deeper than upto; at_end: behind the shard's last path."""
        while len(self.stack) - 1 > upto:
            depth, node = len(self.stack) - 1, self.stack.pop()
            node.members += len(node.ends)
            node.least = min([node.least, *node.ends[:1]] if node.least is not None else node.ends[:1])  # ends ascend
            node.saved += node.words * (node.members - node.own)
            if not node.grown and not (at_end and depth <= self.right):
                node.leaves += 1
            above = self.stack[-1] if self.stack else None
            if above:
                above.members += node.members
                above.least = node.least if above.least is None else min(above.least, node.least)
                above.leaves, above.saved, above.children = above.leaves + node.leaves, above.saved + node.saved, above.children + node.own
            own = (node.least, depth, node.members, node.children, node.leaves, node.saved)
            if self.shared(depth, node, at_end):
                mine = self.key(depth)
                self.out += [self.row(CHILD, child, parent=mine) for child in node.waiting]
                self.out.append(self.row(SHARE, (*own, None), key=mine, parent=self.key(depth - 1) if depth else None))
                for k in range(0, len(node.ends), IDS):
                    self.out.append((ENDS, mine, None, self.shard, self.part, ",".join(map(str, node.ends[k : k + IDS])), *[None] * 8))
                    self.part += 1
                continue
            self.out += [self.row(WHOLE, child, above=node.least) for child in node.waiting]
            own = (*own, hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest())
            if depth == 1 or (above.first and depth - 1 <= self.left):  # the parent is known to be in the skeleton
                self.out.append(self.row(CHILD, own, parent=self.key(depth - 1)))
            else:
                above.waiting.append(own)

    @staticmethod
    def row(kind: int, own: tuple, key: str | None = None, parent: str | None = None, above: int | None = None) -> tuple:
        return (kind, key, parent, None, None, None, *own[:2], above, *own[2:])


def shard_nodes(batches: Iterator[pa.RecordBatch], bounds: dict[int, tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """What shards (shard, conv_id, path, words), each in the order of path and conv_id, tell of their nodes."""

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)

    now: Shard | None = None
    for batch in batches:
        for shard, conv_id, path, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.shard != shard:
                if now:
                    now.close(-1, True)
                    yield told(now.out)
                now = Shard(shard, *bounds[shard])
            now.read(conv_id, path, words)
            if len(now.out) >= 4000:
                yield told(now.out)
                now.out = []
    if now:
        now.close(-1, True)
        yield told(now.out)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's ends (key, shard, part, ids), which follow each other."""
    key, sha = None, None
    for batch in batches:
        for own, ids in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if own != key:
                if sha:
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([sha.hexdigest()])], ["key", "sha"])
                key, sha = own, hashlib.sha256(ids.encode())
            else:
                sha.update(f",{ids}".encode())
    if sha:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([sha.hexdigest()])], ["key", "sha"])


def nodes(paths: DataFrame) -> DataFrame:
    """paths (conv_id, path, words) -> a row per node of their trie; see prefix_trie for the columns."""
    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(paths.repartitionByRange(n, "path", "conv_id").select(F.spark_partition_id().alias("shard"), "conv_id", "path", "words"), "shards")

    @F.pandas_udf("int")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([-1 if x is None or y is None else agreement(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")

    ends = ranged.groupBy("shard").agg(F.min(F.struct("path", "conv_id"))["path"].alias("first"), F.max(F.struct("path", "conv_id"))["path"].alias("last"))
    order = Window.orderBy("shard")  # a row per shard
    splitters = ends.select("shard", "first", "last", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("behind"))
    skeleton = splitters.select("shard", alike("before", "first").alias("left"), alike("last", "behind").alias("right")).collect()  # three numbers per shard
    bounds = {r["shard"]: (r["left"], r["right"]) for r in skeleton}
    sorted_shards = ranged.repartition("shard").sortWithinPartitions("shard", "path", "conv_id")
    told = materialize(sorted_shards.mapInArrow(lambda batches: shard_nodes(batches, bounds), OUT), "nodes")

    facts = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    shares = told.where(F.col("kind") == SHARE).groupBy("key", "parent", "depth").agg(F.min("conv_id").alias("conv_id"), *[F.sum(f).alias(f) for f in facts])
    parts = told.where(F.col("kind") == ENDS).select("key", "shard", "part", "ids")
    hashes = parts.repartition("key").sortWithinPartitions("key", "shard", "part").mapInArrow(_hashed, "key string, sha string")
    shares = materialize(shares.join(hashes, "key", "left").withColumn("ends_sha256", F.coalesce("sha", F.sha2(F.lit(""), 256))).drop("sha"), "skeleton")
    parents = shares.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", *facts, "ends_sha256"]
    children = attach(told.where(F.col("kind") == CHILD).drop("parent_conv_id"), parents, ["parent"])
    return told.where(F.col("kind") == WHOLE).select(*columns).unionByName(children.select(*columns)).unionByName(shares.join(parents, "parent", "left").select(*columns))


def prefix_trie(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per node of the trie of rows (conv_id, turn, role, text, ...).

    Conversations are rebuilt first: each begins with the first turns of the one that begins its family of 20. A node
    is known by its depth and its smallest member. Rows go by turn, those without one first, and by role and text
    where turns are equal, so repeated rows are turns of their own. A null role or text is empty; rows without conv_id
    belong to no conversation and are left out. An empty table gives an empty result. Other columns are ignored,
    whatever their names. A conversation's digests are one value: 16 bytes a turn, never its texts.
    """
    given = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return nodes(rebuilt(materialize(paths(given), "paths")))
