"""The prefix trie against a plain one, with few and many shards."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from fundloom.llm import trie

COLUMNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [r[2:] for r in sorted(x, key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))] for c, x in convs.items()}
    members, ends = {}, {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = convs.get(c - c % 20, [])[:h] + own[h:]
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
        ends.setdefault(tuple(path), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def below(p):
        own = (len(members[p]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
        inner = [below(c) for c in children.get(p, [])]
        return own + sum(x[0] for x in inner), sum(x[1] for x in inner) or 1

    out = []
    for p, m in members.items():
        saved, leaves = below(p)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves, saved, sha))
    return sorted(out)


def made(seed, n=150, turns=4):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        for k in range(rng.choice((1, turns, turns + 2))):
            rows.append((c, rng.choice((k, k, k, None)), rng.choice(("user", "user", None, "assistant")), rng.choice(("a b", "a", "", None, "c  d\te", f"x{c}"))))
    same = [(10_000 + c, k, "user", f"t {k}") for c in range(n) for k in range(5)]  # many copies
    return [*rows, *rows[:20], *same, (None, 1, "user", "lost"), *[(777, k, "user", f"w{k % 3}") for k in range(90)]]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("shards", [1, 4, 60])
def test_same_as_plain(spark, monkeypatch, shards):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(trie, "IDS", 3)
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    try:
        rows = made(shards)
        docs = spark.createDataFrame(rows, COLUMNS).withColumn("path", F.lit("x")).withColumn("depth", F.lit(1)).repartition(5)
        assert rows_of(trie.prefix_trie(docs)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_and_none(spark):
    assert trie.prefix_trie(spark.createDataFrame([], COLUMNS)).count() == 0
    rows = [(5, None, None, None)]
    assert rows_of(trie.prefix_trie(spark.createDataFrame(rows, COLUMNS))) == brute(rows)


def test_agreement():
    rng = random.Random(1)
    for _ in range(300):
        a, b = (b"".join(bytes([rng.randrange(2)]) * 16 for _ in range(rng.randrange(9))) for _ in range(2))
        n = 0
        while n < min(len(a), len(b)) // 16 and a[n * 16 : n * 16 + 16] == b[n * 16 : n * 16 + 16]:
            n += 1
        assert trie.agreement(a, b) == n
