"""The probabilistic suffix tree against one of plain dictionaries, and its base scores against counts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundloom.llm import suffixtree as S

COLUMNS = "doc_id long, text string"


def held_out(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def letters(text):
    return b"".join(w + b" " for w in (text or "").encode().lower().split()) + b"\n"


def plain_tree(texts, depth, share, nats):
    """(distribution of a byte behind what stands before it) by dictionaries of contexts."""
    whole = [b"\n" + letters(t) for t in texts]
    total = sum(len(t) - 1 for t in whole)
    follows = {}
    for t in whole:
        for k in range(1, len(t)):
            for d in range(min(depth, k) + 1):
                follows.setdefault(t[k - d : k], Counter())[t[k]] += 1
    least = max(2.0, share * total)
    known = {b""}
    for d in range(1, depth + 1):
        for s in [s for s in known if len(s) == d - 1]:
            for c, n in follows.get(s, {}).items():
                if n >= least and (c != 10 or d == 1) and (s[1:] + bytes([c]) if d > 1 else b"") in known:
                    known.add(s + bytes([c]))
    tables = {b"": {c: (follows.get(b"", {}).get(c, 0) + 1) / (total + 256) for c in range(256)}}

    def longest(s):
        while s not in tables:
            s = s[1:]
        return s

    for s in sorted(known - {b""}, key=len):
        upper, own = tables[longest(s[1:])], follows.get(s, Counter())
        n, kinds = sum(own.values()), max(1, len(own))
        new = {c: (own[c] + kinds * upper[c]) / (n + kinds) for c in range(256)}
        seen = set(follows.get(b"", {}))
        rest = next((c for c in range(256) if c not in seen), None)  # all bytes that never occur count as one in the divergence
        if n * sum(new[c] * math.log(new[c] / upper[c]) for c in [*seen, *([rest] if rest is not None else [])]) > nats:
            tables[s] = new

    def score(text):
        """Log10 probabilities of the tokens."""
        t = b"\n" + letters(text)
        out = [0.0]
        for k in range(1, len(t)):
            begin = max(0, k - depth)
            out[-1] += math.log10(tables[longest(t[begin:k])][t[k]])
            if t[k] == 32:
                out.append(0.0)
        return out

    return tables, score


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 5))) for _ in range(40)]
    rows = [(k, rng.choice((" ", "\n", "\t ")).join(rng.choice(words[: rng.choice((4, 40))]) for _ in range(rng.randrange(60)))) for k in range(n)]
    return [*rows, (n, None), (None, "Abc  ABC"), (None, None), (n + 1, ""), *rows[:5], (n + 2, "zz \x01 ÿ " * 3), (n + 3, "a b " * 30_000)]


@pytest.mark.parametrize("depth, share", [(3, 1e-4), (6, 1e-3), (1, 1e-9)])
def test_same_as_plain(spark, monkeypatch, depth, share):
    monkeypatch.setattr(S, "PIECE", 700)
    monkeypatch.setattr(S, "HELD", 10)
    monkeypatch.setattr(S, "BLOCK", 64)
    rows = corpus()
    docs = spark.createDataFrame(rows, COLUMNS).withColumn("row", F.lit(1)).withColumn("word", F.lit("x")).repartition(4)
    training = [t for d, t in rows if not held_out(d)]
    _, score = plain_tree(training, depth, share, 1.0)
    counts = Counter(w for t in training for w in [*(t or "").encode().lower().split(), b"\n"])
    total, kinds = sum(counts.values()), len(counts)
    want = []
    for d, t in rows:
        tokens = [*(t or "").encode().lower().split(), b"\n"]
        base = [(counts[w] + 1) / (total + kinds + 1) for w in tokens]
        both = [math.log10((a + 10**b) / 2) for a, b in zip(base, score(t), strict=True)]
        want.append((d, held_out(d), len(tokens), sum(counts[w] > 0 for w in tokens), total, sum(map(math.log10, base)), sum(both)))
    got = [tuple(r) for r in S.score_texts(docs, depth, share, 1.0).collect()]
    order = lambda r: (str(r[0]), r[2], round(r[6], 3))
    for a, b in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-5)


def test_probabilities_sum_to_one():
    tables, _ = plain_tree(["ab abc b", "cab"], 4, 0.0, 0.1)
    assert len(tables) > 3 and all(sum(t.values()) == pytest.approx(1) for t in tables.values())


def test_walk_is_the_longest_candidate(spark):
    text = b"".join(letters(t) for _, t in corpus(40))
    pairs = np.zeros((256, 256), np.int64)
    np.add.at(pairs, (np.frombuffer(b"\n" + text[:-1], np.uint8), np.frombuffer(text, np.uint8)), 1)
    model = S.tree(spark.createDataFrame([(t,) for _, t in corpus(40)], "text string").selectExpr("cast(text as binary) as text"), pairs, 5, 1e-3, 1.0)
    known = model.known
    names = [b""]
    for before, symbol in zip(known.before[1:], known.symbol[1:], strict=True):
        names.append(names[before] + bytes([known.alphabet[symbol]]))
    places = S.walk(text, known.codes(), S._flat(known), known.width())
    for k in range(0, len(text), 97):
        begin = text.rfind(b"\n", 0, k)
        before = b"\n" + text[begin + 1 : k]
        assert names[places[k] // known.width()] == max((s for s in names if before.endswith(s)), key=len)
        assert places[k] % known.width() == known.codes()[text[k]]
    # The logs of each retained distribution, with one share for each byte that never occurred, add up to one.
    total = (10.0 ** model.logs.astype(float)) @ np.array([*[1] * len(known.alphabet), 256 - len(known.alphabet)])
    assert np.allclose(total, 1, atol=1e-5)


def test_nothing_to_learn_and_empty(spark):
    doc = next(k for k in range(99) if held_out(k))
    got = S.score_texts(spark.createDataFrame([(doc, "a b")], COLUMNS)).collect()
    assert tuple(got[0])[:6] == (doc, True, 3, 0, 0, 0.0) and got[0].score == pytest.approx(sum(math.log10((1 + 256.0**-n) / 2) for n in (2, 2, 1)), rel=1e-6)
    assert S.score_texts(spark.createDataFrame([], COLUMNS)).count() == 0


def test_better_than_single_words_on_what_is_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    row = S.score_texts(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert row[0] > row[1] + 0.15 * row[2]
