"""Near copies of the pipeline against brute-force Jaccard similarity."""

from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from fundloom.llm import jaccard
from tests.llm.test_texts import SCHEMA, corpus


def word_sets(rows, size=5):
    out = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        n = min(size, len(w))
        out[d] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    return out


def brute_pairs(sets, least=0.8):
    holders, common = defaultdict(list), Counter()
    for d, s in sets.items():
        for x in s or {()}:
            holders[x].append(d)
    for h in holders.values():
        common.update((a, b) for k, a in enumerate(h) for b in h[k + 1 :])
    return [p for p, c in common.items() if c / (max(1, len(sets[p[0]])) + max(1, len(sets[p[1]])) - c) >= least]


def brute_kept(rows):
    parent = {d: d for d, _ in rows}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in brute_pairs(word_sets(rows)):
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {d for d in parent if parent[d] == d}


def test_stage_finds_all_near_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert len(kept) == len(set(kept)) and set(kept) == brute_kept(rows)


@pytest.mark.parametrize("bounds", [{"CROWD": 4, "BLOCK": 6}, {"CROWD_HASHES": 400, "BLOCK_HASHES": 600}])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, bounds):
    rnd = np.random.default_rng(11)
    base = [f"w{x}" for x in rnd.integers(0, 500, 120)]
    rows = []
    for k in range(160):  # copies of copies drift from the first ones, so that many are not similar to one another
        words = list(rows[int(rnd.integers(0, k))][1].split()) if k else list(base)
        for at in rnd.integers(0, len(words), 1 + k % 5):
            words[at] = f"n{k}"
        rows.append((k, " ".join(words)))
    for name, value in bounds.items():
        monkeypatch.setattr(jaccard, name, value)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_copies(docs).collect()}
    assert {d for d, c in got.items() if d == c} == brute_kept(rows)
    assert 1 < len(set(got.values())) < 160


def test_stage_with_nulls_and_repeated_rows(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id is not null").distinct().collect()]
    want = brute_kept(rows)
    got = Counter(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == Counter(r.doc_id for r in docs.collect() if r.doc_id is None or r.doc_id in want)


def test_shingles_of_a_text_longer_than_a_stretch(monkeypatch):
    text = b"  One two\tthree\r\ntwo one  two three four " * 50
    want = jaccard.shingles(text)
    assert len(want) == len({tuple(text.lower().split()[k : k + 5]) for k in range(50 * 8 - 4)})
    monkeypatch.setattr(jaccard, "SPANS", 7)
    assert np.array_equal(jaccard.shingles(text), want)
    assert [len(jaccard.shingles(t)) for t in (None, b"", b" \n", b"one", b"a b c d e")] == [0, 0, 0, 1, 1]


def test_links_span_exactly_the_similar_pairs():
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 10**6, 60)
    sets = [np.unique(np.where(rnd.random(60) < rnd.choice([0.02, 0.1, 0.3]), rnd.integers(10**6, 10**9, 60), base)).astype(np.uint64) for _ in range(150)]
    similar = brute_pairs({k: set(s.tolist()) for k, s in enumerate(sets)})
    links = jaccard.similar_links(sets)

    def groups(pairs):
        of = list(range(150))
        for a, b in pairs:
            of = [of[a] if x == of[b] else x for x in of]
        return {frozenset(k for k in range(150) if of[k] == x) for x in of}

    assert {tuple(sorted(p)) for p in links} <= {tuple(sorted(p)) for p in similar}
    assert groups(links) == groups(similar) and len(links) == 150 - len(groups(similar))
