"""Each stage of the pipeline, and the whole."""

from collections import Counter

import numpy as np

import corpus_pipeline
from fundloom.llm import quality
from tests.llm.test_jaccard import brute_kept
from tests.llm.test_stores import brute_selection
from tests.llm.test_texts import SCHEMA, brute_spans, corpus, fill, words_of


def test_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append([docs, docs.columns])
    start = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for out, columns in kept[:-1]:
        assert columns == start.columns and out.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    weights = brute_selection([(r.doc_id, r.text) for r in start.collect()], labels)
    noise = {r.doc_id: r.noise for r in start.select("doc_id", quality.gumbel().alias("noise")).collect()}
    k = round(sum(1 / (1 + np.exp(-w)) for w in weights.values()))
    assert {r.doc_id for r in kept[0][0].collect()} == set(sorted(weights, key=lambda d: -(weights[d] + noise[d]))[:k])
    before = [(r.doc_id, r.text) for r in kept[0][0].collect()]
    near = {r.doc_id for r in kept[1][0].collect()}
    assert near == brute_kept(before)
    texts = {r.doc_id: r for r in kept[2][0].collect()}
    for d, n, gone, _ in brute_spans([(r.doc_id, r.text) for r in kept[1][0].collect()]):
        assert (d in texts) == (not gone or n > gone)
        if d in texts:
            assert len(words_of(texts[d].text)) == n - gone and texts[d].n_chars == len(texts[d].text)
    copies = Counter(r.doc_id for r in kept[3][0].collect())
    assert set(copies) <= set(texts) and max(copies.values()) <= 2
    assert {r.source for r in kept[3][0].collect()} == {r.source for r in texts.values()}
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in texts.values():
        sizes[r.source] += len(words_of(r.text))
        taken[r.source] += copies[r.doc_id] * len(words_of(r.text))
        largest[r.source] = max(largest[r.source], len(words_of(r.text)))
    order = sorted(sizes, key=lambda s: s.encode())
    want = fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 for s in sizes)
    ends = Counter()
    for r in kept[4][0].collect():
        ends[r.sequence_id] += r.length
        assert r.n_sequences == r.least_sequences
    assert max(ends.values()) <= 4096 and len(ends) == r.n_sequences
    pieces = Counter(r.doc_id for r in kept[4][0].where("piece = 0").collect())
    assert pieces == copies
    assert corpus_pipeline.run(spark, sf_dir).count() == kept[4][0].count()


def test_stages_with_nulls_and_extra_columns(spark):
    docs = spark.createDataFrame(corpus(n=20), SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.count() <= 2 * docs.count()
        stage(spark, docs.limit(0), "/root/testdata/sf0.001").count()
