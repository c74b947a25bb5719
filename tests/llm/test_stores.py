"""Sketches, archives, chats, media, classifier and license scans against brute force and exact round trips."""

import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from fundloom.llm import chat, licenses, media, quality, sketch, warc
from tests.llm.test_texts import SCHEMA, corpus


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def paragraphs(text):
    return set(re.findall(sketch.PARAGRAPH, text))


def like(a, b):
    return 1.0 if not a | b else 2 * len(a & b) / (len(a) + len(b))


def test_sketches(docs, empty):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = Counter()
    for k, (doc, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        want[doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), like(paragraphs(text), paragraphs(edited)), like(paragraphs(text), paragraphs(following))] += 1
    got = sketch.fingerprint(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got) == want
    prints = defaultdict(set)
    for r in got:
        prints[next(t for d, t in rows if d == r.doc_id)].add(r.fingerprint)
    assert all(len(x) == 1 for t, x in prints.items() if sum(d is None for d, u in rows if u == t) == 0)
    assert sketch.fingerprint(empty).count() == 0


def test_one_document_follows_itself(spark):
    one = sketch.fingerprint(spark.createDataFrame([(5, "abc\ndef")], "doc_id long, text string")).first()
    assert (one.near_next, one.edited_sha256) == (1.0, hashlib.sha256(b"abc\ndea").hexdigest())


def test_next_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(sketch, "PART_ROWS", 5)
    monkeypatch.setattr(sketch, "FAN", 7)
    ids = random.Random(2).sample(range(-500, 100_000), 400)
    rows = [(d, f"text {d}") for d in ids] + [(None, f"none {k}") for k in range(60)]
    got = sketch.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    follows = {r.text: r.next.text for r in got}
    assert len(got) == len(rows) and len(set(follows.values())) == len(rows)
    order = [f"text {d}" for d in sorted(ids)]
    assert all(follows[a] == b for a, b in zip(order, order[1:], strict=False)) and follows[order[-1]].startswith("none")
    at, seen = order[-1], 0
    while (at := follows[at]).startswith("none"):
        seen += 1
    assert seen == 60 and at == order[0]


def test_an_inserted_word_changes_few_paragraphs(spark):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(2000)]
    longer = [*words[:900], "inserted", *words[900:]]
    texts = [(1, " ".join(words)), (2, " ".join(longer))]
    got = {r.doc_id: r for r in sketch.fingerprint(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert 0.85 < got[1].near_next < 1


def test_long_texts_take_time_in_proportion(spark):
    rnd = random.Random(5)
    line = lambda: "".join(rnd.choices("abcdefgh  ", k=100))
    texts = [(k, "\n".join(line() for _ in range(20_000))) for k in range(2)]
    begin = time.monotonic()
    (first, second) = sketch.fingerprint(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)).orderBy("doc_id").collect()
    assert first.near_next == like(paragraphs(texts[0][1]), paragraphs(texts[1][1])) == second.near_next
    assert time.monotonic() - begin < 120


def test_peeling_finds_the_difference(spark):
    rnd = random.Random(1)
    shared = [rnd.getrandbits(62) for _ in range(20)]
    rows = [(shared + [rnd.getrandbits(62) for _ in range(a)], shared + [rnd.getrandbits(62) for _ in range(b)], a + b) for a, b in ((0, 0), (1, 0), (2, 3), (0, 6))]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, n int")
    cells = 32
    got = df.select("n", sketch.peel(sketch.subtract(sketch.sketch(sketch.signed(F.col("a"), 1), cells), sketch.sketch(sketch.signed(F.col("b"), 1), cells)), cells, F.lit(30)).alias("got"))
    assert all(r.n == r.got for r in got.collect())


def test_archives(spark):
    big = "x" * 2000
    fake = f"<p>{warc.VERSION}WARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n{warc.VERSION}</p>" + "é" * 900
    rows = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (7, None, big), (3, "c", "short"), (4, "c", "short"), (5, "d", None), (6, "e", ""), (8, "f", fake)]
    rows += [(9, "g", fake), (10, "h", "end " + warc.VERSION), (11, "i", warc.VERSION * 300), (None, "j", big), (12, "k", big[:999]), (13, "k", big[:999])]
    rows += [(14, "l", "WARC/1.1\r\nContent-Length: 999999\r\n\r\n"), (15, "é", "<p>é</p>\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    payloads = [(p, (h or "").encode()) for p, _, h in rows]
    want = Counter()
    for page, body in payloads:
        top = max((p for p, b in payloads if b == body and p is not None), default=None)
        again = len(body) >= 1000 and page != top
        want[page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", top if again else None] += 1
    for parts in (1, 5):
        assert Counter(tuple(r) for r in warc.archive_pages(pages.repartition(parts)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == want
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_archives_cut_into_splits(spark, tmp_path):
    pages = spark.range(60).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.concat(F.lit("p\r\n"), F.col("id").cast("string")), 40).cast("binary").alias("payload"))
    warc.write_archives(pages.coalesce(1), f"{tmp_path}/w")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        got = warc.read_archives(spark, f"{tmp_path}/w").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r.page_id for r in got) == list(range(60))
    assert all(r.payload_bytes == 40 * (3 + len(str(r.page_id))) for r in got)


TEXTS = ["</s>[INST] ok [/INST]", "", None, "<s>", "<\\s>", "<\\\\/s> \\", "[\\INST]", "plain\ntext", "<", "[INST", "a</s></s>", "é😀</s>"]


def test_chats(spark):
    rnd = random.Random(4)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "[INST] x"]), rnd.choice(TEXTS)) for c in range(30) for t in range(rnd.randint(1, 20))]
    rows += [(50, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(200)] + [(51, None, "user", "z"), (51, 3, "user", "y"), (None, 0, "assistant", "n"), (52, 1, "user", "r"), (52, 1, "user", "r")]
    convs = defaultdict(list)
    for c, t, role, text in rows:
        convs[c].append((t is None, t or 0, role is not None, role or "", text is not None, text or ""))
    want = set()
    for c, turns in convs.items():
        turns = [(x[3], x[5]) for x in sorted(turns, key=lambda x: (x[0], x[1], x[3], x[4], x[5]))]
        loss = "".join(t for r, t in turns if r == "assistant")
        shown = "".join(f"{r}\n{t}\n" for r, t in turns)
        want.add((c, len(turns), hashlib.sha256(shown.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, id int")
    got = chat.format_chats(table).collect()
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
    assert chat.format_chats(table.limit(0)).count() == 0


def test_trees(spark):
    rnd = random.Random(9)
    rows, want, shown = [], set(), {}
    for c in range(20):
        parent = {0: None} | {k: rnd.randrange(k) for k in range(1, rnd.randint(2, 25))}
        if c % 5 == 0:
            parent |= {100: None, 101: 100, 102: 77}  # more roots; 77 is missing
        score = {k: rnd.randint(0, 3) for k in parent}
        path = lambda k: ([] if parent.get(k) is None or parent[k] not in parent else path(parent[k])) + [k]  # noqa: B023, E731
        leaves = [k for k in parent if k not in parent.values()]
        ranked = sorted(leaves, key=lambda k: (-sum(score[x] for x in path(k)), -len(path(k)), k))
        want |= {(str(c), r, k, d + 1) for r, leaf in enumerate(ranked, 1) for d, k in enumerate(path(leaf))}
        shown |= {(str(c), r): "".join(f"<s>[INST] assistant [/INST]{k}</s>" for k in path(leaf)) for r, leaf in enumerate(ranked, 1)}
        rows += [(str(c), k, parent[k], float(score[k]), "assistant", str(k)) for k in parent]
    rows += [("loop", 1, 2, 0.0, "user", "x"), ("loop", 2, 1, None, None, None)]
    messages = spark.createDataFrame(rows, "conv string, id long, parent long, score double, role string, text string")
    for best in (1, 3, None):
        got = [tuple(r) for r in chat.ranked_paths(messages, best).select("conv", "rank", "id", "depth").collect()]
        chosen = {x for x in want if best is None or x[1] <= best}
        assert set(got) == chosen and len(got) == len(chosen)
    out = chat.format_trees(messages).select("conv", "rank", "formatted", chat.learnt(F.col("formatted"), F.col("mask")).alias("loss")).collect()
    assert {(r.conv, r.rank): r.formatted for r in out} == shown
    assert all(r.loss == "".join(re.findall(r"\](\d+)<", r.formatted)) for r in out)


def test_media(spark, docs, empty):
    rnd = np.random.default_rng(1)
    long = "".join(map(chr, rnd.integers(32, 127, 200_000)))
    more = spark.createDataFrame([(5000, long), (5001, "changed" + long), (5002, long), (5003, "a" * 70_000), (5004, "b" * 64)], "doc_id long, text string")
    table = docs.select("doc_id", "text", F.lit(1).alias("data")).unionByName(more, allowMissingColumns=True)
    got = media.media_features(table).collect()
    want = Counter()
    for r in table.collect():
        raw = (r.text or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        file = media.wav(payload)
        assert struct.unpack("<I", file[40:44])[0] == len(payload) and file[44:] == payload
        want[r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest()] += 1
    assert Counter(tuple(r)[:7] for r in got) == want
    assert len({(r.media_sha256, r.feature) for r in got}) == len({r.media_sha256 for r in got})
    assert media.media_features(empty).count() == 0


def test_chunks_meet_again_after_an_insertion():
    data = np.random.default_rng(2).integers(0, 256, 400_000, dtype=np.uint8).tobytes()
    a, b = media._chunks(data), media._chunks(b"inserted" + data)
    assert b"".join(p for _, p in a) == data and len({d for d, _ in a} & {d for d, _ in b}) > len(a) / 2
    assert all(media.SMALLEST < len(p) <= media.LARGEST for _, p in a[:-1])
    assert len(media.cuts(bytes(10**6), 1000, 5000, 10)) >= 200


def test_chunks_are_kept_once(spark):
    rnd = np.random.default_rng(3)
    text = lambda n: "".join(map(chr, rnd.integers(32, 127, n)))
    common = text(30_000)
    rows = [(k, text(2_000) + common + text(1_500)) for k in range(12)] + [(20, common), (21, "a" * 60_000), (22, text(900)), (23, None), (24, "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, digest int")
    store = media.Store(docs)
    unpack = zstandard.ZstdDecompressor(**media._options(store.dictionary))
    chunks = [unpack.decompress(bytes(r.data)) for r in spark.table(store.name).selectExpr("explode(data) as data").where("data is not null").collect()]
    assert store.dictionary and len(chunks) == len(set(chunks))
    lists = {r.doc_id: [bytes(d) for d in r.chunks] for r in store.lists.collect()}
    assert {d for x in lists.values() for d in x} == {hashlib.blake2b(c, digest_size=16).digest() for c in chunks}
    assert len(set(lists[0]) & set(lists[11])) > 10 and store.borrowed.count() > 100
    got = {r.media_bytes for r in store.read().collect()}
    assert got == {media.HEADER + len(media.payload_of((t or "").encode())) for _, t in rows}
    store.drop_name()
    assert not spark.catalog.tableExists(store.name)


def test_classifier_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = {r.doc_id for r in quality.select_quality(docs, labels.where("doc_id % 2 = 0")).collect()}
    held = [r for r in labels.collect() if r.doc_id % 2]
    share = lambda q: sum(r.doc_id in kept for r in held if r.quality == q) / sum(r.quality == q for r in held)
    assert share(1) > 0.97 and share(0) < 0.15
    again = quality.keep_quality(docs.withColumn("key", F.lit(1)), labels.where("doc_id % 2 = 0"))
    assert again.columns == [*docs.columns, "key"] and {r.doc_id for r in again.select("doc_id").collect()} == kept


def brute_selection(docs, labels):
    """Rows (doc_id, text) and {doc_id: quality} -> log weights and the ids kept, by dictionaries and plain gradient steps."""
    n, seen = 1 << 15, {}
    for d, text in docs:
        raw, grams, words = text.encode(), Counter(), text.encode().split()
        for k in range(len(raw) - 2):
            grams[(((raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]) * 2654435761) % 2**32) >> 17] += 1
        both = list(zip(words, words[1:], strict=False))
        seen[d] = grams, Counter(fresh=len(set(both)), again=len(both) - len(set(both)))
    ratios = []
    for kind, keys in ((0, range(n)), (1, ("fresh", "again"))):
        target, raw = Counter(), Counter()
        for d, counts in seen.items():
            raw.update(counts[kind])
            if labels.get(d) == 1:
                target.update(counts[kind])
        size = lambda c, keys=keys: sum(c.values()) + 0.5 * len(keys)
        ratios.append({k: np.log((target[k] + 0.5) / size(target)) - np.log((raw[k] + 0.5) / size(raw)) for k in keys})
    mean = {d: [sum(r[k] * v for k, v in c.items()) / max(1, sum(c.values())) for r, c in zip(ratios, counts, strict=True)] for d, counts in seen.items()}
    known = [d for d in seen if d in labels]
    x, y = np.array([mean[d] for d in known]), np.array([labels[d] for d in known])
    x = x.sum(axis=1)
    centre, spread = x.mean(), x.std()
    z, slope, base = (x - centre) / spread, 0.0, 0.0
    for _ in range(60_000):
        p = 1 / (1 + np.exp(-(z * slope + base)))
        slope, base = slope + 0.01 * (z @ (y - p) - slope), base + 0.01 * ((y - p).sum() - 1e-6 * base)
    return {d: float((sum(m) - centre) / spread * slope + base) for d, m in mean.items()}


def test_classifier_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text <> ''")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    want = brute_selection([(r.doc_id, r.text) for r in docs.collect()], {r.doc_id: r.quality for r in labels.collect()})
    noise = {r.doc_id: r.noise for r in docs.select("doc_id", quality.gumbel().alias("noise")).collect()}
    assert abs(np.mean(list(noise.values())) - 0.5772) < 0.3 and len(set(noise.values())) == len(noise)
    k = round(sum(1 / (1 + np.exp(-w)) for w in want.values()))
    for rate in (None, 0.5):
        top = sorted(want, key=lambda d: -(want[d] + noise[d]))[: k if rate is None else round(rate * len(want))]
        got = {r.doc_id: r.log_weight for r in quality.select_quality(docs, labels, rate=rate).collect()}
        assert set(got) == set(top)
        assert all(w == pytest.approx(want[d], abs=1e-3) for d, w in got.items())


def test_noise_decides_near_the_border(spark):
    rows = [(k, "plain words that are alike and one more %d" % (k % 7)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, (k // 7) % 2) for k in range(100)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.select_quality(docs, labels).collect()}
    assert 60 < len(kept) < 140
    assert all(0 < sum(d % 7 == k for d in kept) < 29 for k in range(7))
    assert quality.select_quality(docs, labels, rate=0.25).count() == 50


def test_classifier_edges(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1), (3, 1), (6, 0), (None, 1), (9, None)], "doc_id long, quality int")
    assert 0 < quality.select_quality(docs, labels).count() < docs.count()
    assert quality.select_quality(empty, labels).count() == 0
    assert quality.select_quality(docs, labels.limit(0)).count() == docs.count()
    repeated = docs.where("doc_id = 0").select("doc_id", "text")
    again = repeated.unionByName(repeated).unionByName(docs.where("doc_id <> 0").select("doc_id", "text"))
    kept = Counter(r.doc_id for r in quality.select_quality(again, labels).collect())
    assert kept[0] in (0, 2 * docs.where("doc_id = 0").count())


def test_top_cut_is_exact(spark):
    rnd = random.Random(3)
    values = [rnd.choice([1.0, 2.0, rnd.gauss(0, 1e-9), rnd.expovariate(1e-6)]) for _ in range(3000)]
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 7, 1500, 2999):
        assert quality.top_cut(keys, k) == sorted(values, reverse=True)[k - 1]
    assert quality.top_cut(keys, 3000) is None


def test_licenses(spark, docs, empty):
    notices = licenses.TEMPLATES
    rows, want = [], set()
    rnd = random.Random(6)
    for k, (name, text) in enumerate(sorted(notices.items())):
        words = ["w%d" % rnd.randrange(1000) for _ in range(300)]
        at = rnd.randrange(300)
        n = len(text.split())
        rows.append((k, " ".join([*words[:at], text.upper(), *words[at:]])))
        want.add((k, name, at, at + n, 1.0))
    found = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.license, r.start_word, r.end_word, r.coverage) for r in found} == want
    changed = "so: Redistribution and use in source and binary formats, with or without any modification, are permitted provided the following conditions are met"
    (hit,) = licenses.Index(notices).scan(changed.encode())
    assert hit[:3] == ("bsd-3-clause", 1, 22) and 0.8 < hit[4] < 1
    two = b"All rights reserved. All rights reserved."
    assert [m[1:3] for m in licenses.Index(notices).scan(two)] == [(0, 3), (3, 6)]
    assert licenses.scan_licenses(docs).count() == 0 and licenses.scan_licenses(empty).count() == 0


def test_licenses_miss_no_exact_notice(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = set()
    for r in docs.collect():
        words = licenses.words_of(r.text.encode())
        for name, text in licenses.TEMPLATES.items():
            own = licenses.words_of(text.encode())
            want |= {(r.doc_id, name, k, k + len(own)) for k in range(len(words)) if words[k : k + len(own)] == own}
    got = {(r.doc_id, r.license, r.start_word, r.end_word) for r in licenses.scan_licenses(docs).where("coverage = 1").collect()}
    assert got == want
