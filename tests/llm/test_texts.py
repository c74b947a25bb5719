"""Near-dedup, packing, mixing and substring dedup against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from fundloom.llm import mixing, packing, simhash, substring
from pyspark.sql import functions as F

from fundloom.llm.mixing import featured, fitted_weight, mix, mixed_documents
from fundloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, did string, h1 int, fp string, key double, length string"


def corpus(seed=3, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randint(2, 6)))
    passage = [word() for _ in range(70)]
    base = [word() for _ in range(220)]
    rows = []
    for k in range(n):
        words = [word() for _ in range(rnd.choice([0, 1, 2, 5, 49, 50, 51, 120, 400]))]
        if k % 4 == 0:
            at = rnd.randint(0, len(words))
            words[at:at] = passage[rnd.randint(0, 15) : rnd.randint(55, 70)]
        if k % 7 == 0:
            words = list(base)
            if k % 14:
                words[rnd.randrange(220)] = "Zz"
        rows.append([k * 3 % (n * 3), rnd.choice([" ", "\n", "\t "]).join(words) if k % 11 else None, "en", rnd.choice(["b", "a", None, "c"]), 0])
    rows += [[rows[14][0], *rows[14][1:]], [None, rows[7][1], "en", "a", 0], [None, None, None, None, None], [1000, "  \n", "en", "c", 3]]
    rows += [[1001, "é x " * 300, "fr", "d", 0], [1002, "A b C", "fr", "d", 0], [1003, "a B c", "fr", "d", 0]]
    rows.append([1004, "long " * 9000, "en", "e", 0])
    return [(*r, "x", 1, "y", 0.5, "z") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return (text or "").encode().split()


def test_fingerprint_by_hand():
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0
    assert simhash.fingerprint(b"A b") == xxhash.xxh64_intdigest(b"a b", 42)
    text = b"One two  three\tfour one two three"
    w = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(len(w) - 2)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_masks_cover_every_pair():
    rnd = random.Random(0)
    for r in (1, 3):
        masks = simhash.covering_masks(list(range(64)), r)
        assert len(masks) == 2 ** (r + 1) - 1
        for _ in range(500):
            diff = sum(1 << b for b in rnd.sample(range(64), r))
            assert any(not diff & m for m in masks)


def brute_components(rows):
    prints = [(d, simhash.fingerprint(t.encode() if t else None)) for d, t in rows]
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[root(i)].append(d)
    return Counter((d, f"{p:016x}", min(least[root(i)], default=None)) for i, (d, p) in enumerate(prints))


def test_near_dedup(docs, empty):
    got = Counter(tuple(r) for r in simhash.near_dedup(docs).collect())
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert simhash.near_dedup(empty).count() == 0


@pytest.mark.parametrize("hot", [3, 1000])
def test_near_links_in_dense_groups(spark, hot):
    rnd = random.Random(5)
    centre = rnd.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for _ in range(150)} | {rnd.getrandbits(64) for _ in range(50)}
    prints = sorted(prints)
    rows = [(simhash._signed(p), k) for k, p in enumerate(prints)]
    links = simhash.near_links(spark.createDataFrame(rows, "fp long, rep long"), hot=hot).collect()
    assert all((prints[x.a] ^ prints[x.b]).bit_count() <= 3 for x in links)

    def classes(pairs):
        parent = list(range(len(prints)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in pairs:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        return [root(i) for i in range(len(prints))]

    everything = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    assert classes((x.a, x.b) for x in links) == classes(everything)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[r.doc_id, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = packing.pack(docs, tokenizer_path()).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    rows = defaultdict(list)
    for r in got:
        rows[r.sequence_id].append((r.offset, r.length))
    for places in rows.values():
        places.sort()
        assert [o for o, _ in places] == [sum(x for _, x in places[:k]) for k in range(len(places))]
        assert sum(x for _, x in places) <= 4096
    counts = Counter(r.length for r in got)
    assert len(rows) == packing.lower_bound(counts, 4096)
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_plan_is_optimal_on_small_cases():
    def optimum(items, capacity):
        best = len(items)

        def place(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(items):
                best = len(bins)
                return
            for i in range(len(bins)):
                if bins[i] + items[k] <= capacity and bins.index(bins[i]) == i:
                    place(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1 :]])
            place(k + 1, [*bins, items[k]])

        place(0, [])
        return best

    rnd = random.Random(2)
    for _ in range(60):
        items = sorted((rnd.randint(3, 20) for _ in range(rnd.randint(1, 11))), reverse=True)
        plan = packing.plan_sequences(Counter(items), 20)
        used = Counter(x for filling, n in plan for x in filling for _ in range(n))
        assert used == Counter(items) and all(sum(f) <= 20 for f, _ in plan)
        assert sum(n for _, n in plan) == optimum(items, 20)
    assert packing.plan_sequences({}) == []


def fill(sizes, weights, total):
    """Targets by dealing the excess again until none is above twice its size."""
    target, capped, rest = {}, set(), total
    while True:
        free = [s for s in sizes if s not in capped]
        share = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
            capped.add(s)


def test_mixing(docs, empty):
    got = mix(docs).collect()
    assert sorted(map(tuple, mix(docs).collect()), key=str) == sorted(map(tuple, got), key=str)
    sizes, texts = defaultdict(int), Counter()
    for r in docs.collect():
        sizes[r.source] += len(words_of(r.text))
        texts[r.doc_id, len(words_of(r.text))] += 1
    assert Counter((r.doc_id, r.size) for r in got) == texts
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want = fill({s: n for s, n in sizes.items() if n}, weights, 1.5 * sum(sizes.values()))
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want.get(r.source, 0))
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - want.get(s, 0)) <= 2 * largest[s] for s in sizes)
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in got)
    assert mix(empty).count() == mixed_documents(empty).count() == 0


def test_targets_of_many_sources(spark):
    rnd = random.Random(8)
    rows = [(k * 100 + j, "w " * rnd.choice([3, 10, 40, 200, 1000]), f"s{k:02}") for k in range(20) for j in range(30 if k % 3 else 90)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken in (0, r.size, 2 * r.size)
    want = fill(sizes, {f"s{k:02}": (5, 2, 1)[k % 3] for k in range(20)}, 1.5 * sum(sizes.values()))
    targets = {r.source: r.target for r in got}
    assert targets == pytest.approx(want) and min(targets.values()) > 0 and sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 for s in want)


def test_mixing_repeated_rows_and_missing_ids(spark):
    rows = [(5, "w " * 10, "a")] * 300 + [(None, f"x {k}", "b") for k in range(40)] + [(None, "same y", "c")] * 30 + [(None, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs).collect()
    taken, targets = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        targets[r.source] = r.target
    want = fill({"a": 3000, "b": 80, "c": 60}, {"a": 5, "b": 2, "c": 1}, 1.5 * 3140)
    assert all(targets[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 10 for s in want)
    assert mixed_documents(docs).count() == sum(r.copies for r in got)


def test_narrowing_the_range_of_the_budget(spark, monkeypatch):
    rows = [(k, "w " * (k % 50 + 1), "ab"[k % 2]) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(tuple, mix(docs).collect()))
    monkeypatch.setattr(mixing, "FEW", 3)
    monkeypatch.setattr(mixing, "SLOTS", 4)
    assert sorted(map(tuple, mix(docs).collect())) == want


def brute_spans(rows, window=50):
    first = {}
    for d, text in rows:
        w = words_of(text)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, substring.LAST), substring.LAST if d is None else d)
    out = Counter()
    for d, text in rows:
        w = words_of(text)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (substring.LAST if d is None else d):
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("window", [50, 8])
def test_substring(docs, empty, window):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = Counter(tuple(r) for r in substring.span_dedup(docs, window).collect())
    assert got == brute_spans(rows, window)
    texts = substring.without_repeats(docs, window)
    assert texts.columns == docs.columns
    kept = Counter((r.doc_id, len(words_of(r.text)), hashlib.sha256(b" ".join(words_of(r.text))).hexdigest()) for r in texts.collect())
    want = Counter()
    for (d, n, gone, sha), times in brute_spans(rows, window).items():
        if not gone or n - gone:
            want[d, n - gone, sha] += times
    assert kept == want
    assert substring.span_dedup(empty).count() == 0


def test_covers_meet_at_every_shift():
    for window in (5, 8, 20, 50, 80):
        period, residues = substring.cover(window)
        assert {(a - b) % period for a in residues for b in residues} == set(range(period))
        assert window - period + 1 >= 1


def test_given_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(tuple(r) for r in substring.span_dedup(docs).collect()) == brute_spans(rows)
    assert Counter(tuple(r) for r in simhash.near_dedup(docs).collect()) == brute_components(rows)


def test_fitted_weight(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = featured(docs)
    weight = fitted_weight(rows, labels)
    by = {r.quality: r for r in rows.withColumn("w", weight).join(labels, "doc_id").groupBy("quality").agg(F.avg("w").alias("mean"), F.min("w").alias("least"), F.max("w").alias("most")).collect()}
    assert by[1].mean > 0.9 and by[0].mean < 0.3 and by[0].least >= 0.05 and by[1].most <= 1
    odd = featured(spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, "a b")], "doc_id long, text string"))
    assert [r.w for r in odd.select(fitted_weight(rows, labels.where("quality = 1")).alias("w")).collect()] == [1.0] * 4
    assert [r.w for r in odd.where("doc_id < 3").select(weight.alias("w")).collect()] == [1.0, 1.0]
    # A good document is rather taken than a bad one of the same source.
    one = docs.withColumn("source", F.lit("x"))
    taken = {r.quality: r.more for r in mix(one, share=1.5, labels=labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("copies") - 1).alias("more")).collect()}
    assert taken[1] > taken[0] + 0.2


def test_cache_of_words_is_bounded_by_bytes():
    words = packing._Words(tokenizer_path(), most_bytes=20_000)
    whole = packing._Words(tokenizer_path())
    rng = np.random.default_rng(5)
    texts = [" ".join("".join(rng.choice(list("abcdé"), 900)) for _ in range(12)).encode() for _ in range(6)]
    for text in texts * 2:
        assert words.encode(text) == whole.encode(text)
        for kept in (words.recent, words.older):
            assert sum(len(w) + len(ids) for w, ids in kept.items()) <= 20_000 + 5 * 1_800
    assert words.encode(b"word " * 5) == whole.encode(b"word " * 5)
