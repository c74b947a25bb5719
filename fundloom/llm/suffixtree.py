"""Language-model scores of texts by a probabilistic suffix tree over their letters.

A text is read as its lower-cased words, each with a blank behind it, and one end. The tree's contexts are the strings
of up to DEPTH bytes that stand before a byte; they never reach over a text's beginning. It grows level by level: a
string becomes a candidate if at least SHARE of the corpus's bytes end in it, so a level has 1 / SHARE candidates at
most, whatever the corpus, and the bytes that follow each candidate are counted over all training texts. A candidate
is retained if its next-byte distribution diverges from that of its longest retained suffix, by count times
Kullback-Leibler divergence. Distributions are smoothed with the suffix's, the root's with one count for each byte
(Witten and Bell), so that each sums to one over all bytes, and the probabilities of all texts to one as well. A byte is
scored in the state of the longest retained suffix of what stands before it.

Counting and scoring walk an automaton of the candidates: the longest candidate that ends at a place follows from the
one before and the byte. Since no state needs more than DEPTH bytes, a stretch of texts is cut into columns that are
walked side by side, each from DEPTH bytes before its beginning.

A token, a word with its blank or the end, has the mean of two probabilities: the product of its bytes' and that of its
count, with one added, among all tokens. To the counts all words that training lacks are one event, to which the tree
adds the spelling of the one at hand, so the sum over all events is one at most.

The words' counts are a table of the whole vocabulary. Words of at least SHARE of all tokens,
which are 1 / SHARE at most, are looked up in the tasks; all others are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundloom.llm.shared import materialize, small

#: Bytes in a context at most, the least share of the corpus of a context or hot word, nats from which on a context is retained.
DEPTH, SHARE, NATS = 7, 5e-6, 10.0
#: Bytes of texts that are walked at once, columns of a walk, and counts in a block that is summed at once.
PIECE, COLUMNS, BLOCK = 2 << 20, 4096, 1 << 16
#: Words of a task's counts that are held before they are passed on.
HELD = 400_000
END, BLANK = 10, 32


def words_of(text: bytes | None) -> list[bytes]:
    """The words between white space, A to Z in lower case."""
    return (text or b"").lower().split()


def letters(words: list[bytes]) -> bytes:
    """What the tree reads of a text: each word and a blank, and the end."""
    return b" ".join([*words, b"\n"])


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list[bytes]]]:
    """Stretches of about PIECE bytes, and the texts they are made of, from batches of (text)."""
    held, size = [], 0
    for batch in batches:
        for text in batch.column(0):
            held.append(letters(words_of(text.as_py())))
            size += len(held[-1])
            if size >= PIECE:
                yield b"".join(held), held
                held, size = [], 0
    if held:
        yield b"".join(held), held


@dataclass
class Candidates:
    """The candidates as strings: each is one before it and a further byte; the first is empty. Levels follow each other."""

    alphabet: np.ndarray  # bytes that occur, in order; all others share one further column
    before: np.ndarray
    symbol: np.ndarray
    starts: list[int]  # of each level, and the end of the last

    def width(self) -> int:
        return len(self.alphabet) + 1

    def codes(self) -> np.ndarray:
        """Column of each byte."""
        out = np.full(256, len(self.alphabet), np.uint8)
        out[self.alphabet] = np.arange(len(self.alphabet))
        return out

    def automaton(self) -> tuple[np.ndarray, np.ndarray]:
        """For each candidate and byte the longest candidate behind them, and each one's longest proper suffix."""
        n = self.starts[-1]
        to, suffix = np.zeros((n, self.width()), np.int32), np.zeros(n, np.int32)
        for a, b in zip(self.starts[1:-1], self.starts[2:], strict=True):
            own = np.arange(a, b)
            if a > 1:
                suffix[own] = to[suffix[self.before[own]], self.symbol[own]]
            to[self.before[own], self.symbol[own]] = own
            to[own] = to[suffix[own]]
        return to, suffix

    def grown(self, state: np.ndarray, symbol: np.ndarray, n: np.ndarray, least: float) -> Candidates:
        """With those of the next level: a candidate of the last level and a byte that follows it `least` times, if without its first byte it is one too."""
        level = len(self.starts) - 2
        to, suffix = self.automaton()
        there = n >= least
        if level:
            depth = np.repeat(np.arange(level + 1), np.diff(self.starts))
            there &= (symbol != self.codes()[END]) & (depth[to[suffix[state], symbol]] == level)  # none reaches over an end
        order = np.lexsort((symbol[there], state[there]))
        before, last = np.concatenate((self.before, state[there][order])), np.concatenate((self.symbol, symbol[there][order]))
        return Candidates(self.alphabet, before.astype(np.int32), last.astype(np.int32), [*self.starts, len(before)])


def walk(text: bytes, codes: np.ndarray, steps_to: np.ndarray, width: int) -> np.ndarray:
    """For each byte of text, which begins a text, its place in a table of states and columns. steps_to: flat, states times width."""
    n = len(text)
    columns = max(1, min(COLUMNS, n // (4 * DEPTH)))
    steps = -(-n // columns)
    padded = np.full(DEPTH + columns * steps, codes[END], np.uint8)
    padded[DEPTH : DEPTH + n] = codes[np.frombuffer(text, np.uint8)]
    side = np.lib.stride_tricks.as_strided(padded, (columns, DEPTH + steps), (steps, 1)).T.copy()
    places, base = np.empty((steps, columns), np.int32), np.zeros(columns, np.int32)
    for t in range(DEPTH + steps):
        at = base + side[t]
        if t >= DEPTH:
            places[t - DEPTH] = at
        base = steps_to[at]
    return places.T.reshape(-1)[:n]


_automata: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def _flat(known: Candidates) -> np.ndarray:
    """The automaton with states times width, kept for the next task of this worker; the last one only."""
    key = known.before.tobytes() + known.symbol.tobytes() + known.alphabet.tobytes()
    if key not in _automata:
        _automata.clear()
        to, suffix = known.automaton()
        _automata[key] = ((to * known.width()).reshape(-1), suffix)
    return _automata[key][0]


def word_counts(texts: DataFrame) -> DataFrame:
    """texts (text binary) -> (pair int, word binary, n): pairs of neighbouring bytes, from the end before each text on, and words with the end; counted in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pairs = Counter(), np.zeros(1 << 16, np.int64)

        def out(keys: list, words: list, n: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["pair", "word", "n"])

        for batch in batches:
            for text in batch.column(0):
                words = words_of(text.as_py())
                held.update(words)
                held[b"\n"] += 1
                raw = np.frombuffer(b"\n" + letters(words), np.uint8).astype(np.int64)
                if len(raw) > 1 << 14:
                    pairs += np.bincount(raw[:-1] * 256 + raw[1:], minlength=1 << 16)
                else:
                    np.add.at(pairs, raw[:-1] * 256 + raw[1:], 1)
                if len(held) >= HELD:
                    yield out([None] * len(held), list(held), list(held.values()))
                    held = Counter()
        used = np.flatnonzero(pairs)
        yield out([None] * len(held) + used.tolist(), [*held, *[None] * len(used)], [*held.values(), *pairs[used].tolist()])

    counted = texts.mapInArrow(count, "pair int, word binary, n long")
    return materialize(counted.groupBy("pair", "word").agg(F.sum("n").alias("n")), "words")


def next_counts(texts: DataFrame, known: Candidates) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(state, column, n): how often each byte follows each candidate of the last level, where that is what stands before it.

    Each task counts its texts in one table and passes it on in blocks, which are summed as they come; what reaches
    the driver is one table of the level, of 1 / SHARE states at most.
    """
    first, width = known.starts[-2], known.width()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, codes, lowest = _flat(known), known.codes(), first * width
        total = np.zeros(known.starts[-1] * width - lowest, np.int64)
        for text, _ in pieces(batches):
            places = walk(text, codes, to, width)
            total += np.bincount(places[places >= lowest] - lowest, minlength=len(total))
        yield from blocks((k, total[k * BLOCK : (k + 1) * BLOCK]) for k in range(-(-len(total) // BLOCK)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, at, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held.setdefault(k, np.zeros(BLOCK, np.int64))[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.int64)
        yield from blocks(held.items())

    def blocks(tables: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for k, table in tables:
            if len(used := np.flatnonzero(table)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([used.astype(np.uint16).tobytes()], pa.binary()), pa.array([table[used].tobytes()], pa.binary())], ["block", "at", "n"])

    shape = "block int, at binary, n binary"
    rows = sorted(texts.mapInArrow(count, shape).repartition("block").mapInArrow(add, shape).collect())
    at = np.concatenate([np.zeros(0, np.int64), *[r[0] * BLOCK + np.frombuffer(r[1], np.uint16).astype(np.int64) for r in rows]])
    n = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r[2], np.int64) for r in rows]])
    return first + at // width, at % width, n


@dataclass
class Tree:
    """The candidates, the retained one whose distribution each has, and the log10 probabilities of those by column."""

    known: Candidates
    row: np.ndarray
    logs: np.ndarray

    def token_logs(self, text: bytes) -> np.ndarray:
        """Log10 probability of each token of a stretch of texts: the sum over its bytes."""
        width = self.known.width()
        places = walk(text, self.known.codes(), _flat(self.known), width)
        found = self.logs[self.row[places // width], places % width].astype(np.float64)
        raw = np.frombuffer(text, np.uint8)
        ends = np.flatnonzero((raw == BLANK) | (raw == END))
        return np.add.reduceat(found, np.concatenate(([0], ends[:-1] + 1)))


def tree(texts: DataFrame, pairs: np.ndarray, depth: int = DEPTH, share: float = SHARE, nats: float = NATS) -> Tree:
    """The tree of texts (text binary), of whose pairs of bytes the counts are known (256 by 256)."""
    alphabet = np.flatnonzero(pairs.sum(axis=0)).astype(np.uint8)
    total = int(pairs.sum())
    least = max(2.0, share * total)
    known = Candidates(alphabet, np.zeros(1, np.int32), np.zeros(1, np.int32), [0, 1])
    levels = []
    for level in range(depth + 1):
        if level == 0:
            ends = pairs.sum(axis=0)[alphabet]
            found = np.zeros(len(ends), np.int64), np.arange(len(ends)), ends
        elif level == 1:
            own = pairs[np.ix_(alphabet[known.symbol[1:]], alphabet)]
            state, symbol = np.nonzero(own)
            found = state + 1, symbol, own[state, symbol]
        else:
            found = next_counts(texts, known)
        levels.append(found)
        if level < depth:
            known = known.grown(*found, least)
            if known.starts[-1] == known.starts[-2]:
                break
    _, suffix = known.automaton()
    row, width = np.zeros(known.starts[-1], np.int32), known.width()
    root = np.full(width, 1.0 / (total + 256))
    root[levels[0][1]] += levels[0][2] / (total + 256)
    kept, offset = [root[None]], 1
    probabilities = root[None]
    for (state, symbol, n), a, b in zip(levels[1:], known.starts[1:], known.starts[2:], strict=False):
        counts = np.zeros((b - a, width))
        counts[state - a, symbol] = n
        upper = row[suffix[a:b]]
        held, kinds = counts.sum(axis=1, keepdims=True), np.maximum(1, (counts > 0).sum(axis=1, keepdims=True))
        back = probabilities[upper]
        own = (counts + kinds * back) / (held + kinds)
        retained = held[:, 0] * (own * np.log(own / back)).sum(axis=1) > nats
        row[a:b] = np.where(retained, offset + np.cumsum(retained) - 1, upper)
        kept.append(own[retained])
        offset += int(retained.sum())
        probabilities = np.concatenate((probabilities, kept[-1]))
    return Tree(known, row, np.log10(probabilities).astype(np.float32))


def score_texts(docs: DataFrame, depth: int = DEPTH, share: float = SHARE, nats: float = NATS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document of docs (doc_id, text, ...).

    Documents whose crc32 of the id, as text, leaves 2 when divided by 7 are held out, all others are learnt from; a row
    without doc_id has the empty text as its id and is learnt from. A null or empty text is its end alone. Repeated rows
    count each. Where nothing is learnt, all bytes are alike and each token's base probability is 1. An empty table gives
    an empty result. Other columns are ignored, whatever their names.
    """
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    rows = docs.select(F.col("text").cast("binary").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), (remainder == 2).alias("held_out"))
    training = rows.where(~F.col("held_out")).select("text")
    counted = word_counts(training)
    pairs = np.zeros((256, 256), np.int64)
    for r in counted.where("pair is not null").collect():  # 65,536 rows at most
        pairs[divmod(r["pair"], 256)] = r["n"]
    vocabulary = counted.where("word is not null").select("word", "n")
    n_tokens, n_words = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total = float(n_tokens + n_words + 1)
    hot = {bytes(r["word"]): (r["n"] + 1) / total for r in vocabulary.where(F.col("n") >= share * n_tokens).collect()}  # 1 / share rows at most
    model = tree(training, pairs, depth, share, nats)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, at = 0, 0
            for k, n in enumerate(batch.column(0).to_pylist()):
                size += n or 0
                if size >= PIECE or k + 1 == len(batch):
                    yield scored(batch.slice(at, k + 1 - at))
                    size, at = 0, k + 1

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The tokens' sums by text, as far as they are known here, and the rare words with what the tree says of them."""
        texts = [words_of(t.as_py()) for t in batch.column(1)]
        tokens = [t for words in texts for t in (*words, b"\n")]
        sizes = np.array([len(words) + 1 for words in texts])
        starts = np.cumsum(sizes) - sizes
        by_tree, by_count = model.token_logs(b"".join(map(letters, texts))), np.array([hot.get(t, 0.0) for t in tokens])
        known = by_count > 0
        base, both = np.zeros(len(tokens)), np.zeros(len(tokens))
        base[known] = np.log10(by_count[known])
        both[known] = np.log10((by_count[known] + 10.0 ** by_tree[known]) / 2)
        rare = np.flatnonzero(~known)
        offsets = np.searchsorted(rare, np.append(starts, len(tokens)))
        words = pa.StructArray.from_arrays([pa.array([tokens[k] for k in rare], pa.binary()), pa.array(by_tree[rare].astype(np.float32))], ["word", "tree"])
        sums = [pa.array(np.add.reduceat(x, starts)) for x in (known.astype(np.int64), base, both)]
        columns = [batch.column(2), batch.column(3), batch.column(4), pa.array(sizes), *sums, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words)]
        return pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "n_tokens", "known", "base", "both", "rare"])

    shape = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, both double, rare array<struct<word binary, tree float>>"
    texts = rows.select(F.octet_length("text").alias("size"), "text", F.monotonically_increasing_id().alias("row"), "doc_id", "held_out")
    out = materialize(texts.mapInArrow(score, shape), "scores")
    # The number of a row is written with it, so that it stays the same whatever is computed anew.
    asked = out.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.tree").join(small(vocabulary), "word", "left")
    by_count = (F.coalesce("n", F.lit(0)) + 1) / F.lit(total)
    met = asked.groupBy("row").agg(F.count("n").alias("more"), F.sum(F.log10(by_count)).alias("rest"), F.sum(F.log10((by_count + F.pow(F.lit(10.0), F.col("tree").cast("double"))) / 2)).alias("mixed"))
    of = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return out.drop("rare").join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", of("known", "more").alias("n_known"), F.lit(n_tokens).cast("long").alias("train_tokens"), of("base", "rest").alias("base_score"), of("both", "mixed").alias("score")
    )
