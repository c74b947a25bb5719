"""Best-fit packing by bin completion.

Pieces are at most `capacity` tokens long, so the corpus is described to the planner by a histogram of at most
`capacity` rows, however large it is. The planner fills sequences around the largest length that is left: it
enumerates undominated fillings of the rest, takes them in order of waste, repeats a chosen filling as often as
its lengths last, and cuts off a branch as soon as its waste exceeds what would still beat the incumbent. The
first incumbent is best-fit decreasing. Each filling becomes a run of sequences; documents take their places by
their rank among the pieces of equal length, which Spark counts in salted groups.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundloom.llm.shared import materialize

CAPACITY = 4096
#: Words whose ids a Python worker keeps in each of two generations, and bytes of them and their ids; a word not met again in a generation's time goes.
CACHED_WORDS, CACHED_BYTES = 120_000, 32 << 20
#: Fillings listed for one sequence, steps to list them, and steps of the whole search, those included. They bound the time spent on
#: improving the incumbent and drop no piece; `least_sequences` in the output tells how far from a proof it stopped.
WIDTH, FILL_NODES, SEARCH_NODES = 12, 1_000, 200_000

#: The normalizer and splitting of vocabularies whose words can be taken apart by WORD.
PLAIN = (
    'Sequence(normalizers=[NFC(), Replace(pattern=Regex("\\s+"), content=" "), Lowercase()])',
    r"""Sequence(pretokenizers=[Split(pattern=Regex("'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), behavior=Removed, invert=True), ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])""",
)
#: Latin letters and what follows them of punctuation but apostrophes: two parts, each a single run for the vocabulary.
WORD = re.compile(r"([a-zà-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

_workers: dict[str, _Words] = {}

Plan = list[tuple[tuple[int, ...], int]]


def _visible() -> dict[int, int]:
    """Bytes to the characters by which byte-level vocabularies show them: printable ones are themselves, the others follow 255."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: b if b in kept else next(rest) for b in range(256)}


class _Words:
    """Ids of texts, word by word.

    The vocabulary's splitting never joins over ASCII white space, so a text's ids are its words' ids in order; words
    repeat, and are encoded once. They are kept in two generations, so that words of junk, which come only once, don't
    push out common ones. Most new words are Latin letters and punctuation: those go to the merges at once, without
    the normalizer and the splitting, which would take most of the time.
    """

    def __init__(self, path: str, most: int = CACHED_WORDS, most_bytes: int = CACHED_BYTES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.most_bytes, self.held = Tokenizer.from_file(path), most, most_bytes, 0
        self.model, self.visible = self.tokenizer.model, _visible()
        self.plain = (str(self.tokenizer.normalizer), str(self.tokenizer.pre_tokenizer)) == PLAIN
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encode(self, text: bytes | None) -> bytes:
        """Little-endian 32-bit ids."""
        words = (text or b"").split()
        found = list(map(self.recent.get, words))
        if None in found:
            learn = self._learn
            found = [learn(w) if ids is None else ids for w, ids in zip(words, found, strict=True)]
        return b"".join(found)

    def forget(self) -> None:
        """Lets all words go: workers outlive their tasks, and other stages need the memory."""
        self.recent, self.older, self.held = {}, {}, 0
        pa.default_memory_pool().release_unused()

    def _learn(self, word: bytes) -> bytes:
        ids = self._known(word)
        if ids is None:
            shown = word.decode("utf-8", "replace")
            parts = WORD.fullmatch(shown.lower()) if self.plain else None
            if parts is None:
                ids = array("I", self.tokenizer.encode(shown, add_special_tokens=False).ids).tobytes()
            else:
                ids = b"".join([self._run(x) for x in parts.groups() if x])
            self._keep(word, ids)
        return ids

    def _keep(self, word: bytes, ids: bytes) -> None:
        self.recent[word] = ids
        self.held += len(word) + len(ids)
        if len(self.recent) > self.most or self.held > self.most_bytes:
            self.recent, self.older, self.held = {}, self.recent, 0

    def _known(self, word: bytes) -> bytes | None:
        ids = self.recent.get(word)
        if ids is None and (ids := self.older.get(word)) is not None:
            self._keep(word, ids)
        return ids

    def _run(self, part: str) -> bytes:
        """Ids of a run of letters or punctuation."""
        raw = part.encode()
        ids = self._known(raw)
        if ids is None:
            shown = part if part.isascii() else raw.decode("latin-1").translate(self.visible)
            ids = array("I", [x.id for x in self.model.tokenize(shown)]).tobytes()
            self._keep(raw, ids)
        return ids


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and the end id, cut only where longer than capacity."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _workers.get(tokenizer) or _workers.setdefault(tokenizer, _Words(tokenizer))
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                out: list[list] = [[], [], [], [], []]
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = words.encode(text.as_py()) + end
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        for column, value in zip(out, (doc, piece, start // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        words.forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over a histogram; equal lengths are placed together."""
    open_: dict[int, Counter] = {}  # rest -> fillings with that rest
    rests: list[int] = []

    def put(filling: tuple[int, ...], rest: int, n: int) -> None:
        if rest not in open_:
            open_[rest] = Counter()
            bisect.insort(rests, rest)
        open_[rest][filling] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rests, length)
            if at == len(rests):
                many = capacity // length
                full, last = divmod(left, many)
                if full:
                    put((length,) * many, capacity - length * many, full)
                if last:
                    put((length,) * last, capacity - length * last, 1)
                break
            rest = rests[at]
            filling, n = open_[rest].popitem()
            if not open_[rest]:
                del open_[rest]
                rests.pop(at)
            take = min(n, left)
            if n > take:
                put(filling, rest, n - take)
            put((*filling, length), rest - length, take)
            left -= take
    return [x for fillings in open_.values() for x in fillings.items()]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: no packing has fewer sequences."""
    n = np.zeros(capacity + 1, np.int64)
    for x, c in counts.items():
        n[x] = c
    count, size = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    half = capacity // 2
    k = np.arange(1, half + 1)
    big, mid = count[capacity] - count[capacity - k], count[capacity - k] - count[half]
    room = mid * capacity - (size[capacity - k] - size[half])
    rest = np.maximum(0, -(-(size[half] - size[k - 1] - room) // capacity))
    return max(int(-(-size[capacity] // capacity)), int((big + mid + rest).max(initial=0)))


class _Search:
    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity, self.left = capacity, [0] * (capacity + 1)
        self.bits = 0  # bit x: a piece of length x is left
        self.steps = 0
        for x, n in counts.items():
            self.take(x, -n)

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if self.left[length]:
            self.bits |= 1 << length
        else:
            self.bits &= ~(1 << length)

    def at_most(self, length: int) -> int:
        """The largest length left that is no longer than this; 0 if none."""
        return max(0, (self.bits & ((1 << (length + 1)) - 1)).bit_length() - 1)

    def fillings(self, largest: int, width: int) -> list[tuple[int, tuple[int, ...]]]:
        """Undominated fillings of a sequence that holds the largest piece: (waste, lengths), least waste first."""
        found: list[tuple[int, tuple[int, ...]]] = []
        nodes = FILL_NODES
        self.take(largest, 1)

        def grow(chosen: tuple[int, ...], rest: int, most: int) -> None:
            nonlocal nodes
            x = self.at_most(min(rest, most))
            if not x:
                # Dominated if a piece in it can be swapped for a longer one that is left and fits.
                if not any((self.bits >> (y + 1)) & ((1 << rest) - 1) for y in set(chosen[1:]) if rest):
                    found.append((rest, chosen))
                return
            while x and nodes > 0 and len(found) < width and not (found and found[-1][0] == 0 and len(found) >= width // 2):
                nodes -= 1
                self.steps += 1
                self.take(x, 1)
                grow((*chosen, x), rest - x, x)
                self.take(x, -1)
                x = self.at_most(x - 1)

        grow((largest,), self.capacity - largest, largest)
        self.take(largest, -1)
        if not found:
            greedy, rest = [largest], self.capacity - largest
            self.take(largest, 1)
            while x := self.at_most(rest):
                self.take(x, 1)
                greedy.append(x)
                rest -= x
            for x in greedy:
                self.take(x, -1)
            found.append((rest, tuple(greedy)))
        return sorted(found, key=lambda f: (f[0], [-x for x in f[1]]))


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Fillings and how many sequences get each. counts: pieces of each length, 1 to capacity."""
    counts = {int(x): int(n) for x, n in counts.items() if n}
    if not counts:
        return []
    best = best_fit(counts, capacity)
    least, size = lower_bound(counts, capacity), sum(n for _, n in best)
    total = sum(x * n for x, n in counts.items())
    search, path, used, waste = _Search(counts, capacity), [], 0, 0
    stack: list[Iterator] = []
    while size > least and search.steps < SEARCH_NODES:
        search.steps += 1
        largest = search.bits.bit_length() - 1
        if largest <= 0:
            if used < size:
                best, size = list(path), used
        elif waste <= (size - 1) * capacity - total and len(stack) == len(path):
            stack.append(iter(search.fillings(largest, WIDTH)))
        # Go on with the next filling of the deepest level that has one.
        while stack:
            if len(path) == len(stack):
                filling, n = path.pop()
                used, waste = used - n, waste - n * (capacity - sum(filling))
                for x, c in Counter(filling).items():
                    search.take(x, -n * c)
            option = next(stack[-1], None)
            if option is None:
                stack.pop()
                continue
            rest, filling = option
            need = Counter(filling)
            n = min(search.left[x] // c for x, c in need.items())
            if waste + rest > (size - 1) * capacity - total:
                stack.pop()  # later fillings waste more
                continue
            if rest:
                n = min(n, max(1, ((size - 1) * capacity - total - waste) // rest))
            for x, c in need.items():
                search.take(x, n * c)
            path.append((filling, n))
            used, waste = used + n, waste + n * rest
            break
        else:
            break
    return best


def places(plan: Plan) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, copies in a filling, first sequence and offset of each run of equal places."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: Counter = Counter()
    sequence = 0
    for filling, n in plan:
        offset = 0
        for x, c in sorted(Counter(filling).items(), reverse=True):
            runs.setdefault(x, []).append((rank[x], c, sequence, offset))
            rank[x] += n * c
            offset += c * x
        sequence += n
    return {x: tuple(np.array(column, np.int64) for column in zip(*rows, strict=True)) for x, rows in runs.items()}


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, length, ...) -> the same with sequence_id, offset, n_sequences and least_sequences.

    least_sequences is a bound below which no packing can be: where n_sequences equals it, the plan is proven best.
    """
    spark = pieces.sparkSession
    # One row per length: at most `capacity` rows reach the driver.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_sequences(counts, capacity)
    where, n_sequences = places(plan), sum(n for _, n in plan)
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    before = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = before.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    ranked = (
        salted.withColumn("_at", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")))
        .join(before, ["length", "_salt"])
        .select(*pieces.columns, (F.col("_before") + F.col("_at") - 1).alias("_rank"))
    )
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length).tolist():
                rows = np.flatnonzero(length == x)
                first, copies, base, start = where[x]
                k = np.searchsorted(first, rank[rows], "right") - 1
                turn, copy = np.divmod(rank[rows] - first[k], copies[k])
                sequence[rows], offset[rows] = base[k] + turn, start[k] + copy * x
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(run, schema).select("*", F.lit(n_sequences).cast("long").alias("n_sequences"), F.lit(lower_bound(counts, capacity)).cast("long").alias("least_sequences"))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, n_sequences, least_sequences.

    A null or empty text is the end id alone. Repeated rows and rows without doc_id are packed like any others.
    Ties between equal lengths go by a hash of doc_id and piece. An empty table gives an empty result. Other
    columns are ignored, whatever their names.
    """
    return pack_pieces(materialize(token_pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)
