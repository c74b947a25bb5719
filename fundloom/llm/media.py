"""Media columns: content-defined chunks of stored media, each kept once, and media put together from them again.

A payload is stored as 8-bit mono samples in a WAV file. The samples are cut where a rolling gear hash of the last 32
bytes has its top bits zero, so that equal stretches are cut alike wherever they stand; the header, which holds the
length, stays apart. A medium is the ordered list of its chunks' digests. A join of the digests finds those that come
more than once, and gives each to the first place it stands at; the store has a row per medium with the chunks that
are its own, so each chunk is kept once and most media lie together. Reading joins the lists with the chunks that
stand elsewhere, checks the whole against the medium's digest and computes the features from what was read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundloom.llm.shared import attach, materialize, scratch_path

#: Bytes of a chunk: least, and most; one cut in 2^CUT_BITS positions between them.
SMALLEST, LARGEST, CUT_BITS = 512, 8_192, 10
RATE = 8000
HEADER = 44
#: Bytes of the dictionary that chunks are compressed with, the level, and the documents and bytes of each that it is trained on, at most.
DICTIONARY, LEVEL = 262_144, 12
SAMPLE, SAMPLED_BYTES = 2_000, 8_192
#: Media that a task remembers, so as not to send one twice.
REMEMBERED = 200_000


def _gear() -> np.ndarray:
    """256 well-mixed 32-bit values (splitmix64 of the byte)."""
    z = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def payload_of(text: bytes | None) -> bytes:
    """The text and bytes 0 up to a positive multiple of 64."""
    text = text or b""
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def wav(payload: bytes) -> bytes:
    """The payload as the samples of an 8-bit mono WAV file."""
    n = len(payload)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n & 0xFFFFFFFF, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n & 0xFFFFFFFF)
    return head + payload


def cuts(data: bytes, smallest: int = SMALLEST, largest: int = LARGEST, bits: int = CUT_BITS) -> list[int]:
    """Ends of the chunks."""
    if len(data) <= smallest:
        return [len(data)]
    # h[i] = sum of GEAR[data[i - j]] << j for j < 32, by doubling the window.
    h, width = GEAR[np.frombuffer(data, np.uint8)], 1
    while width < 32:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h, width = longer, 2 * width
    places = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    out, at = [], 0
    while len(data) - at > smallest:
        k = np.searchsorted(places, at + smallest)
        end = min(int(places[k]) if k < len(places) else len(data), at + largest, len(data))
        out.append(end)
        at = end
    if at < len(data):
        out.append(len(data))
    return out


def _chunks(samples: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], 0
    for end in cuts(samples):
        part = samples[at:end]
        out.append((hashlib.blake2b(part, digest_size=16).digest(), part))
        at = end
    return out


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            payload = payload_of(text)
            rows.append((doc, len(text or b""), len(payload), hashlib.sha256(wav(payload)).digest(), [d for d, _ in _chunks(payload)]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "payload_bytes", "media_id", "chunks"])


def train(docs: DataFrame, n: int) -> bytes:
    """A dictionary for the compression of chunks, from a random sample of about SAMPLE of n rows of docs (text binary), twice as many at most; empty where there is too little to learn from.

    It only makes the stored form smaller; what is read back doesn't depend on it.
    """
    drawn = docs.where("text is not null").where(F.rand(7) < SAMPLE / max(1, n))
    sample = drawn.select(F.substring("text", 1, SAMPLED_BYTES).alias("text")).limit(2 * SAMPLE).collect()
    chunks = [part for r in sample for _, part in _chunks(bytes(r["text"]))]
    size = min(DICTIONARY, sum(map(len, chunks)) // 8)
    if size < 1024 or len(chunks) < 100:
        return b""
    try:
        return zstandard.train_dictionary(size, chunks).as_bytes()
    except zstandard.ZstdError:
        return b""


def _options(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def _whole(batches: Iterator[pa.RecordBatch], dictionary: bytes) -> Iterator[pa.RecordBatch]:
    """Rows (text) -> (media_id, head, data): all chunks of each medium that the task has not met."""
    seen: set[bytes] = set()
    pack = zstandard.ZstdCompressor(level=LEVEL, write_dict_id=False, **_options(dictionary))
    kinds = (pa.binary(), pa.binary(), pa.list_(pa.binary()))
    for whole in batches:
        for k in range(0, whole.num_rows, 500):
            rows = []
            for text in whole.column(0).slice(k, 500):
                payload = payload_of(text.as_py())
                media = wav(payload)
                media_id = hashlib.sha256(media).digest()
                if media_id not in seen:
                    seen.add(media_id)
                    rows.append((media_id, media[:HEADER], [pack.compress(part) for _, part in _chunks(payload)]))
            if len(seen) > REMEMBERED:
                seen.clear()
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, kinds, strict=True)], ["media_id", "head", "data"])


def _features(samples: np.ndarray) -> tuple[float, float, float, int]:
    """Mean and root mean square of the level, entropy of the samples, changes of sign."""
    counts = np.bincount(samples, minlength=256)
    n, level = max(1, len(samples)), np.arange(256) / 128 - 1
    share = counts[counts > 0] / n
    high = samples >= 128
    return float((counts * level).sum() / n), float(np.sqrt((counts * level * level).sum() / n)), float(-(share * np.log2(share)).sum()), int((high[1:] != high[:-1]).sum())


READ = "media_id binary, payload_sha256 binary, tail_crc32 long, media_bytes long, mean double, rms double, entropy double, crossings long"


def _read(batches: Iterator[pa.RecordBatch], dictionary: bytes) -> Iterator[pa.RecordBatch]:
    """Rows (media_id, head, data, others array of (nth, data)) -> a row of READ per medium; the others take the places that data leaves empty."""
    unpack = zstandard.ZstdDecompressor(**_options(dictionary))
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
    for whole in batches:
        for k in range(0, whole.num_rows, 500):
            rows = []
            for media_id, head, data, others in zip(*(c.slice(k, 500) for c in whole.columns), strict=True):
                media_id, parts = media_id.as_py(), data.as_py()
                for other in others.as_py() or ():
                    parts[other["nth"]] = other["data"]
                samples = b"".join([unpack.decompress(part) for part in parts])
                media = head.as_py() + samples
                found = hashlib.sha256(media).digest()
                if found != media_id:
                    raise ValueError(f"medium {media_id.hex()} was read back as {found.hex()}")
                rows.append((media_id, hashlib.sha256(samples).digest(), zlib.crc32(samples[-64:]), len(media), *_features(np.frombuffer(samples, np.uint8))))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, kinds, strict=True)], [c.split()[0] for c in READ.split(", ")])


class Store:
    """Media in the shared folder.

    lists (doc_id, n_bytes, payload_bytes, media_id, chunks): a document's medium, digests in order.
    shared (digest, owner): digests that stand in more than one place, and the first of these (media_id, nth).
    borrowed (media_id, nth, digest): the other places.
    name: a table bucketed by media_id of (media_id, head, data): the chunks that are a medium's own, null in other places.
    dictionary: what the chunks are compressed with, also written beside the table.
    """

    def __init__(self, docs: DataFrame) -> None:
        self.spark = spark = docs.sparkSession
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        text = F.col("text").cast("binary")
        self.lists = materialize(docs.select(F.col("doc_id").cast("long"), text).mapInArrow(_lists, "doc_id long, n_bytes long, payload_bytes long, media_id binary, chunks array<binary>"), "lists")
        media = self.lists.groupBy("media_id").agg(F.first("chunks").alias("chunks"))
        placed = materialize(media.select("media_id", F.posexplode("chunks").alias("nth", "digest")), "placed")
        counted = placed.groupBy("digest").agg(F.min(F.struct("media_id", "nth")).alias("owner"), F.count("*").alias("n")).where("n > 1")
        self.shared = materialize(counted.select("digest", "owner"), "shared")
        at = F.struct("media_id", "nth")
        self.borrowed = materialize(attach(placed, self.shared, ["digest"]).where(at != F.col("owner")).select("media_id", "nth", "digest"), "borrowed")
        skip = self.borrowed.groupBy("media_id").agg(F.collect_set("nth").alias("skip"))
        self.dictionary = dictionary = train(docs.select(text.alias("text")), self.lists.count())
        materialize(spark.createDataFrame([(dictionary,)], "dictionary binary"), "dictionary")
        whole = docs.select(text).mapInArrow(lambda it: _whole(it, dictionary), "media_id binary, head binary, data array<binary>").dropDuplicates(["media_id"])
        kept = F.when(F.col("skip").isNull(), F.col("data")).otherwise(F.transform("data", lambda x, i: F.when(~F.array_contains("skip", i), x)))
        own = whole.join(skip, "media_id", "left").select("media_id", "head", kept.alias("data"))
        self.name = f"media_{uuid.uuid4().hex}"
        own.write.bucketBy(self.parts, "media_id").option("compression", "none").option("path", scratch_path(spark, "media")).format("parquet").saveAsTable(self.name)

    def read(self) -> DataFrame:
        """(media_id, payload_sha256, tail_crc32, media_bytes, feature) per medium, each checked against its digest."""
        own, dictionary = self.spark.table(self.name), self.dictionary
        wanted = self.shared.groupBy(F.col("owner.media_id").alias("media_id")).agg(F.collect_list(F.struct("digest", "owner.nth")).alias("wanted"))
        lent = own.join(wanted, "media_id").select(F.explode(F.transform("wanted", lambda w: F.struct(w["digest"].alias("digest"), F.get("data", w["nth"]).alias("data")))).alias("x"))
        lent = materialize(lent.select("x.*"), "lent")  # written, so that AQE can split the next join
        others = self.borrowed.join(lent, "digest").groupBy("media_id").agg(F.collect_list(F.struct("nth", "data")).alias("others"))
        return materialize(own.join(others, "media_id", "left").select("media_id", "head", "data", "others").mapInArrow(lambda it: _read(it, dictionary), READ), "media")

    def drop_name(self) -> None:
        """Takes the table's name out of the session's catalog; its files stay in the shared folder."""
        self.spark.sql(f"drop table if exists {self.name}")


def media_features(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) per document.

    A null text is empty; equal texts are one medium. Repeated rows and rows without doc_id come out as they are.
    An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    store = Store(docs)
    read = store.read()
    store.drop_name()
    feature = F.format_string("mean=%.6f;rms=%.6f;entropy=%.6f;crossings=%d", "mean", "rms", "entropy", "crossings")
    digest = lambda c, name: F.lower(F.hex(c)).alias(name)
    return store.lists.join(read, "media_id").select(
        "doc_id", "n_bytes", "payload_bytes", digest("payload_sha256", "payload_sha256"), "tail_crc32", "media_bytes", digest("media_id", "media_sha256"), feature.alias("feature")
    )
