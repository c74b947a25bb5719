"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in Spark's own functions only.

A paragraph is a line; longer lines are cut at words, the first one from character SHORTEST on that ends in one of a
few letters or marks, so that an inserted word moves the cuts near it and no others. A document's digests go into a
sketch of three tables of cells (count, XOR of digests, XOR of their check hashes). The sketches of two versions are
subtracted cell by cell, so that what they share vanishes, and peeling recovers the digests in which they differ: a
cell that holds one digest gives it away, and it is taken out of its other cells. Where peeling gets stuck, it is
tried again with more cells: the digests are dealt into blocks of about BLOCK, each with a sketch of its own that
grows until its peeling ends, so that the work stays in proportion to the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHORTEST, LONGEST = 112, 256
#: In Java and Python alike: up to a word that ends in a letter of the list, or as far as it goes.
PARAGRAPH = rf"[^\n]{{{SHORTEST},{LONGEST - 1}}}?[dehnsty.!?,](?![^ \t\n])|[^\n]{{1,{LONGEST}}}"
BLOCK = 8
#: Cells in each of the three tables: of a fingerprint, and of a block at each further try.
BASE, LARGER = 4, (8, 32, 128, 512, 2048)
#: Rows that a part of neighbouring documents has, about, and bounds that are looked through at a time.
PART_ROWS, FAN = 50_000, 256


def digests(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0))
    return F.array_distinct(F.transform(found, lambda p: F.xxhash64(p)))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _place(digest: Column, table: int, cells: Column) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(table), cells), cells).cast("int")


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit("check"))


def sketch(signed: Column, cells: int | Column) -> Column:
    """Three tables of cells, one after the other; signed: array of (d, s), s 1 or -1."""
    cells = F.lit(cells) if isinstance(cells, int) else cells
    xor = lambda items, field: F.aggregate(items, F.lit(0).cast("long"), lambda a, e: a.bitwiseXOR(e[field]))
    placed = F.transform(signed, lambda e: F.struct(e["d"].alias("d"), e["s"].alias("s"), _check(e["d"]).alias("c"), *[_place(e["d"], t, cells).alias(f"h{t}") for t in range(3)]))

    def tables(items: Column) -> Column:
        def cell(t: int):
            return lambda j: _let(
                F.filter(items, lambda e: e[f"h{t}"] == j),
                lambda own: F.struct(F.aggregate(own, F.lit(0), lambda a, e: a + e["s"]).alias("n"), xor(own, "d").alias("k"), xor(own, "c").alias("c")),
            )

        return F.concat(*[F.transform(F.sequence(F.lit(0), cells - 1), cell(t)) for t in range(3)])

    return _let(placed, tables)


def signed(digest: Column, sign: int) -> Column:
    return F.transform(digest, lambda d: F.struct(d.alias("d"), F.lit(sign).alias("s")))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["c"].bitwiseXOR(y["c"]).alias("c")))


def peel(difference: Column, cells: int | Column, steps: Column) -> Column:
    """How many digests differ; null if peeling gets stuck. steps: no more digests than this are looked for."""
    cells = F.lit(cells) if isinstance(cells, int) else cells
    pure = lambda x: (F.abs(x["n"]) == 1) & (x["c"] == _check(x["k"]))

    def take(state: Column) -> Column:
        def without(found: Column) -> Column:
            p = found[0]
            at = F.array(*[_place(p["k"], t, cells) + t * cells for t in range(3)])
            rest = _let(
                at,
                lambda h: F.transform(
                    state["cells"],
                    lambda x, i: F.when(
                        F.array_contains(h, i), F.struct((x["n"] - p["n"]).alias("n"), x["k"].bitwiseXOR(p["k"]).alias("k"), x["c"].bitwiseXOR(p["c"]).alias("c"))
                    ).otherwise(x),
                ),
            )
            return F.when(F.size(found) > 0, F.struct(rest.alias("cells"), (state["got"] + 1).alias("got"))).otherwise(state)

        return _let(F.filter(state["cells"], pure), without)

    start = F.struct(difference.alias("cells"), F.lit(0).alias("got"))
    end = F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), start, lambda s, _: take(s))
    return _let(end, lambda s: F.when(~F.exists(s["cells"], lambda x: (x["n"] != 0) | (x["k"] != 0) | (x["c"] != 0)), s["got"]))


def peeled(items: Column) -> Column:
    """How many of the signed digests of a block don't cancel out, by the first sketch whose peeling ends."""
    attempt = lambda cells: peel(sketch(items, cells), cells, F.size(items))
    more = F.aggregate(F.array(*map(F.lit, LARGER[1:])), F.lit(None).cast("int"), lambda got, cells: F.coalesce(got, attempt(cells)))
    return F.coalesce(attempt(LARGER[0]), more, F.raise_error(F.lit(f"no sketch of up to {LARGER[-1]} cells could be peeled")).cast("int"))


def differing(a: str, b: str, base_a: str, base_b: str) -> Column:
    """How many digests two versions differ in; a, b: their digests, base_a, base_b: their sketches of BASE cells."""
    total = F.size(a) + F.size(b)
    first = peel(subtract(F.col(base_a), F.col(base_b)), BASE, F.lit(3 * BASE))
    blocks = F.ceil(total / BLOCK).cast("int")
    both = F.concat(signed(F.col(a), 1), signed(F.col(b), -1))
    # Sorted by block once; a block is a slice between two places where its number changes.
    dealt = F.array_sort(F.transform(both, lambda e: F.struct(F.pmod(e["d"], blocks).alias("k"), e["d"].alias("d"), e["s"].alias("s"))))

    def by_block(items: Column) -> Column:
        n = F.size(items)
        begins = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(items, i - 1)["k"] != F.get(items, F.greatest(i - 2, F.lit(0)))["k"]))
        counted = _let(begins, lambda at: F.zip_with(at, F.concat(F.slice(at, 2, n), F.array(n + 1)), lambda i, j: peeled(F.slice(items, i, j - i))))
        return F.aggregate(counted, F.lit(0), lambda s, x: s + x)

    return F.when(total == 0, F.lit(0)).otherwise(F.coalesce(first, _let(dealt, by_block)))


def likeness(a: str, b: str, base_a: str, base_b: str) -> Column:
    """Share of the digests of both that are common to both, 0 to 1; 1 for two empty texts."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise((total - differing(a, b, base_a, base_b)) / total)


def encode(cells: str) -> Column:
    """The sketch as a string: count, digests and the low half of the checks of each cell, in hex digits."""
    digits = lambda value, n: F.right(F.lpad(F.lower(F.hex(value)), 16, "0"), F.lit(n))
    return F.concat_ws("", F.transform(cells, lambda x: F.concat(digits(x["n"].cast("long"), 2), digits(x["k"], 16), digits(x["c"], 8))))


def _rank(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most key; FAN of them are compared, or where there are more, FAN and one in FAN of all."""
    few = lambda values: F.array(*map(F.lit, values))
    count = lambda values: F.size(F.filter(values, lambda b: b <= key))
    if len(bounds) <= FAN:
        return count(few(bounds)) if bounds else F.lit(0)
    wide = -(-len(bounds) // FAN)
    groups = [bounds[k : k + wide] for k in range(0, len(bounds), wide)]
    return _let(count(few([g[0] for g in groups])), lambda g: F.when(g == 0, 0).otherwise((g - 1) * wide + count(F.get(F.array(*map(few, groups)), g - 1))))


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with next, a struct of the following row by doc_id; the first row follows the last.

    Rows are dealt by ranges of doc_id, those without one by a hash of their text, into parts of about PART_ROWS. The
    first row of a part is also sent to the part before it, so each part finds its own successors in one shuffle. The
    driver gets a bound and the first key of each part.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))))
    missing = F.col("doc_id").isNull()
    spark = docs.sparkSession
    n, nulls = docs.agg(F.count("doc_id"), F.count_if(missing)).first()
    least = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-n // PART_ROWS))
    bounds = docs.where(~missing).agg(F.percentile_approx(key, [k / parts for k in range(1, parts)], 20 * parts)).first()[0] if n else None
    bounds, hashed = sorted(set(bounds or [])), -(-nulls // PART_ROWS)
    part = F.when(missing, F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.lit(1)), F.lit(max(1, hashed))).cast("int") - hashed).otherwise(_rank(key, bounds))
    placed = docs.select(F.struct("*").alias("row"), key.alias("_key"), part.alias("_part"))
    firsts = sorted((r["_part"], r["_key"]) for r in placed.groupBy("_part").agg(F.min("_key").alias("_key")).collect())
    if not firsts:
        return docs.withColumn("next", F.struct("*"))
    heads = F.broadcast(spark.createDataFrame([(*first, firsts[k - 1][0]) for k, first in enumerate(firsts)], "_part int, _key long, _before int"))
    dealt = placed.join(heads, ["_part", "_key"], "left")
    at = lambda part, guest: F.struct(F.col(part).alias("part"), F.lit(guest).alias("guest"))
    sent = dealt.select("row", "_key", F.explode(F.filter(F.array(at("_part", 0), at("_before", 1)), lambda x: x["part"].isNotNull())).alias("at")).select("row", "_key", "at.*")
    order = Window.partitionBy("part").orderBy("guest", "_key", "row.text")
    return sent.withColumn("next", F.lead("row").over(order)).where("guest = 0").select("row.*", "next")


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per document.

    Rows are taken by doc_id, those without one first in an order of hashes, and by text where ids are equal; each is compared with the
    next one and with an edited text whose last quarter comes from the next one. A null text is empty. A single row
    follows itself; an empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), digests(text).alias("d"))
    own = with_next(own)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next.text", F.lit(1), quarter))
    out = own.select("doc_id", n.cast("long").alias("n_chars"), "d", F.col("next.d").alias("dn"), edited.alias("edited"))
    out = out.select("doc_id", "n_chars", "d", "dn", F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("edited")).alias("de"))
    out = out.select("*", *[sketch(signed(F.col(c), 1), BASE).alias(f"base_{c}") for c in ("d", "de", "dn")])
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        encode("base_d").alias("fingerprint"),
        encode("base_de").alias("edited_fingerprint"),
        likeness("d", "de", "base_d", "base_de").alias("near_edited"),
        likeness("d", "dn", "base_d", "base_dn").alias("near_next"),
    )
