"""Entities from text: places of patterns, names and listed words, found in one pass over each text, and their values.

The finding is a small helper in Arrow batches: it gives each place with its offsets, groups and surroundings, so that
no text goes further and the work is linear in text and matches. What a place means, its value and number, is made of
columns, a row per place. The order of finding is the order in which entities count (`seq`), on which later steps depend.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundloom.functions.catalog import ASSET_CLASSES, CATEGORIES, FAMILIES, METHOD, NAME_WORDS, NOT_TICKERS, NUMERIC, PATTERNS, TRIGGERS
from fundloom.operators.tables import table_entities

#: Places that are passed on at once.
PLACES = 20_000
#: A run of name characters from a line's start, the part of it up to the last name word, and the capitalised words behind that.
_RUN = re.compile(r"(?:^|\n)([A-Z][A-Za-z\s&.']++)", re.ASCII | re.MULTILINE)
_UPTO = re.compile(rf"[A-Z].+(?:{NAME_WORDS})", re.ASCII | re.DOTALL)
_MORE = re.compile(r"(?:\s++[A-Z][a-z]++)*+", re.ASCII)

#: Fixed values: (entity type, field, category, confidence, characters before and behind) of the words of a list.
LISTS = {
    "category": ("category", "CategoryName", "classification", 0.85, 20, 20),
    "fund_family": ("fund_family", "FundFamily", "descriptive", 0.92, 10, 10),
    "asset_class": ("asset_class", "GlobalAssetClassId", "classification", 0.75, 20, 20),
}
#: What a place is found by: each pattern, then each list.
RULES = [p[:6] for p in PATTERNS] + list(LISTS.values())
_LISTED = [[(w, w.lower()) for w in words] for words in (CATEGORIES, FAMILIES)]


def number(text: Column) -> Column:
    """The number without thousands separators; null where it is none."""
    return F.regexp_replace(text, ",", "").try_cast("double")


def _names(text: str) -> Iterator[tuple]:
    for run in _RUN.finditer(text):
        if upto := _UPTO.match(run[1]):
            name = run[1][: _MORE.match(run[1], upto.end()).end()]
            yield run.start(), run.start(1) + len(name), name, None


def _words(text: str, low: str) -> Iterator[tuple]:
    """(rule, start, end, word) of the listed words that the text holds, each at its first place; of a class the first of its words."""
    first = len(PATTERNS)
    for k, words in enumerate(_LISTED):
        for word, own in words:
            if (at := low.find(own)) >= 0:
                yield first + k, at, at + len(word), word
    for name, words in ASSET_CLASSES.items():
        for own in words:
            if (at := low.find(own)) >= 0:
                yield first + 2, at, at + len(own), name
                break


def finder(kinds: set[str] | None) -> list[tuple[int, re.Pattern | None, tuple[str, ...]]]:
    """(rule, pattern, words of which a text must hold one) of the kinds; all by default. Names have no single pattern."""
    return [(k, re.compile(p[-1], re.ASCII) if p[-1] else None, TRIGGERS.get(p[0], ())) for k, p in enumerate(PATTERNS) if kinds is None or p[0] in kinds]


def places(text: str, rules: list[tuple[int, re.Pattern | None, tuple[str, ...]]], listed: bool) -> Iterator[tuple]:
    """(rule, start, end, first group, second group) in the order in which entities count; offsets in characters."""
    low = text.lower()
    for k, pattern, words in rules:
        if words and not any(w in low for w in words):
            continue
        if pattern is None:
            yield from ((k, *found) for found in _names(text))
            continue
        second = pattern.groups > 1
        for m in pattern.finditer(text):
            yield k, m.start(), m.end(), m[1], m[2] if second else None
    if listed:
        # A letter whose lower-case form is longer moves what stands behind it: offsets are then those of the lowered text.
        yield from ((*found, None) for found in _words(text, low))


def find(docs: DataFrame, kinds: set[str] | None = None) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, seq, rule, start, end, g1, g2, source_text): a row per place."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    listed = kinds is None or bool(kinds & {"fund_family", "asset_class"})
    shape = f"doc_id {id_type}, seq long, rule int, start int, end int, g1 string, g2 string, source_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = finder(kinds)
        columns: list[list] = [[] for _ in range(8)]

        def told(own: pa.DataType) -> pa.RecordBatch:
            types = (own, pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "seq", "rule", "start", "end", "g1", "g2", "source_text"])

        for batch in batches:
            own = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                for seq, (rule, start, end, g1, g2) in enumerate(places(text, rules, listed)):
                    begin = max(0, start - RULES[rule][4])
                    for column, value in zip(columns, (doc_id, seq, rule, start, end, g1, g2, text[begin : end + RULES[rule][5]]), strict=True):
                        column.append(value)
                    if len(columns[0]) >= PLACES:
                        yield told(own)
                        columns = [[] for _ in range(8)]
            if columns[0]:
                yield told(own)
                columns = [[] for _ in range(8)]

    return docs.where("text is not null").select("doc_id", "text").mapInArrow(run, shape)


def _of_rule(k: int) -> Column:
    """A rule's value by its number."""
    return F.element_at(F.array(*[F.lit(r[k]) for r in RULES]), F.col("rule") + 1)


def text_entities(docs: DataFrame, kinds: set[str] | None = None) -> DataFrame:
    """docs (doc_id, text) -> a row per entity with seq; kinds: only these patterns. Numbers that can't be read, words that are no tickers and ratings in numerals give none."""
    found = find(docs, kinds).withColumn("entity_type", _of_rule(0))
    kind, g1, g2, listed = F.col("entity_type"), F.col("g1"), F.col("g2"), F.col("rule") >= len(PATTERNS)
    num = F.when(kind.isin(*NUMERIC), number(g1) * F.when((kind == "total_assets") & (F.upper(F.left(g2, F.lit(1))) == "B"), 1000.0).otherwise(1.0)).when(kind == "star_rating", F.length(g2).cast("double"))
    known = F.array(*[F.lit(c) for c in CATEGORIES])
    labelled = (kind == "category") & ~listed
    label = F.trim(g1)
    near = F.get(F.filter(known, lambda c: F.contains(F.lower(label), F.lower(c)) | F.contains(F.lower(c), F.lower(label))), 0)
    shown = F.when(kind.isin(*NUMERIC), F.col("value_num").cast("string")).when(kind == "star_rating", F.length(g2).cast("string")).when(kind == "currency", F.upper(g1)).when(labelled, near).when(kind == "fund_name", F.trim(g1)).otherwise(g1)
    value = (
        F.when(kind == "total_assets", F.concat(F.lit("$"), g1, F.lit(" "), g2)).when(kind == "nav", F.concat(F.lit("$"), g1)).when(kind.isin("expense_ratio", "yield"), F.concat(g1, F.lit("%")))
        .when(kind == "star_rating", g2).when(labelled, label).when(kind == "fund_name", F.trim(g1)).otherwise(g1)
    )
    found = found.withColumn("value_num", num).withColumn("value_str", shown)
    kept = F.when(kind.isin(*NUMERIC), F.col("value_num").isNotNull()).when(kind == "star_rating", F.coalesce(g2 != "", F.lit(False))).when(kind == "fund_name", F.length(F.trim(g1)) > 10).otherwise(F.col("value_str").isNotNull())
    in_brackets = F.col("rule") == next(k for k, p in enumerate(PATTERNS) if p[0] == "ticker")
    kept = kept & ~(in_brackets & g1.isin(*NOT_TICKERS))
    return found.where(kept).select(
        "doc_id", "seq", "entity_type", _of_rule(1).alias("mapped_field"), _of_rule(2).alias("category"), _of_rule(3).cast("double").alias("confidence"), value.alias("value"), "value_str", "value_num", "source_text", "start", "end", F.lit(METHOD).alias("method")
    )


def all_entities(docs: DataFrame, tables: DataFrame) -> DataFrame:
    """Entities of the texts of docs (doc_id, text), and behind them those of their tables (doc_id, tbl, title, rows)."""
    behind = table_entities(tables).withColumn("seq", F.col("seq") + 2**40)
    return text_entities(docs).unionByName(behind)
