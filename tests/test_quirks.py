"""Small inputs whose results are easily got wrong."""

import time

import pytest
from pyspark.sql import functions as F

from fundloom.operators import export, extract, incremental, mapping, normalize, relational, tables
from fundloom.sources.html import parse


@pytest.mark.parametrize(
    ("text", "kind", "want"),
    [
        ("Rating: 4 stars", "star_rating", []),
        ("Rating: ★★★", "star_rating", ["3"]),
        ("Net Asset Value (NAV): $5.00", "nav", []),
        ("NAV: $1,234.50", "nav", ["1234.5"]),
        ("NAV, total", "nav", []),
        ("number 5%", "expense_ratio", ["5.0"]),
        ("AUM: $2.5 B", "total_assets", ["2500.0"]),
        ("(FUND) (ABC)", "ticker", ["ABC"]),
        ("Ticker: and", "ticker", ["and"]),
        ("x\nAlpha Growth Fund Admiral\ny", "fund_name", ["Alpha Growth Fund Admiral"]),
    ],
)
def test_patterns(spark, text, kind, want):
    found = extract.text_entities(spark.createDataFrame([(1, text)], "doc_id long, text string"), {kind})
    assert [r.value_str for r in found.orderBy("seq").collect()] == want


def test_offsets_behind_an_astral_character(spark):
    (r,) = extract.text_entities(spark.createDataFrame([(1, "😀 US9229087690 ok")], "doc_id long, text string"), {"isin"}).collect()
    assert (r.start, r.end, r.source_text) == (2, 14, "😀 US9229087690 ok")


def test_keep_best_at_the_first_place(spark):
    rows = [(1, 0, "nav", "5", 0.88), (1, 1, "nav", "6", 0.9), (1, 2, "nav", "5", 0.9), (1, 3, "nav", "6", 0.9)]
    got = relational.keep_best(spark.createDataFrame(rows, "doc_id long, seq long, entity_type string, value_str string, confidence double"))
    assert sorted(map(tuple, got.select("seq", "value_str", "confidence").collect())) == [(0, "5", 0.9), (1, "6", 0.9)]


def test_dates(spark):
    rows = [("12/31/75", "1975-12-31"), ("3/1/05", "2005-03-01"), ("not a date", "not a date"), ("November 13, 2000", "2000-11-13"), ("2025-99-99", "2025-99-99"), ("1 May 2001", "2001-05-01")]
    got = spark.createDataFrame(rows, "v string, want string").select("want", normalize.date_text(F.col("v")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_a_blank_line_keeps_a_single_line_island(spark):
    pages = spark.createDataFrame([(1, 1, "Name  1.0  2.0\n\nOther  3.0  4.0\n\nplain words here today")], "doc_id long, page int, text string")
    (t,) = tables.text_tables(pages).collect()
    assert [list(r) for r in t.rows] == [["Name", "1.0", "2.0"], ["Other", "3.0", "4.0"]]


def test_links_and_tables_of_a_page():
    page = parse("<title> T </title><h2>Top Holdings</h2><table><tr><th>A<th></tr></table>" + "<a href='/x'>y</a>" * 60 + "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>", "http://h/p")
    assert page["title"] == "T" and len(page["links"]) == 50 and page["links"][0] == {"text": "y", "url": "http://h/x"}
    assert page["tables"][-1]["rows"][-1] == ["3", "None"]


def test_schema_files(spark, tmp_path):
    (tmp_path / "schema.json").write_text('{"fields": [{"field_name": "A", "data_type": "decimal", "required": true}, {"field_name": "B", "category": "fees"}]}')
    got = [(r.field, r.data_type, r.category, r.required) for r in mapping.load_schema(spark, str(tmp_path / "schema.json")).collect()]
    assert got == [("A", "decimal", "other", True), ("B", "string", "fees", False)]
    built_in = mapping.load_schema(spark).collect()
    assert mapping.load_schema(spark, str(tmp_path / "none.json")).collect() == built_in and len(built_in) == 31


def test_only_required_fields_make_errors(spark):
    rows = spark.createDataFrame([(1, "security_001", "F1", "bad", "A fund", "USD"), (2, "security_001", "F2", "US9229087690", None, "USD")], "doc_id long, security_id string, SecId string, ISIN string, LegalName string, BaseCurrency string")
    mapped = mapping.map_long(rows)
    by = {r.doc_id: r for r in mapping.coverage(mapped).collect()}
    assert (by[1].passed, by[1].n_errors, by[1].n_warnings) == (True, 0, 1) and (by[2].passed, by[2].n_errors) == (False, 1)
    assert [tuple(r) for r in mapping.first_errors(mapped).collect()] == [(2, ["Required field 'LegalName' is missing"])]
    schema = mapping.parse_schema(spark, '{"fields": [{"field_name": "ISIN", "required": true, "pattern": "^US"}]}')
    assert [r.error for r in mapping.map_long(rows, schema).orderBy("doc_id").collect()] == ["Required field 'ISIN': Does not match pattern ^US", None]


def test_a_hundred_thousand_matches(spark):
    text = "Beta: 1.5 " * 100_000
    began = time.time()
    (r,) = extract.text_entities(spark.createDataFrame([(1, text)], "doc_id long, text string"), {"beta"}).selectExpr("count(*) as n", "max(end) as last", "count(distinct seq) as seqs").collect()
    assert (r.n, r["last"], r.seqs) == (100_000, len(text) - 1, 100_000) and time.time() - began < 30


def test_a_second_run_extracts_from_changed_texts_only(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"ISIN: US922908769{k % 3}") for k in range(6)] + [(9, None), (8, "none")], "doc_id long, text string")
    assert {r.doc_id: r.redone for r in incremental.update(docs, str(tmp_path)).collect()} == dict.fromkeys([*range(6), 8], True)
    before = spark.read.parquet(f"{tmp_path}/entities").count()
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 4, "ISIN: IE0000000017").otherwise(F.col("text")))
    assert {r.doc_id for r in incremental.update(changed, str(tmp_path)).where("redone").collect()} == {4}
    assert before == 3 and spark.read.parquet(f"{tmp_path}/entities").count() == before + 1
    got = incremental.entities(changed, str(tmp_path)).drop("method").orderBy("doc_id", "seq").collect()
    assert got == extract.text_entities(changed).select(*[c for c in got[0].asDict()]).orderBy("doc_id", "seq").collect()


def test_tables_are_numbered_through_the_pages(spark):
    two = "a  1  2\nb  3  4\n\nwords here only\nc  5  US9229087690  6\nd  7  8"
    pages = spark.createDataFrame([(1, 2, two), (1, 1, "x  1  2\ny  3  4")], "doc_id long, page int, text string")
    got = [(r.page, r.tbl) for r in tables.document_tables(pages).orderBy("tbl").collect()]
    assert got == [(1, 0), (2, 1), (2, 2)]
    (e,) = tables.table_entities(tables.document_tables(pages)).collect()
    assert (e.entity_type, e.value, e.seq >> 32) == ("isin", "US9229087690", 2)


def test_a_changed_file_is_found(spark, tmp_path):
    rows = normalize.records(normalize.segment(extract.text_entities(spark.createDataFrame([(1, "ISIN: US9229087690, NAV: $2.50")], "doc_id long, text string"))))
    base = export.write_files(rows, str(tmp_path), name="run")
    assert export.verified(spark, base).where("not ok").count() == 0 and dict(export.read_csv(spark, base).dtypes)["NAV"] == "double"
    assert export.json_preview(spark, base).first().n == 1
    next((tmp_path / "run" / "csv").glob("part-*")).write_text("SecId\nx\n")
    with pytest.raises(Exception, match="differ from its manifest|checksum|Checksum"):
        export.read_csv(spark, base).collect()


def test_numbers_in_page_text(spark):
    tokens = {"1,000": True, "nan": True, "inf": True, "1_000": True, "1__0": False, "1e5": True, "(3.5)": True, "$": False, "12d": False, ".5": True, "5.": True, "1.2.3": False, "": False, "Infinity": True}
    df = spark.createDataFrame(list(tokens.items()), "t string, want boolean")
    assert all(r.want == r.got for r in df.select("t", "want", tables.is_number(F.col("t")).alias("got")).collect())


def test_missing_values_stay_missing(spark):
    rows = [(1, 0, "nav", "NAV", "5.0", 5.0, 0.9, "rule_based"), (1, 1, "r", "Return_1Y", "3.25%", None, 0.9, "table_extraction"), (1, 2, "s", "StarRating", "★★", None, 0.9, "rule_based")]
    found = spark.createDataFrame(rows, "doc_id long, seq long, entity_type string, mapped_field string, value_str string, value_num double, confidence double, method string")
    (r,) = normalize.records(normalize.segment(found)).collect()
    assert (r.NAV, r.Return_1Y, r.StarRating, r.BaseCurrency, r.SecId, r.ISIN) == (5.0, 3.25, 2, "USD", "F00000000", None)
    assert r.methods == ["rule_based", "table_extraction"] and r.fields_present == ["SecId", "BaseCurrency", "NAV", "Return_1Y", "StarRating"]
    (r,) = normalize.records(normalize.segment(found.where("entity_type = 'nav'"))).collect()
    assert r.StarRating is None and r.entity_count == 1
