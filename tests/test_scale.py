"""How work is dealt to tasks, and that pages are read as the standard library's parser reads them."""

import re

import pytest

from fundloom.functions.dealing import parts_of
from fundloom.operators import tables
from fundloom.plans.queries import QUERIES
from fundloom.sources import carrier, html
from fundloom.sources.carrier import fund_pages

SF = "/root/testdata/sf0.001"


def test_sheets_are_dealt_to_several_tasks(spark):
    seen = fund_pages(spark, SF).mapInArrow(lambda it: it, "page_id long, url string, html string").selectExpr("spark_partition_id() as p").distinct().count()
    assert seen == 4 and parts_of(spark, 10**6, 10_000) == 100 and parts_of(spark, 0, 10_000) == 1


@pytest.mark.parametrize(
    "page",
    ["<div>a<p>b &lt;c</p></DIV><br/>x", "<script>var a='</p>';</script><p>seen", "<style>p{}</STYLE><p>seen</p>", "<title>T &quot;x</title><h2>H</h2><table><tr><td>1</td></tr></table>", "<p>a < b</p>", "<noscript><a href=\"/x\">y</a></noscript><table><tr><td>1<noscript>2</noscript></td></tr></table>", "<!-- x --><td><td><h1>zz</h1></tr>", ""],
)
def test_plain_markup_is_read_as_by_the_parser(page, monkeypatch):
    quick = html.parse(page, "http://h/p")
    monkeypatch.setattr(html, "_plain_page", lambda _: None)
    assert html.parse(page, "http://h/p") == quick


def test_only_what_is_asked_is_made_in_small_batches(spark, monkeypatch):
    pages = spark.range(2500).selectExpr("id as page_id", "'http://h/p' as url", "concat('<p>page ', id, '</p>') as html").coalesce(1)
    read = html.parse_pages(pages, "text")
    assert read.columns == ["page_id", "url", "text"]
    sizes = read.mapInArrow(lambda it: (b.slice(0, 1) for b in it), read.schema).count()
    assert sizes >= 1 and read.where("text = concat('page ', page_id)").count() == 2500
    assert sorted(html.parse("<title>a</title>", "", ("title",))) == ["title"]


def test_titles_as_they_are_written(spark):
    got = html.parse_pages(spark.createDataFrame([(1, "u", "<title> a &amp; &quot;b&quot; </title>"), (2, "u", "x")], "page_id long, url string, html string"), "title", "title_source").orderBy("page_id").collect()
    assert [(r.title, r.title_source) for r in got] == [('a & "b"', "a &amp; &quot;b&quot;"), ("Untitled Page", "Untitled Page")]


def test_a_table_is_read_once(spark):
    rows = [["Energy", "10"], ["Health", "20"], ["Energy", "7"], ["x", "0"]]
    (r,) = tables.sectors(spark.createDataFrame([(1, 0, "Sector", rows)], "doc_id long, tbl int, title string, rows array<array<string>>")).collect()
    assert [tuple(s) for s in r.sectors] == [("Energy", 7.0), ("Health", 20.0)]
    plan = QUERIES["table_entities"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def _plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_cells_are_not_dealt_by_field(spark):
    plan = _plan(spark, "mapping_by_file")
    assert "SortMergeJoin" not in plan and "hashpartitioning(field" not in plan


def test_records_deal_their_entities_once(spark):
    plan = _plan(spark, "records_pivot")
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("REPARTITION_BY_NUM") == 2  # the parts and their entities
    assert _plan(spark, "page_text_entities").count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize(
    "name",
    ["export_coverage", "quality_band", "quality_score", "records_pivot", "sec_id", "export_csv_rows", "field_coverage", "completeness", "segment_securities", "segment_by_ticker", "segment_by_name", "dedup_keep_best"],
)
def test_a_task_sorts_no_more_entities_as_sheets_grow(spark, monkeypatch, name):
    monkeypatch.setattr(carrier, "AT_ONCE", 20)  # of 200 sheets, where the session shuffles to 4
    dealt = re.findall(r"Exchange hashpartitioning\((.*), (\d+)\), (\w+)", _plan(spark, name))
    if name == "field_coverage":
        del dealt[0]  # a task's sums of the 31 fields
    assert [d[1:] for d in dealt] == [("10", "REPARTITION_BY_NUM")] * 2  # the parts and their entities


def test_packages_are_made_of_records_made_once(spark):
    assert _plan(spark, "export_packages").count("MapInArrow") == 1


def test_files_are_hashed_in_several_tasks(spark, tmp_path):
    written, named = [], []
    frame = type(spark.range(1))
    coalesced = frame.coalesce
    try:
        frame.coalesce = lambda self, n: written.append(n) or coalesced(self, n)
        rows = QUERIES["records_pivot"](spark, SF)
        from fundloom.operators import export
        from fundloom.plans.queries import records

        base = export.write_files(records(spark, SF), str(tmp_path), name="run")
        named = spark.read.parquet(f"{base}/manifest").where("kind = 'csv'").collect()
    finally:
        frame.coalesce = coalesced
    assert not written and len(named) > 1 and rows.count() == 200 and export.verified(spark, base).where("not ok").isEmpty()
