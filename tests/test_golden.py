"""One page of two funds and six tables, from HTML to the mapped records, against figures worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from fundloom.functions.catalog import FIELDS
from fundloom.operators import export, extract, mapping, normalize, relational
from fundloom.plans.queries import page_tables
from fundloom.sources import html

PERIODS = ["1 Month", "3 Month", "YTD", "1 Year", "3 Year", "5 Year", "10 Year"]


def table(title: str, head: list[str], rows: list[list[str]]) -> str:
    cells = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows)
    return f"<h3>{title}</h3><table><thead><tr>{''.join(f'<th>{c}</th>' for c in head)}</tr></thead><tbody>{cells}</tbody></table>"


def returns(values: list[str]) -> str:
    return table("performance of both", ["span", "own"], [[p, v] for p, v in zip(PERIODS, values, strict=True)])


PAGE = (
    "<html><head><title>two funds</title></head><body><h1>a report on two funds</h1>"
    "<h2>Harbor Blue Index Fund (HBLUX)</h2><p>ISIN: US1111111110 | CUSIP: 111111111 | Inception Date: March 5, 1999</p>"
    "<p>Base Currency: EUR | Category: Large Value</p><p>NAV: $12.50</p><p>Total Net Assets: $3.5 Billion | Expense Ratio: 0.25% | SEC Yield: 1.75%</p>"
    "<p>Rating: ★★★ | Analyst Rating: Silver</p><p>managed by PIMCO</p>"
    + returns(["1.1%", "2.2%", "3.3%", "4.4%", "5.5%", "6.6%", "7.7%"])
    + table("risk", ["name", "own"], [["Standard Deviation", "11.5"], ["Sharpe Ratio", "0.7"], ["Beta", "0.9"], ["Alpha", "-0.2"], ["R-Squared", "88"]])
    + table("top names", ["no", "name", "sign", "field", "part"], [["1", "Oak Mills", "OAK", "Industry", "6.5"], ["2", "Elm Works", "ELM.A", "Industry", "5.5"]])
    + table("sector", ["name", "own"], [["Industry", "60.5"], ["Farms", "39.5"]])
    + "<h2>Harbor Green Bond Fund (HGRNX)</h2><p>ISIN: US2222222220 | CUSIP: 222222222 | Inception Date: April 6, 2001</p>"
    + returns(["-1.1%", "-2.2%", "-3.3%", "-4.4%", "-5.5%", "-6.6%", "-7.7%"])
    + table("risk", ["name", "own"], [["Standard Deviation", "4.5"], ["Sharpe Ratio", "-0.3"]])
    + "</body></html>"
)


@pytest.fixture(scope="module")
def parsed(spark):
    return html.parse_pages(spark.createDataFrame([(1, "http://h/p", PAGE)], "page_id long, url string, html string"))


@pytest.fixture(scope="module")
def found(parsed):
    return extract.all_entities(parsed.select(F.col("page_id").alias("doc_id"), "text"), page_tables(parsed))


def test_tables_of_the_page(parsed):
    got = [(t.title, len(t.headers), len(t.rows)) for t in page_tables(parsed).orderBy("tbl").collect()]
    assert got == [("performance of both", 2, 7), ("risk", 2, 5), ("top names", 5, 2), ("sector", 2, 2), ("performance of both", 2, 7), ("risk", 2, 2)]


def test_entities(found):
    values = {}
    for r in relational.keep_best(found).orderBy("seq").collect():
        values.setdefault(r.entity_type, []).append(r.value_str)
    want = {
        "isin": ["US1111111110", "US2222222220"], "cusip": ["111111111", "222222222"], "ticker": ["HBLUX", "HGRNX"], "nav": ["12.5"], "expense_ratio": ["0.25"], "yield": ["1.75"], "total_assets": ["3500.0"],
        "star_rating": ["3"], "analyst_rating": ["Silver"], "inception_date": ["March 5, 1999", "April 6, 2001"], "currency": ["EUR"], "fund_family": ["PIMCO"],
        "standard_deviation": ["11.5", "4.5"], "sharpe_ratio": ["0.7", "-0.3"], "beta": ["0.9"], "alpha": ["-0.2"], "r_squared": ["88.0"], "return_1m": ["1.1", "-1.1"], "return_10y": ["7.7", "-7.7"],
    }
    assert {k: values.get(k) for k in want} == want
    assert values["category"][0] == "Large Value" and len(values["top_holdings"]) == len(values["sector_allocation"]) == 1


def test_records_scores_and_mapping(spark, found):
    rows = normalize.records(normalize.segment(relational.confident(relational.keep_best(found))))
    one, two = rows.orderBy("security_id").collect()
    # A security begins at its ISIN. All that is said once, and tables, stand behind the second; its first values win.
    assert (one.ISIN, one.BaseCurrency, one.LegalName, one.NAV) == ("US1111111110", "USD", None, None)
    assert (two.ISIN, two.CUSIP, two.Ticker, two.LegalName) == ("US2222222220", "111111111", "HBLUX", "Harbor Blue Index Fund")
    assert (two.InceptionDate, two.BaseCurrency, two.NAV, two.TotalNetAssets, two.ExpenseRatio, two.Yield, two.StarRating) == ("1999-03-05", "EUR", 12.5, 3500.0, 0.25, 1.75, 3)
    assert [two[f"Return_{p}"] for p in ("1M", "3M", "YTD", "1Y", "3Y", "5Y", "10Y")] == [1.1, 2.2, 3.3, 4.4, 5.5, 6.6, 7.7]
    assert (two.StandardDeviation_3Y, two.SharpeRatio_3Y, two.Beta_3Y, two.Alpha_3Y, two.RSquared_3Y) == (11.5, 0.7, 0.9, -0.2, 88.0)
    # The first number below 100 of a row is its weight: here its place.
    assert [tuple(h) for h in two.TopHoldings] == [("Oak Mills", "OAK", 1.0, "Industry"), ("Elm Works", "", 2.0, "Industry")]
    assert two.SectorWeights == {"Industry": 60.5, "Farms": 39.5}

    # The first has an ISIN and an id (5 points each) and a currency (3) of 100; the second all that is scored.
    assert [r.quality_score for r in normalize.quality(rows).orderBy("security_id").collect()] == [13.0, 100.0]
    (scores,) = normalize.doc_scores(rows).collect()
    # Of 18 fields the first has 3, the second all; one of two records has neither name nor ticker, of 3 and 30 values.
    assert (scores.n_records, scores.overall_quality, scores.completeness, scores.accuracy) == (2, 56.5, 58.3, 97.0)

    mapped = mapping.map_long(rows)
    assert {r.target_field for r in mapping.unmapped(mapped).collect()} == {"NAVDate", "StyleBox"}
    (cover,) = mapping.coverage(mapped).collect()
    assert (cover.mapped_fields, cover.coverage_pct, cover.n_errors, cover.passed) == (29, 93.5, 1, False)
    (errors,) = mapping.first_errors(mapped).collect()
    assert list(errors.errors) == ["Required field 'LegalName' is missing"]
    package = json.loads(export.packages(rows, stamp=F.lit("2025-01-01T00:00:00Z")).first().package)
    assert package["data_import"]["record_count"] == 2 and len(FIELDS) == 31
