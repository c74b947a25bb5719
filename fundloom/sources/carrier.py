"""Fact sheets rendered from the part table, the same in Spark and DuckDB: as text, and as web pages with tables.

Names, categories, families and ratings vary, and most fields are missing from some sheets, so that absent values,
defaults, rejected words, months that no date has and ratings that the schema doesn't allow occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundloom.functions.dealing import dealt, parts_of


def _pick(expression: str, values: list[str]) -> str:
    cases = " ".join(f"when {k} then '{v}'" for k, v in enumerate(values[:-1]))
    return f"case {expression} {cases} else '{values[-1]}' end"


NAMES = ["Acme Index Fund", "Vanguard Growth Trust", "Northern Stock Portfolio", "Pacific Bond ETF", "the Core Equity Fund", "Harbor Income Shares"]
LABELS = ["Large Blend", "Foreign Large Growth", "Small Value", "Technology", "Money Market - Taxable", "Unknown Style", "Real Estate"]
MANAGERS = ["Vanguard", "Fidelity and T. Rowe Price", "their own advisers", "John Hancock"]


def _values(text: str, div: str) -> dict[str, str]:
    s = lambda x: f"cast({x} as {text})"
    letters = f"translate(lpad({s('p_partkey')},5,'0'),'0123456789','BCDFGHJKLM')"
    some = lambda condition, value: f"case when {condition} then {value} else '' end"
    return {
        "name": f"concat({_pick('p_partkey % 6', NAMES)}, {some('p_partkey % 11 <> 0', f"concat(' (', {letters}, ')')")})",
        "ids": f"""concat('ISIN: US', lpad({s("p_partkey")},9,'0'), {s("p_partkey % 10")}, {some("p_partkey % 5 <> 0", f"concat(' | CUSIP: ', lpad({s('p_partkey')},9,'0'))")},
             {some("p_partkey % 7 <> 0", f"concat(' | Inception Date: ', case when p_partkey % 9 = 4 then {s('13 + p_partkey % 15')} else {s('1 + p_partkey % 12')} end, '/', {s('1 + p_partkey % 28')}, '/', {s('1980 + p_partkey % 45')})")})""",
        "nav": f"""concat('NAV: $', {s(f"cents {div} 100")}, '.', lpad({s("cents % 100")},2,'0'))""",
        "size": f"""concat('Total Net Assets: $', {s("1 + p_partkey % 900")}, case when p_partkey % 3 = 0 then ' Billion' else ' Million' end,
             {some("p_partkey % 4 <> 1", f"concat(' | Expense Ratio: 0.', lpad({s('p_partkey % 100')},2,'0'), '%')")}, {some("p_size % 3 <> 0", f"concat(' | SEC Yield: ', {s('p_size % 8')}, '.25%')")})""",
        "rating": f"""concat('Rating: ', case when p_size % 4 = 3 then '4 stars' else repeat('★', cast(1 + p_size % 5 as int)) end, ' | Analyst Rating: ', {_pick("p_size % 5", ["Gold", "Silver", "Neutral", "pending", "gold"])})""",
        "style": f"""concat({some("p_partkey % 6 <> 2", f"concat('Base Currency: ', {_pick('p_size % 3', ['EUR', 'usd', 'GBP'])}, ' | ')")}, 'Category: ', {_pick("p_partkey % 7", LABELS)},
             ' | Beta: 1.', {s("p_size % 10")}, ' | Alpha: -0.', {s("p_size % 7")})""",
        "risk": f"""case when p_partkey % 3 = 1 then concat('Std. Dev.: 1', {s("p_size % 9")}, '.', {s("p_partkey % 10")}, ' | Sharpe Ratio: -0.', {s("p_size % 9")}) end""",
        "symbol": f"case when p_partkey % 11 = 0 and p_partkey % 4 = 0 then concat('Symbol: ', substr({letters}, 3, 3)) end",
        "manager": f"concat('Managed by ', {_pick('p_partkey % 4', MANAGERS)})",
    }


LINES = ["name", "ids", "nav", "size", "rating", "style", "risk", "symbol", "manager"]


def _render(text: str, div: str, source: str) -> str:
    v = _values(text, div)
    return f"select p_partkey as doc_id, concat_ws(chr(10), {', '.join(v[k] for k in LINES)}) as text from (select *, cast(round(p_retailprice*100) as bigint) as cents from {source}) t"


def _render_pages(text: str, div: str, source: str) -> str:
    v = _values(text, div)
    s = lambda x: f"cast({x} as {text})"
    row = lambda *cells: "concat('<tr>', " + ", ".join(f"'<td>', {c}, '</td>'" for c in cells) + ", '</tr>')"
    head = lambda *cells: "'<thead><tr>" + "".join(f"<th>{c}</th>" for c in cells) + "</tr></thead>'"
    paragraphs = ", ".join(f"concat('<p>', {v[k]}, '</p>')" for k in LINES[1:6])
    return f"""select p_partkey as page_id, 'http://funds.test/sheet' as url, concat(
      '<html><head><title> Sheet ', {s("p_partkey")}, ' </title><meta name="author" content="desk ', {s("p_size % 9")}, '"><meta property="og:type" content="fund"><meta name="author" content="last"><style>NAV: 1</style></head><body><h1>',
      {v["name"]}, '</h1>', concat_ws('', {paragraphs}), '<script>var x = "Beta: 9.9";</script><a href="/more?', {s("p_partkey")}, '">More</a><a href="ftp://x">files</a>',
      '<h2>Performance Returns</h2><table>', {head("Period", "Fund", "Rank")}, '<tbody>',
      {row("'1 Year'", f"concat({s('p_size')}, '.5%')", "'7'")}, {row("'3 Year'", f"concat('-', {s('p_size')}, '.25')", "'9'")},
      case when p_size % 2 = 0 then {row("'YTD'", f"{s('p_size % 10')}", "'1'")} else '' end, '</tbody></table>',
      '<h2>Top Holdings</h2><table>', {head("#", "Name", "Symbol", "Sector", "Weight")}, '<tbody>',
      {row("'1'", "'Alpha Works'", "'ALW'", "'Technology'", f"{s('p_size')}")}, {row("'2'", "'Beta Mills'", "''", "'Industry and more'", "'3.5'")}, {row("'300'", "'none'", "'XYZ'", "''", "''")}, '</tbody></table>',
      '<h3>Risk Statistics</h3><table><tr><th>Measure</th><th>Value</th></tr>', {row("'Standard Deviation'", f"concat('1', {s('p_size % 10')}, '.5')")}, {row("'Sharpe Ratio'", "'0.8'")},
      {row("'R-Squared'", f"{s('90 + p_size % 10')}")}, '</table>',
      '<h2>Sector Allocation</h2><table>', {head("Sector", "Share")}, {row("'Energy'", f"concat({s('p_size % 50 + 1')}, '.5')")}, {row("'Health'", "'20'")}, {row("'Energy'", "'7'")}, '</table>',
      '<h2>Other classes</h2><table>', {row("'B class'", f"concat('IE', lpad({s('p_partkey')},9,'0'), '7')")}, {row("'C class'", "'none'")}, '</table></body></html>') as html
    from (select *, cast(round(p_retailprice*100) as bigint) as cents from {source}) t"""


DUCKDB = _render("varchar", "//", "part")
DUCKDB_PAGES = _render_pages("varchar", "//", "part")


#: Parts in a task.
AT_ONCE = 10_000


def parts_of_sheets(spark: SparkSession, sf_dir: str) -> int:
    """Tasks to which sheets are dealt; the rows are counted by the footers of the files."""
    return parts_of(spark, spark.read.parquet(f"{sf_dir}/part.parquet").count(), AT_ONCE)


def _parts(spark: SparkSession, sf_dir: str, key: str = "p_partkey") -> DataFrame:
    """The part table dealt by key: all later steps group by it, and a small file would be one task."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", "p_retailprice")
    return dealt(parts, parts_of_sheets(spark, sf_dir), F.expr(key))


def fund_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): one fact sheet per part."""
    return spark.sql(_render("string", "div", "{part}"), part=_parts(spark, sf_dir))


def fund_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html): one web page per part, with tables."""
    return spark.sql(_render_pages("string", "div", "{part}"), part=_parts(spark, sf_dir))


def fund_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): two fact sheets in a document. Parts are dealt by document, so that no task gathers more texts as the input grows."""
    one = spark.sql(_render("string", "div", "{part}"), part=_parts(spark, sf_dir, "p_partkey div 2"))
    pairs = one.groupBy(F.expr("doc_id div 2").alias("d")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("x"))
    return pairs.select(F.col("d").alias("doc_id"), F.array_join(F.transform("x", lambda r: r["text"]), "\n").alias("text"))


DUCKDB_PAIRS = f"select doc_id // 2 as doc_id, string_agg(text, chr(10) order by doc_id) as text from ({DUCKDB}) group by 1"
