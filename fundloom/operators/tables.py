"""Tables: found in page text by gaps and islands, and read for returns, holdings, risk figures, sectors and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundloom.functions.catalog import NOT_TICKERS, PERIODS

_DIGITS = r"[0-9]+(?:_[0-9]+)*"
#: What reads as a number: digits with single underscores between them, a point, an exponent, or a word for infinity or no number.
NUMBER = rf"(?i)^(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e{_DIGITS})?|inf|infinity|nan)$"


def is_number(token: Column) -> Column:
    return F.translate(token, ",%$()-+", "").rlike(NUMBER)


def text_tables(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, text) -> (doc_id, page, tbl, headers, rows): runs of lines with numbers, cut at two or more blanks.

    A line with two numbers begins a table; lines with a number or two words go on; a blank line ends one that has
    more than one line. The fold over a page's lines is exact and stays in its row.
    """
    state = "struct<inside:boolean,cur:array<string>,out:array<array<string>>>"
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("cur"), F.array().cast("array<array<string>>").alias("out")).cast(state)

    def flush(s: Column) -> Column:
        return F.when(F.size(s["cur"]) > 1, F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"])

    def step(s: Column, x: Column) -> Column:
        line, tokens, numbers = x["line"], x["tokens"], x["numbers"]
        empty = F.array().cast("array<string>")
        new = lambda inside, cur, out: F.struct(inside.alias("inside"), cur.alias("cur"), out.alias("out")).cast(state)
        more = F.concat(s["cur"], F.array(line))
        return (
            F.when(tokens == 0, F.when(F.size(s["cur"]) > 1, new(F.lit(False), empty, flush(s))).otherwise(s))
            .when(numbers >= 2, new(F.lit(True), more, s["out"]))
            .when(s["inside"] & ((numbers >= 1) | (tokens >= 2)), new(F.lit(True), more, s["out"]))
            .otherwise(new(F.lit(False), empty, flush(s)))
        )

    # Each line is cut and its numbers are counted once, not at each question of the fold.
    cut = F.transform(F.split("text", "\n"), lambda line: F.struct(line.alias("line"), F.split(F.trim(line), r"\s+").alias("t")))
    lines = F.transform(cut, lambda x: F.struct(x["line"].alias("line"), F.size(F.filter(x["t"], lambda t: t != "")).alias("tokens"), F.size(F.filter(x["t"], is_number)).alias("numbers")))
    islands = F.aggregate(lines, start, step, flush)
    found = pages.select("doc_id", "page", F.posexplode(islands).alias("tbl", "lines"))
    cells = F.filter(F.transform("lines", lambda x: F.filter(F.split(F.trim(x), r"\s{2,}"), lambda c: c != "")), lambda r: F.size(r) >= 2)
    found = found.select("doc_id", "page", "tbl", cells.alias("rows")).where(F.size("rows") >= 2)
    width = F.array_max(F.transform("rows", F.size))
    found = found.withColumn("n", width).withColumn("rows", F.transform("rows", lambda r: F.concat(r, F.array_repeat(F.lit(""), F.col("n") - F.size(r)))))
    words = F.size(F.filter(F.get("rows", 0), lambda c: ~is_number(c)))
    head = words > F.floor(F.col("n") / 2)
    headers = F.when(head, F.get("rows", 0)).otherwise(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: k.cast("string")))
    return found.select("doc_id", "page", "tbl", headers.alias("headers"), F.when(head, F.slice("rows", 2, F.size("rows"))).otherwise(F.col("rows")).alias("rows"))


def document_tables(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, text) -> (doc_id, page, tbl, title, headers, rows): the tables of a document's pages, numbered through all of them. Page text gives them no title."""
    found = text_tables(pages)
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "tbl")) - 1
    return found.select("doc_id", "page", nth.cast("int").alias("tbl"), F.lit(None).cast("string").alias("title"), "headers", "rows")


METRICS = {
    "standard deviation": ("standard_deviation", "StandardDeviation_3Y"), "sharpe ratio": ("sharpe_ratio", "SharpeRatio_3Y"), "beta": ("beta", "Beta_3Y"), "alpha": ("alpha", "Alpha_3Y"), "r-squared": ("r_squared", "RSquared_3Y"),
}
#: Kinds of tables and the words of a title that tell them, in order; other tables are generic.
ROUTES = {"performance": ("performance", "return"), "holdings": ("holding", "portfolio", "top"), "risk": ("risk", "metric", "statistic"), "sectors": ("sector", "allocation", "weight")}
HOLDINGS = "array<struct<SecurityName:string,Ticker:string,Weight:double,Sector:string>>"


def routed(tables: DataFrame) -> DataFrame:
    """tables (doc_id, tbl, title, rows) with kind; a table without a title is Table and its number."""
    title = F.coalesce("title", F.concat(F.lit("Table "), (F.col("tbl") + 1).cast("string")))
    kind = F.lit(None).cast("string")
    for name, words in ROUTES.items():
        held = F.lit(False)
        for w in words:
            held = held | F.contains(F.lower(title), F.lit(w))
        kind = F.coalesce(kind, F.when(held, name))
    return tables.select("doc_id", "tbl", title.alias("title"), "rows", F.coalesce(kind, F.lit("generic")).alias("kind"))


def _cells(tables: DataFrame) -> DataFrame:
    """tables with the cells of their rows trimmed; a missing one is None."""
    return tables.withColumn("rows", F.transform("rows", lambda r: F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("None"))))))


def _figures() -> Column:
    """Returns, risk figures and ids of a row (title, kind, cells), an entity each."""
    low = F.lower(F.array_join("cells", " "))
    first = lambda pattern: F.regexp_extract(F.get(F.filter("cells", lambda c: c.rlike(pattern)), 0), pattern, 1)
    share, plain = first(r"^(-?[0-9.]+)\s*%?$"), first(r"^(-?[0-9.]+)$")
    source = F.concat(F.col("title"), F.lit(": "), F.array_join("cells", " | "))

    def item(kind: str, field: str, category: str, value: Column, shown: Column, num: Column, source: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("entity_type"), F.lit(field).alias("mapped_field"), F.lit(category).alias("category"), F.lit(0.90).alias("confidence"),
            value.alias("value"), shown.alias("value_str"), num.cast("double").alias("value_num"), source.alias("source_text"),
        )

    def figure(kind: str, field: str, category: str, text: Column, value: Column, on: Column) -> Column:
        num = text.try_cast("double")
        return F.when(on & num.isNotNull(), item(kind, field, category, value, num.cast("string"), num, source))

    percent = F.concat(share, F.lit("%"))
    found = [figure(f"return_{p.lower()}", f"Return_{p}", "performance", share, percent, (F.col("kind") == "performance") & F.contains(low, F.lit(key))) for key, p in PERIODS]
    found += [figure(t, f, "risk", plain, plain, (F.col("kind") == "risk") & F.contains(low, F.lit(key))) for key, (t, f) in METRICS.items()]
    ids = F.when(F.col("kind") == "generic", F.filter("cells", lambda c: c.rlike(r"^[A-Z]{2}[A-Z0-9]{9}[0-9]$"))).otherwise(F.array().cast("array<string>"))
    ids = F.transform(ids, lambda c: item("isin", "ISIN", "identifiers", c, c, F.lit(None), F.array_join("cells", " ")))
    return F.array_compact(F.concat(F.array(*found), ids))


def holdings(tables: DataFrame) -> DataFrame:
    """(doc_id, tbl, title, holdings) of the holdings tables: the rows with a name and a weight.

    A row's ticker is its last cell of one to five capitals, its weight the first number below 100, its name the
    first longer cell with a small letter, its sector the last such cell behind the name.
    """
    read = _cells(routed(tables).where("kind = 'holdings'")).select("doc_id", "tbl", "title", _held().alias("holdings"))
    return read.where(F.size("holdings") > 0)


def _held() -> Column:
    """The holdings of a table's rows."""
    ticker = lambda c: c.rlike("^[A-Z]{1,5}$") & ~c.isin(NOT_TICKERS)
    weight = lambda c: c.rlike(r"^[0-9.]+$") & (c.try_cast("double") < 100)

    def held(cells: Column) -> Column:
        names = F.filter(cells, lambda c: ~ticker(c) & ~F.coalesce(weight(c), F.lit(False)) & (F.length(c) > 5) & c.rlike("[a-z]"))
        return F.struct(
            F.get(names, 0).alias("SecurityName"), F.coalesce(F.try_element_at(F.filter(cells, ticker), F.lit(-1)), F.lit("")).alias("Ticker"), F.get(F.filter(cells, weight), 0).try_cast("double").alias("Weight"),
            F.when(F.size(names) > 1, F.try_element_at(names, F.lit(-1))).otherwise("").alias("Sector"),
        )

    return F.filter(F.transform("rows", held), lambda h: h["SecurityName"].isNotNull() & (h["Weight"] != 0))


def sectors(tables: DataFrame) -> DataFrame:
    """(doc_id, tbl, title, sectors array of (name, weight)) of the sector tables; a repeated name keeps its place and takes the later weight."""
    read = _cells(routed(tables).where("kind = 'sectors'")).select("doc_id", "tbl", "title", _weights().alias("w"))
    return read.select("doc_id", "tbl", "title", _last_weights("w").alias("sectors")).where(F.size("sectors") > 0)


def _weights() -> Column:
    """(name, row, weight) of a table's rows, in that order."""
    number = lambda c: c.rlike(r"^[0-9.]+$")
    name = lambda cells: F.get(F.filter(cells, lambda c: ~number(c) & (F.length(c) > 2) & c.rlike(r"\p{L}")), 0)
    read = F.transform("rows", lambda cells, row: F.struct(name(cells).alias("name"), row.alias("row"), F.get(F.filter(cells, number), 0).try_cast("double").alias("weight")))
    return F.array_sort(F.filter(read, lambda x: x["name"].isNotNull() & (x["weight"] != 0)))


def _last_weights(w: str) -> Column:
    """(name, weight) of a column of _weights: of each name its first row, which gives the place, and its last, which gives the weight."""
    neighbour = lambda k: F.get(F.col(w), k)["name"]
    first = F.filter(w, lambda x, k: (k == 0) | (neighbour(k - 1) != x["name"]))
    last = F.filter(w, lambda x, k: (k == F.size(w) - 1) | (neighbour(k + 1) != x["name"]))
    placed = F.array_sort(F.zip_with(first, last, lambda a, b: F.struct(a["row"].alias("row"), a["name"].alias("name"), b["weight"].alias("weight"))))
    return F.transform(placed, lambda x: F.struct(x["name"].alias("name"), x["weight"].alias("weight")))


def table_entities(tables: DataFrame) -> DataFrame:
    """tables (doc_id, tbl, title, rows array<array<string>>) -> entities like those of text, seq by table, row and place in it.

    Lists of holdings and maps of sectors have their JSON form as value_str.
    """
    read = _cells(routed(tables)).select("*", F.when(F.col("kind") == "holdings", _held()).alias("holdings"), F.when(F.col("kind") == "sectors", _weights()).alias("w"))
    read = read.select("*", F.when(F.col("kind") == "sectors", _last_weights("w")).alias("sectors"))

    def unit(row: Column, cells: Column, n: Column | None = None, shown: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(row.alias("row"), cells.alias("cells"), (none if n is None else n).alias("n"), (none if shown is None else shown).alias("shown"))

    def listed(column: str, shown: Column) -> Column:
        one = unit(F.lit(0), F.lit(None).cast("array<string>"), F.concat(F.size(column).cast("string"), F.lit(f" {column}")), shown)
        return F.when(F.size(column) > 0, F.array(one))

    def item(kind: str, field: str, category: str, confidence: float) -> Column:
        said = F.concat("title", F.lit(": "), "n")
        return F.array(F.struct(
            F.lit(kind).alias("entity_type"), F.lit(field).alias("mapped_field"), F.lit(category).alias("category"), F.lit(confidence).alias("confidence"),
            F.col("n").alias("value"), F.col("shown").alias("value_str"), F.lit(None).cast("double").alias("value_num"), said.alias("source_text"),
        ))

    # A table is read once: it gives its rows, or one list, and a row or list gives its entities.
    units = (
        F.when(F.col("kind") == "holdings", listed("holdings", F.to_json("holdings"))).when(F.col("kind") == "sectors", listed("sectors", F.to_json(F.map_from_entries("sectors"))))
        .otherwise(F.transform("rows", lambda cells, row: unit(row, cells)))
    )
    rows = read.select("doc_id", "tbl", "title", "kind", F.explode(units).alias("u")).select("doc_id", "tbl", "title", "kind", "u.*")
    every = F.when(F.col("kind") == "holdings", item("top_holdings", "TopHoldings", "holdings", 0.88)).when(F.col("kind") == "sectors", item("sector_allocation", "SectorWeights", "allocation", 0.87)).otherwise(_figures())
    found = rows.select("doc_id", "tbl", "row", F.posexplode(every).alias("nth", "e")).select("doc_id", "tbl", "row", "nth", "e.*")
    order = F.col("tbl").cast("long") * 2**32 + F.col("row").cast("long") * 2**12 + F.col("nth")
    return found.select(
        "doc_id", order.alias("seq"), "entity_type", "mapped_field", "category", "confidence", "value", "value_str", "value_num", "source_text", F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("table_extraction").alias("method")
    )
