"""Entities to securities: segments, the best value of each field, cleaning, ids, warnings and scores."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundloom.functions.catalog import DATES, FIELDS, OPTIONAL, POINTS_SET, POINTS_TRUE, RANGES, REQUIRED, SCHEMA
from fundloom.operators.tables import HOLDINGS

TEXT = {f[0] for f in SCHEMA if f[1] in ("string", "date")}
COLUMNS = [*FIELDS, "RSquared_3Y"]


def segment(entities: DataFrame) -> DataFrame:
    """Adds security_id: a new security at each isin if there are two, else at each ticker, else at each fund name."""
    doc = Window.partitionBy("doc_id")
    n = lambda kind: F.count_if(F.col("entity_type") == kind).over(doc)
    key = F.when(n("isin") >= 2, "isin").when(n("ticker") >= 2, "ticker").when(n("fund_name") >= 2, "fund_name")
    upto = doc.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    keyed = entities.withColumn("_key", key)
    number = F.greatest(F.lit(1), F.sum(F.coalesce((F.col("entity_type") == F.col("_key")).cast("int"), F.lit(0))).over(upto))
    return keyed.withColumn("security_id", F.format_string("security_%03d", number.cast("int"))).drop("_key")


def date_text(value: Column) -> Column:
    """The date in ISO form, by the first format that reads it; as it is if none does. Two-digit years from 69 on are of the last century."""
    one = F.regexp_replace(F.trim(value), r"\s+", " ")
    out = []
    for form in DATES:
        day = F.try_to_timestamp(one, F.lit(form)).cast("date")
        if form.endswith("/yy"):
            day = F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
        if "MM" not in form:  # numbers only: the number of digits tells the formats apart
            digits = {"yyyy": r"\d{4}", "yy": r"\d{2}", "M": r"\d{1,2}", "d": r"\d{1,2}"}
            pattern = re.sub("yyyy|yy|M|d", lambda m: digits[m[0]], form)
            out.append(F.when(one.rlike(f"^{pattern}$"), F.date_format(day, "yyyy-MM-dd")))
        else:
            out.append(F.date_format(day, "yyyy-MM-dd"))
    return F.coalesce(*out, value)


def numeric(value: Column) -> Column:
    """A number from a string with currency signs, separators, blanks or percent signs, to four places; null where it is none."""
    return _places(F.regexp_replace(value, r"[$, %]", "").try_cast("double"))


def percentage(value: Column) -> Column:
    """A number from a string with separators or percent signs, blank around it or not, to four places."""
    return _places(F.regexp_replace(F.regexp_replace(value, "[,%]", ""), r"^\s+|\s+$", "").try_cast("double"))


def _places(num: Column) -> Column:
    return F.when(num == 0, num).otherwise(F.bround(num, 4))  # rounding would lose the sign of -0.0


def stars(value: Column) -> Column:
    """One to five, from stars drawn, or asterisks where there are none, or a number cut at its point."""
    count = lambda sign: F.length(value) - F.length(F.replace(value, F.lit(sign), F.lit("")))
    drawn = F.when(count("★") > 0, count("★")).otherwise(count("*"))
    number = F.coalesce(F.when(drawn > 0, drawn), F.trim(value).try_cast("double").cast("int"))
    return F.when(number.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(5), number)))


def records(entities: DataFrame) -> DataFrame:
    """entities with security_id -> a row per security: its fields, entity_count, methods, avg_confidence and fields_present.

    Of a field the most confident value stands, the first of equals. Fields are grouped narrow before they become columns.
    """
    value = F.max_by(F.struct("value_str", "value_num"), F.struct(F.col("confidence"), -F.col("seq")))
    best = entities.groupBy("doc_id", "security_id", "mapped_field").agg(value.alias("v"), F.count("*").alias("n"), F.sum("confidence").alias("c"), F.collect_set("method").alias("m"))
    wide = best.groupBy("doc_id", "security_id").agg(
        F.sum("n").alias("entity_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("m")))).alias("methods"), (F.sum("c") / F.sum("n")).alias("avg_confidence"), F.map_from_entries(F.collect_list(F.struct("mapped_field", "v"))).alias("held")
    )
    out = ["doc_id", "security_id", "entity_count", "methods", F.round("avg_confidence", 6).alias("avg_confidence")]
    for f in COLUMNS:
        held = F.try_element_at("held", F.lit(f))
        text, num = held["value_str"], held["value_num"]
        if f == "InceptionDate":
            value = date_text(text)
        elif f == "BaseCurrency":
            value = F.coalesce(F.left(F.upper(text), F.lit(3)), F.lit("USD"))
        elif f == "StarRating":
            value = F.coalesce(F.when(num.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(5), num.cast("int")))), stars(text))
        elif f in TEXT:
            value = text
        elif f == "TopHoldings":
            value = F.from_json(text, HOLDINGS)
        elif f == "SectorWeights":
            value = F.from_json(text, "map<string,double>")
        else:
            value = F.coalesce(_places(num), percentage(text) if f.startswith("Return_") else numeric(text))
        out.append(value.alias(f))
    wide = wide.select(*out)
    parts = F.concat_ws("|", "ISIN", "CUSIP", "Ticker", "LegalName")
    wide = wide.withColumn("SecId", F.when(parts == "", "F00000000").otherwise(F.concat(F.lit("F"), F.upper(F.left(F.md5(parts), F.lit(8))), F.lit("0"))))
    return wide.withColumn("fields_present", F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in COLUMNS])))


def warnings(rows: DataFrame) -> DataFrame:
    """(doc_id, security_id, field, value, low, high) of values outside their bounds."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for f, (a, b) in RANGES.items()])
    return rows.select("doc_id", "security_id", F.explode(pairs).alias("w")).select("doc_id", "security_id", "w.*").where("value < low or value > high")


def _truthy(f: str) -> Column:
    c = F.col(f)
    return c.isNotNull() & ((c != "") if f in TEXT else (c != 0))


def quality(rows: DataFrame) -> DataFrame:
    """Adds quality_score, 0 to 100 with one place."""
    score = sum((F.when(_truthy(f), p).otherwise(0.0) for f, p in POINTS_TRUE.items()), F.lit(0.0)) + sum((F.when(F.col(f).isNotNull(), p).otherwise(0.0) for f, p in POINTS_SET.items()), F.lit(0.0))
    return rows.withColumn("quality_score", F.bround(score / (sum(POINTS_TRUE.values()) + sum(POINTS_SET.values())) * 100, 1))


def doc_scores(rows: DataFrame) -> DataFrame:
    """(doc_id, n_records, overall_quality, completeness, accuracy) per document."""
    filled = sum((_truthy(f).cast("int") for f in REQUIRED), F.lit(0)) + sum((F.col(f).isNotNull().cast("int") for f in OPTIONAL), F.lit(0))
    missing = (F.col("LegalName").isNull() & F.col("Ticker").isNull()).cast("int")
    grouped = quality(rows).groupBy("doc_id").agg(
        F.count("*").alias("n_records"), F.avg("quality_score").alias("q"), F.sum(filled).alias("filled"), F.sum(missing).alias("errors"), F.sum(F.size("fields_present")).alias("keys")
    )
    return grouped.select(
        "doc_id", "n_records", F.bround("q", 1).alias("overall_quality"), F.bround(F.col("filled") / ((len(REQUIRED) + len(OPTIONAL)) * F.col("n_records")) * 100, 1).alias("completeness"),
        F.when(F.col("keys") == 0, 100.0).otherwise(F.bround(F.greatest(F.lit(0.0), (1 - F.col("errors") / F.col("keys")) * 100), 1)).alias("accuracy"),
    )


def field_coverage(rows: DataFrame) -> DataFrame:
    """(field, n_records): how many securities have each field of the schema."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).isNotNull().cast("long").alias("n")) for f in FIELDS])
    return rows.select(F.explode(pairs).alias("x")).groupBy("x.field").agg(F.sum("x.n").alias("n_records"))
