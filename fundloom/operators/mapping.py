"""Records to a target schema: rules as rows, cells joined with them, converted and validated; coverage, errors, summaries.

A schema is a table, one row per field, from a JSON file or built in. Records are unpivoted to cells, which meet their
field's rule; so the plan is the same whatever the schema. What is wrong with a required field is an error, and only
errors make a mapping fail; what is wrong with another field is a warning.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundloom.functions.catalog import ALLOWED, SCHEMA

#: What is said of a value; {} is filled in.
CUT, NO_MATCH, NOT_ALLOWED, TOO_SMALL, TOO_LARGE, NO_DATE, NO_NUMBER, MISSING = (
    "Truncated to {} chars", "Does not match pattern {}", "Not in allowed values: {}", "Below minimum {}", "Above maximum {}", "Expected format YYYY-MM-DD", "Conversion error: not a number", "Required field missing",
)
#: The texts of errors.
LACKS, FAILS = "Required field '{}' is missing", "Required field '{}': {}"
DATE = "YYYY-MM-DD"
#: Columns of records that are none of their fields.
META = {"doc_id", "security_id", "entity_count", "methods", "avg_confidence", "fields_present", "quality_score"}
RULES = "nth int, field string, display_name string, data_type string, category string, required boolean, max_length int, precision int, pattern string, format string, allowed array<string>, min_value double, max_value double"
#: Places to which decimals can be rounded, at most.
PLACES = 12


def parse_schema(spark: SparkSession, text: str) -> DataFrame:
    """The rules of a schema, JSON with a list of fields; what a field doesn't say is as for the built-in one: a string, not required, of four places."""
    rows = []
    for nth, f in enumerate(json.loads(text).get("fields", [])):
        number = lambda k, f=f: None if f.get(k) is None else float(f[k])
        rows.append((
            nth, f["field_name"], f.get("display_name", f["field_name"]), f.get("data_type", "string"), f.get("category", "other"), bool(f.get("required", False)), f.get("max_length"), f.get("precision", 4),
            f.get("pattern"), f.get("format", DATE), f.get("allowed_values"), number("min_value"), number("max_value"),
        ))
    return spark.createDataFrame(rows, RULES)


def built_in(spark: SparkSession) -> DataFrame:
    rows = [(nth, f, f, kind, category, required, longest, 4 if places is None else places, None if kind == "date" else pattern, DATE, ALLOWED.get(f), least, most) for nth, (f, kind, category, required, longest, places, pattern, least, most) in enumerate(SCHEMA)]
    return spark.createDataFrame([(*r[:11], *(None if x is None else float(x) for x in r[11:])) for r in rows], RULES)


def load_schema(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The rules of a schema file; the built-in schema without one or where it isn't found."""
    if path is None:
        return built_in(spark)
    try:
        return parse_schema(spark, spark.read.option("wholetext", True).text(path).first()["value"])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return built_in(spark)


def cells(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, security_id, confidence, field, value): the fields that a record has, as strings, and those required that it lacks, without a value."""
    held = {f.name: f.dataType.simpleString() for f in rows.schema.fields if f.name not in META}
    shown = lambda n, t: F.to_json(n) if t.startswith(("array", "map", "struct")) else F.col(n).cast("string")
    confidence = F.coalesce("avg_confidence", F.lit(0.8)) if "avg_confidence" in rows.columns else F.lit(0.8)
    own = F.filter(F.array(*[F.struct(F.lit(n).alias("field"), shown(n, t).alias("value")) for n, t in held.items()]), lambda c: c["value"].isNotNull())
    needed = rules.where("required").agg(F.collect_list("field").alias("needed"))  # one row, as long as the schema
    there = rows.select("doc_id", "security_id", confidence.alias("confidence"), own.alias("own")).crossJoin(F.broadcast(needed))
    lacking = F.transform(F.array_except("needed", F.transform("own", lambda c: c["field"])), lambda f: F.struct(f.alias("field"), F.lit(None).cast("string").alias("value")))
    return there.select("doc_id", "security_id", "confidence", F.explode(F.concat("own", lacking)).alias("c")).select("doc_id", "security_id", "confidence", "c.*")


def _said(text: str, *parts: Column) -> Column:
    """The text with its {} filled in."""
    pieces = text.split("{}")
    return F.concat(*[x for k, p in enumerate(pieces) for x in ((F.lit(p), parts[k]) if k < len(parts) else (F.lit(p),))])


def _bound(value: Column) -> Column:
    """A bound as it is said: whole numbers without a point."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def _converted(met: DataFrame) -> DataFrame:
    """Adds num: the value as a number, rounded or cut, of decimals and integers; a column, so that it is made once for all that is asked of it."""
    number = F.when(F.col("data_type") == "decimal", F.translate("value", ",$%", "").try_cast("double")).when(F.col("data_type") == "integer", F.col("value").try_cast("double"))
    met = met.withColumn("num", number)
    rounded = F.lit(None).cast("double")
    for places in range(PLACES + 1):
        rounded = F.when(F.col("precision") == places, F.bround("num", places)).otherwise(rounded)
    rounded = F.when(F.col("num") == 0, F.col("num")).otherwise(F.coalesce(rounded, "num"))  # rounding would lose the sign of -0.0
    return met.withColumn("num", F.when(F.col("data_type") == "decimal", rounded).otherwise(F.col("num").try_cast("int").cast("double")))


def _checked(kind: Column, value: Column) -> tuple[Column, Column]:
    """The value as a string, converted to its number `num` where it has one, and what is wrong with it (null: nothing)."""
    text = kind == "string"
    longest, pattern = F.col("max_length"), F.col("pattern")
    cut = text & (F.length(value) > longest)
    decimal, integer, num = kind == "decimal", kind == "integer", F.col("num")
    allowed = F.concat(F.lit("['"), F.array_join("allowed", "', '"), F.lit("']"))
    wrong = (
        F.when(cut, F.lit(None).cast("string"))
        .when(text & pattern.isNotNull() & ~F.rlike(value, F.concat(F.lit("(?d)^(?:"), pattern, F.lit(")"))), _said(NO_MATCH, pattern))
        .when(text & ~F.array_contains("allowed", value), _said(NOT_ALLOWED, allowed))
        .when((decimal | integer) & num.isNull(), F.lit(NO_NUMBER))
        .when(num < F.col("min_value"), _said(TOO_SMALL, _bound(F.col("min_value"))))
        .when(num > F.col("max_value"), _said(TOO_LARGE, _bound(F.col("max_value"))))
        .when((kind == "date") & (F.col("format") == DATE) & ~value.rlike(r"(?d)^\d{4}-\d{2}-\d{2}$"), F.lit(NO_DATE))
    )
    shown = F.when(cut, F.left(value, longest)).when(decimal, F.coalesce(num.cast("string"), value)).when(integer, F.coalesce(num.cast("int").cast("string"), value)).otherwise(value)
    return shown, wrong


def map_long(rows: DataFrame, schema: DataFrame | None = None) -> DataFrame:
    """(doc_id, security_id, nth, target_field, display_name, category, data_type, value, is_valid, message, error, warning, confidence): a row per record and field of the schema that it has, and per required field that it lacks.

    error: what makes the mapping fail, of required fields only; warning: what is wrong with another field's value.
    """
    rules = built_in(rows.sparkSession) if schema is None else schema
    met = cells(rows, rules).join(F.broadcast(rules), "field")  # as long as the schema
    met = _converted(met)
    value, wrong = _checked(F.col("data_type"), F.col("value"))
    met = met.select("*", value.alias("shown"), wrong.alias("wrong"))
    missing = F.col("value").isNull()
    said = F.when(missing, MISSING).when(F.col("wrong").isNotNull(), F.col("wrong")).when((F.col("data_type") == "string") & (F.length("value") > F.col("max_length")), _said(CUT, F.col("max_length").cast("string")))
    error = F.when(missing, _said(LACKS, F.col("field"))).when(F.col("required") & F.col("wrong").isNotNull(), _said(FAILS, F.col("field"), F.col("wrong")))
    return met.select(
        "doc_id", "security_id", "nth", F.col("field").alias("target_field"), "display_name", "category", "data_type", F.col("shown").alias("value"), (~missing & F.col("wrong").isNull()).alias("is_valid"),
        said.alias("message"), error.alias("error"), F.when(~F.col("required"), F.col("wrong")).alias("warning"), F.when(missing, 0.0).otherwise(F.col("confidence")).alias("confidence"),
    )


def _categories(rules: DataFrame) -> DataFrame:
    """(category, nth_category) in the order of the schema, from 1."""
    first = rules.groupBy("category").agg(F.min("nth").alias("first"))
    listed = first.agg(F.array_sort(F.collect_list(F.struct("first", "category"))).alias("x"))  # as long as the schema
    return listed.select(F.posexplode("x").alias("k", "c")).select("c.category", (F.col("k") + 1).alias("nth_category"))


def record_view(mappings: DataFrame, longest: int = 60, schema: DataFrame | None = None) -> DataFrame:
    """(doc_id, security_id, nth_category, category, target_field, value, is_valid): each record's mappings in the schema's order of categories, values cut."""
    rules = built_in(mappings.sparkSession) if schema is None else schema
    shown = F.when(F.length("value") > longest, F.concat(F.left("value", F.lit(longest)), F.lit("..."))).otherwise(F.col("value"))
    return mappings.join(F.broadcast(_categories(rules)), "category").select("doc_id", "security_id", "nth_category", "category", "target_field", shown.alias("value"), "is_valid")


def first_errors(mappings: DataFrame, most: int = 5) -> DataFrame:
    """(doc_id, errors): the first errors of a document, by record and the schema's order."""
    bad = mappings.where("error is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("security_id", "nth", "error"))).alias("x"))
    return bad.select("doc_id", F.transform(F.slice("x", 1, most), lambda e: e["error"]).alias("errors"))


def coverage(mappings: DataFrame, schema: DataFrame | None = None) -> DataFrame:
    """(doc_id, mapped_fields, coverage_pct, n_errors, n_warnings, passed) per document; errors alone make it fail."""
    rules = built_in(mappings.sparkSession) if schema is None else schema
    sizes = mappings.groupBy("doc_id").agg(F.count_distinct("target_field").alias("mapped_fields"), F.count("error").alias("n_errors"), F.count("warning").alias("n_warnings"))
    sizes = sizes.crossJoin(F.broadcast(rules.agg(F.count("*").alias("n"))))  # one row
    return sizes.select("doc_id", "mapped_fields", F.bround(F.col("mapped_fields") / F.col("n") * 100, 1).alias("coverage_pct"), "n_errors", "n_warnings", (F.col("n_errors") == 0).alias("passed"))


def unmapped(mappings: DataFrame, schema: DataFrame | None = None) -> DataFrame:
    """(target_field, category): schema fields that no record has."""
    rules = built_in(mappings.sparkSession) if schema is None else schema
    return rules.select(F.col("field").alias("target_field"), "category").join(mappings.select("target_field").distinct(), "target_field", "left_anti")


def category_coverage(mappings: DataFrame, schema: DataFrame | None = None) -> DataFrame:
    rules = built_in(mappings.sparkSession) if schema is None else schema
    mapped = mappings.select(F.col("target_field").alias("field")).distinct().withColumn("there", F.lit(1))
    return rules.join(mapped, "field", "left").groupBy("category").agg(F.count("*").alias("n_fields"), F.count("there").alias("n_covered"))


def summary(rules: DataFrame) -> DataFrame:
    """(category, n_fields, n_required, fields) of a schema."""
    return rules.groupBy("category").agg(F.count("*").alias("n_fields"), F.count_if("required").alias("n_required"), F.array_join(F.array_sort(F.collect_list("field")), ",").alias("fields"))
