"""Records to files: JSON packages with a canonical hash, CSV, and a provenance trail."""

from __future__ import annotations

import datetime
import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fundloom.functions.catalog import FIELDS, SCHEMA

#: What a package says of itself.
SCHEMA_NAME, SCHEMA_VERSION, FORMAT_VERSION = "Security Master", "3.2.1", "1.0"
NESTED = [f[0] for f in SCHEMA if f[1] in ("array", "object")]


def spaced_json(text: Column) -> Column:
    """A JSON text written again with one blank behind commas and colons, in ASCII, in its own order."""

    @F.pandas_udf("string")
    def spaced(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(json.loads(t)))

    return spaced(text)


def csv_rows(rows: DataFrame) -> DataFrame:
    """The schema's fields in order, all as strings, lists and maps as JSON, empty where missing."""
    shown = lambda f: spaced_json(F.to_json(f)) if f in NESTED and not rows.schema[f].dataType.simpleString().startswith("string") else F.col(f).cast("string")
    return rows.select("doc_id", "security_id", *[F.coalesce(shown(f), F.lit("")).alias(f) for f in FIELDS])


def key_union(*tables: DataFrame) -> DataFrame:
    """Records of different fields as one table: all fields in the order in which they are first seen, null where a table lacks one."""
    first, *others = tables
    for t in others:
        first = first.unionByName(t, allowMissingColumns=True)
    return first


def canonical_hash(text: str) -> Column:
    """SHA-256 of a JSON text written again with sorted keys, one blank behind commas and colons, in ASCII."""

    @F.pandas_udf("string")
    def hashed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hashlib.sha256(json.dumps(json.loads(t), sort_keys=True).encode()).hexdigest())

    return hashed(text)


def packages(rows: DataFrame, provenance: DataFrame | None = None, stamp: Column | None = None) -> DataFrame:
    """(doc_id, package, content_hash): one JSON document per source document.

    It holds the records with what fields they have, the coverage of the fields, the trail of provenance (doc_id,
    trail string, quality_score) if there is one, and the hash of the records alone. stamp: when it was exported; now by default.
    """
    record = F.to_json(F.struct(*FIELDS))
    grouped = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("security_id", record.alias("r")))).alias("x"), F.count("*").alias("n"), _some_filled().alias("f"))
    grouped = grouped.select("doc_id", "n", F.size("f").alias("populated"), "f", F.concat(F.lit("["), F.array_join(F.transform("x", lambda e: e["r"]), ","), F.lit("]")).alias("data"))
    grouped = grouped.withColumn("content_hash", canonical_hash("data"))
    if provenance is not None:
        grouped = grouped.join(provenance.select("doc_id", "trail", "quality_score"), "doc_id", "left")
    else:
        grouped = grouped.select("*", F.lit(None).cast("string").alias("trail"), F.lit(None).cast("double").alias("quality_score"))
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") if stamp is None else stamp
    text = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    share = F.bround(F.col("populated") / len(FIELDS) * 100, 1)
    names = F.to_json("f")
    body = F.concat(
        F.lit(f'{{"data_import":{{"format_version":"{FORMAT_VERSION}","schema":"{SCHEMA_NAME}","schema_version":"{SCHEMA_VERSION}","export_timestamp":'), text(stamp),
        F.lit(',"record_count":'), F.col("n").cast("string"), F.lit(',"data":'), F.col("data"),
        F.lit('},"quality_metrics":{"overall_score":'), F.coalesce("quality_score", F.lit(0.0)).cast("string"), F.lit(',"records_processed":'), F.col("n").cast("string"),
        F.lit(f',"field_coverage":{{"total_schema_fields":{len(FIELDS)},"populated_fields":'), F.col("populated").cast("string"), F.lit(',"coverage_pct":'), share.cast("string"), F.lit(',"field_list":'), names,
        F.lit('}},"provenance":'), F.coalesce("trail", F.lit("{}")), F.lit(',"content_hash":'), text(F.col("content_hash")), F.lit("}"),
    )
    return grouped.select("doc_id", body.alias("package"), "content_hash")


def _some_filled() -> Column:
    """The fields that some record of a group fills, in order of their names."""
    filled = F.array_compact(F.array(*[F.when(F.col(f).isNotNull() & ((F.lit(True) if f in NESTED else F.col(f).cast("string") != "")), F.lit(f)) for f in FIELDS]))
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(filled))))


def coverage(rows: DataFrame) -> DataFrame:
    """(doc_id, populated, total, fields): fields that some record fills."""
    grouped = rows.groupBy("doc_id").agg(_some_filled().alias("f"))
    return grouped.select("doc_id", F.size("f").cast("long").alias("populated"), F.lit(len(FIELDS)).cast("long").alias("total"), F.array_join("f", ",").alias("fields"))


#: Bytes of a file are hashed as one value, so a file has so many rows at most.
FILE_ROWS = 20_000


def run_name(stamp: datetime.datetime | None = None) -> str:
    """The name of an export run, by its time."""
    return f"data_prep_export_{(stamp or datetime.datetime.now()):%Y%m%d_%H%M%S}"


def write_files(rows: DataFrame, path: str, provenance: DataFrame | None = None, name: str | None = None) -> str:
    """JSON packages, CSV with a header and CRLF, the trails of provenance if there are any, and a manifest of the files, under path/name; where that is.

    The manifest (kind, file, bytes, sha256) is written last: a run without one is not complete.
    """
    base = f"{path}/{name or run_name()}"
    limited = lambda df: df.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS)
    limited(packages(rows, provenance).select("package")).text(f"{base}/json")
    limited(csv_rows(rows)).option("header", True).option("lineSep", "\r\n").option("quote", '"').option("escape", '"').csv(f"{base}/csv")
    kinds = ["json", "csv"]
    if provenance is not None:
        limited(provenance.select("trail")).text(f"{base}/provenance")
        kinds.append("provenance")
    # Files are read and hashed where they are dealt; only their names and hashes come together.
    _files(rows.sparkSession, base, kinds).repartition(1).write.mode("overwrite").parquet(f"{base}/manifest")
    return base


def _files(spark: SparkSession, base: str, kinds: list[str]) -> DataFrame:
    """(kind, file, bytes, sha256) of the data files of a run."""
    found = None
    for kind in kinds:
        read = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{base}/{kind}")
        own = read.select(F.lit(kind).alias("kind"), F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
        found = own if found is None else found.unionByName(own)
    return found


def verified(spark: SparkSession, base: str) -> DataFrame:
    """(kind, file, bytes, sha256, ok) of a run's files: ok if the file is there, unchanged and listed."""
    listed = spark.read.parquet(f"{base}/manifest")
    there = _files(spark, base, [r["kind"] for r in listed.select("kind").distinct().collect()])  # three kinds at most
    both = listed.withColumn("listed", F.lit(True)).join(there.withColumn("there", F.lit(True)), ["kind", "file", "bytes", "sha256"], "full")
    return both.select("kind", "file", "bytes", "sha256", F.coalesce(F.col("listed") & F.col("there"), F.lit(False)).alias("ok"))


def read_csv(spark: SparkSession, base: str) -> DataFrame:
    """The CSV of a run that is complete and unchanged, with types as the values show them."""
    if not verified(spark, base).where("not ok").isEmpty():
        raise ValueError(f"files of {base} differ from its manifest")
    return spark.read.option("header", True).option("inferSchema", True).option("multiLine", True).option("escape", '"').csv(f"{base}/csv")


def json_preview(spark: SparkSession, base: str) -> DataFrame:
    """(data, n): the preview of a run's packages: their data, and how many records that is."""
    package = F.col("value")
    data = F.get_json_object(package, "$.data_import.data")
    return spark.read.text(f"{base}/json").select(data.alias("data"), F.json_array_length(data).alias("n"))


def start_jobs(sources: DataFrame, environment: dict[str, str] | None = None) -> DataFrame:
    """sources (doc_id, source_hash, started timestamp, and source_type, source_url, source_filename where known) with job_id, created_at and environment.

    The id is MSDP, the time and eight digits of an MD5 of the URL, or else of the file name, and the time.
    """
    have = lambda c: F.coalesce(F.col(c), F.lit("")) if c in sources.columns else F.lit("")
    named = sources.select("*", *[have(c).alias(f"_{c}") for c in ("source_url", "source_filename", "source_type")]).drop("source_url", "source_filename", "source_type")
    stamp = F.date_format("started", "yyyyMMdd_HHmmss")
    source = F.when(F.col("_source_url") != "", F.col("_source_url")).otherwise(F.col("_source_filename"))
    digits = F.left(F.md5(F.concat_ws("_", source, stamp)), F.lit(8))
    held = F.create_map(*[F.lit(x) for pair in sorted((environment or {}).items()) for x in pair])if environment else F.expr("cast(map() as map<string,string>)")
    return named.select(
        *[c for c in sources.columns if c not in ("source_url", "source_filename", "source_type")], F.concat_ws("_", F.lit("MSDP"), stamp, digits).alias("job_id"), F.date_format("started", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_at"),
        F.col("_source_type").alias("source_type"), F.col("_source_url").alias("source_url"), F.col("_source_filename").alias("source_filename"), held.alias("environment"),
    )


def provenance_steps(events: DataFrame) -> DataFrame:
    """events (job, ts, id, operation, content) numbered within their job, with hashes of what each step was given and made.

    content: what a step made, a string; the input of a step is the output of the one before. linked: whether it is so.
    """
    order = Window.partitionBy("job").orderBy("ts", "id")
    hashed = events.withColumn("output_hash", F.sha2("content", 256))
    return hashed.select("job", F.row_number().over(order).alias("step_number"), "id", "operation", F.lag("output_hash").over(order).alias("input_hash"), "output_hash")


#: The fields of a step and of a record of provenance, in order, with their types.
STEP = "step_number long, operation string, description string, timestamp string, input_hash string, output_hash string, records_in long, records_out long, duration_ms double, parameters map<string,string>, warnings array<string>"
JOB = (
    "job_id string, created_at string, source_type string, source_url string, source_filename string, source_hash string, target_schema string, target_version string, processing_device string, processing_engine string, steps array<step>, "
    "output_format string, output_hash string, total_duration_ms double, total_entities_extracted long, total_records_produced long, quality_score double, environment map<string,string>"
)


def _default(kind: str) -> Column:
    none = {"string": F.lit(""), "long": F.lit(0), "double": F.lit(0.0)}
    return none[kind].cast(kind) if kind in none else F.expr(f"cast({'map' if kind.startswith('map') else 'array'}() as {kind})")


def _fields(listed: str, columns: list[str]) -> list[Column]:
    """The listed fields out of the columns that there are; a missing one or value has its kind's default."""
    pairs = [x.split(" ") for x in listed.split(", ")]
    return [(F.coalesce(F.col(n).cast(k), _default(k)) if n in columns else _default(k)).alias(n) for n, k in pairs]


def trails(jobs: DataFrame, steps: DataFrame) -> DataFrame:
    """(doc_id, trail, total_duration_ms, total_entities, quality_score): each job with its steps in order, as JSON with all fields of a record of provenance.

    jobs (doc_id, job_id, ...), steps (doc_id, step_number, operation, ...): other fields of JOB and STEP are taken where
    there are such columns, and empty otherwise. Totals are summed from the steps.
    """
    held = steps.select("doc_id", F.struct(*_fields(STEP, steps.columns)).alias("s"))
    totals = [F.sum("s.duration_ms").alias("total_duration_ms"), F.coalesce(F.sum(F.when(F.col("s.operation") == "entity_extraction", F.col("s.records_out"))), F.lit(0)).alias("total_entities_extracted")]
    # Maps have no order, so steps are put in order by their number and what is beside it.
    ordered = F.array_sort(F.collect_list(F.struct(F.col("s.step_number").alias("n"), F.col("s.operation").alias("o"), F.to_json("s", {"ignoreNullFields": "false"}).alias("j"))))
    rolled = held.groupBy("doc_id").agg(ordered.alias("_steps"), *totals)
    owned = jobs.withColumns({"target_schema": F.lit(SCHEMA_NAME), "target_version": F.lit(SCHEMA_VERSION)}).drop("total_duration_ms", "total_entities_extracted").join(rolled, "doc_id")
    before, behind = JOB.split(", steps array<step>, ")
    shown = lambda fields: F.to_json(F.struct(*_fields(fields, owned.columns)))
    inner = lambda text: F.substring(text, F.lit(2), F.length(text) - 2)
    body = F.concat(F.lit("{"), inner(shown(before)), F.lit(',"steps":['), F.array_join(F.transform("_steps", lambda x: x["j"]), ","), F.lit("],"), inner(shown(behind)), F.lit("}"))
    score = F.coalesce(F.col("quality_score").cast("double"), F.lit(0.0)) if "quality_score" in jobs.columns else F.lit(0.0)
    return owned.select("doc_id", body.alias("trail"), "total_duration_ms", F.col("total_entities_extracted").alias("total_entities"), score.alias("quality_score"))


def provenance_rollup(steps: DataFrame, extraction: str = "entity_extraction") -> DataFrame:
    """(job, n_steps, total_duration_ms, entities) of steps (job, operation, records_out, duration_ms): entities are what the extraction steps put out."""
    return steps.groupBy("job").agg(
        F.count("*").alias("n_steps"), F.sum("duration_ms").alias("total_duration_ms"), F.sum(F.when(F.col("operation") == extraction, F.col("records_out")).otherwise(F.lit(0))).alias("entities")
    )
