"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Reading cuts the archives at every occurrence of the version line, so each piece is a candidate record whose
header names its successor's offset. A payload may hold the same line: such pieces are candidates too. Pointer
jumping from offset 0 of each file marks the records that the chain reaches; what it does not reach is payload.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fundloom.llm.shared import attach, materialize, scratch_path

VERSION, END = "WARC/1.1\r\n", "\r\n\r\n"
#: Payloads shorter than this are never revisits.
LEAST = 1000


def _one_line(value: Column) -> Column:
    return F.regexp_replace(value, r"[\r\n]+", "%0A")


def write_archives(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """A record per row of pages (page_id, url, payload binary): of equal payloads of `least` bytes or more, the largest page_id is the response."""
    rows = pages.select("page_id", "url", "payload", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size"))
    same = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    same = materialize(same, "payloads")
    rows = attach(rows, same, ["digest", "size"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    header = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    record_id = lambda x: F.concat(F.lit("<urn:page:"), x.cast("string"), F.lit(">"))
    body = F.when(again, F.lit(b"")).otherwise(F.col("payload"))
    head = F.concat(
        F.lit(VERSION),
        header("WARC-Type", F.when(again, "revisit").otherwise("response")),
        header("WARC-Record-ID", record_id(F.col("page_id"))),
        header("WARC-Target-URI", _one_line(F.col("url"))),
        header("WARC-Refers-To", F.when(again, record_id(F.col("first")))),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        header("WARC-Payload-Length", F.col("size").cast("string")),
        header("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
    )
    # The bytes stay as they are: a cast to string doesn't check or change them.
    rows.select(F.concat(head.cast("binary"), body).cast("string").alias("value")).write.option("lineSep", END).text(path)


def _field(head: str, name: str) -> Column:
    return F.regexp_extract(head, rf"(?md)^{name}: (.*?)\r$", 1)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, size, head, successor, digest): each piece between version lines; digest of its payload if it is a whole record."""
    sep = len(VERSION)
    pieces = spark.read.option("lineSep", VERSION).text(path).select(F.col("value").cast("binary").alias("raw"), "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("nth"))
    # Headers are ASCII or UTF-8 up to the first empty line; positions are counted in bytes by decoding as Latin-1.
    latin = F.decode("raw", "ISO-8859-1")
    pieces = pieces.select("*", F.octet_length("raw").cast("long").alias("size"), F.instr(latin, "\r\n\r\n").alias("at"))
    pieces = pieces.select("*", F.when(F.col("at") > 0, F.substring("raw", F.lit(1), F.col("at") + 1).cast("string")).alias("head"))
    length = F.expr("try_cast(nullif(regexp_extract(head, '(?md)^Content-Length: ([0-9]+)\\r$', 1), '') as long)")
    pieces = pieces.withColumn("body", length)
    whole = F.col("size") == F.col("at") + 3 + F.col("body") + len(END)
    order = Window.partitionBy("file_path").orderBy("file_block_start", "nth")
    digest = F.when(whole, F.sha1(F.substring("raw", F.col("at") + 4, F.col("body").cast("int"))))
    tiled = pieces.select("file_path", "file_block_start", "nth", "size", "head", "at", "body", digest.alias("digest"))
    # A piece begins behind a version line, but for what stands before the first one.
    begin = F.sum(F.col("size") + sep).over(order.rowsBetween(Window.unboundedPreceding, -1))
    tiled = tiled.withColumn("offset", begin - sep).where("offset is not null")
    return tiled.select(
        F.col("file_path").alias("file"), "offset", "size", "head", (F.col("offset") + sep + F.col("at") + 3 + F.col("body") + len(END)).alias("successor"), "at", "body", "digest"
    )


def reachable(links: DataFrame) -> DataFrame:
    """links (file, offset, successor) -> (file, offset) that the chain from offset 0 reaches; log2 of the longest chain many rounds."""
    jumps = materialize(links.where("successor is not null").select("file", "offset", "successor"), "jumps")
    marked = materialize(links.where("offset = 0").select("file", "offset").distinct(), "marked")
    seen = marked.count()
    while True:
        ahead = marked.join(jumps, ["file", "offset"]).select("file", F.col("successor").alias("offset"))
        marked = materialize(marked.unionByName(ahead).distinct(), "marked")
        if (now := marked.count()) == seen:
            break
        seen = now
        onward = jumps.select("file", F.col("offset").alias("successor"), F.col("successor").alias("onward"))
        jumps = materialize(jumps.join(onward, ["file", "successor"]).select("file", "offset", F.col("onward").alias("successor")), "jumps")
    return marked.join(links.select("file", "offset"), ["file", "offset"], "left_semi")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, refers_to, payload_bytes, payload_digest) of each record; a digest that differs from the header's is an error."""
    found = materialize(candidates(spark, path), "candidates")
    records = found.join(materialize(reachable(found), "reached"), ["file", "offset"])
    # Records with a version line in their payload lie over several pieces: only their bytes are gathered.
    broken = materialize(records.where("digest is null and successor is not null").select("file", "offset", "successor", "at", "body"), "broken")
    if broken.count():
        records = records.drop("digest").join(_gathered(spark, path, broken).unionByName(records.where("digest is not null").select("file", "offset", "digest")), ["file", "offset"])
    of = lambda name: F.expr(f"try_cast(nullif({name}, '') as long)")
    rows = records.select(
        F.regexp_extract("head", r"(?md)^WARC-Record-ID: <urn:page:(-?\d+)>\r$", 1).alias("id"),
        _field("head", "WARC-Type").alias("record_type"),
        F.regexp_extract("head", r"(?md)^WARC-Refers-To: <urn:page:(-?\d+)>\r$", 1).alias("to"),
        _field("head", "WARC-Payload-Length").alias("size"),
        F.regexp_extract("head", r"(?md)^WARC-Payload-Digest: sha1:([0-9a-f]+)\r$", 1).alias("named"),
        "digest",
        "body",
    )
    digest = F.when((F.col("record_type") == "revisit") | (F.col("digest") == F.col("named")), F.col("named")).otherwise(
        F.raise_error(F.concat(F.lit("payload differs from its digest: page "), "id"))
    )
    size = F.when(F.col("record_type") == "revisit", of("size")).otherwise(F.col("body"))
    return rows.select(of("id").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", of("to").alias("refers_to"))


def _gathered(spark: SparkSession, path: str, broken: DataFrame) -> DataFrame:
    """(file, offset, digest) of records whose payload holds version lines; the archives are read again for their bytes."""
    sep = len(VERSION)
    order = Window.partitionBy("file_path").orderBy("file_block_start", "nth")
    pieces = spark.read.option("lineSep", VERSION).text(path).select(F.col("value").cast("binary").alias("raw"), "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("nth"))
    files = broken.select(F.col("file").alias("file_path")).distinct()
    begin = F.sum(F.octet_length("raw") + sep).over(order.rowsBetween(Window.unboundedPreceding, -1)) - sep
    placed = pieces.join(files, "file_path", "left_semi").withColumn("begin", begin).where("begin is not null")
    # In each file, a piece belongs to the last broken record that begins before it, if it lies within.
    starts = placed.select("file_path", F.col("begin").alias("pos"), "raw", F.lit(None).cast("struct<offset:bigint,successor:bigint,at:int,body:bigint>").alias("own"))
    marks = broken.select(F.col("file").alias("file_path"), F.col("offset").alias("pos"), F.lit(None).cast("binary").alias("raw"), F.struct("offset", "successor", "at", "body").alias("own"))
    owned = starts.unionByName(marks).withColumn("own", F.last("own", True).over(Window.partitionBy("file_path").orderBy("pos", F.col("raw").isNotNull())))
    inside = owned.where("raw is not null and pos < own.successor")
    whole = inside.groupBy("file_path", "own").agg(F.array_sort(F.collect_list(F.struct("pos", "raw"))).alias("parts"))
    mark = VERSION.encode().hex().upper()
    joined = F.unhex(F.concat(F.lit(mark), F.array_join(F.transform("parts", lambda x: F.hex(x["raw"])), mark)))  # one copy, however many parts
    return whole.select(
        F.col("file_path").alias("file"), F.col("own.offset").alias("offset"), F.sha1(F.substring(joined, F.lit(sep + 1) + F.col("own.at") + 3, F.col("own.body").cast("int"))).alias("digest")
    )


def archive_pages(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes pages (page_id, url, html, ...) to archives in the shared folder and reads them back.

    A null html is an empty payload, a null url leaves its header out; line ends in a url are escaped. A row
    without page_id is never the one that others revisit, and is read back without an id. Rows of one page_id and
    payload are all responses if theirs is the largest id. An empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    write_archives(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")), path, least)
    return read_archives(spark, path)
