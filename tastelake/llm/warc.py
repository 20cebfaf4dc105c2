"""A content-addressed web archive: payload bytes once by digest, exact record headers apart, records put together by joins.

``write`` makes two folders. ``payloads`` has each different payload once, under its SHA-256; rows that share this digest must also agree in
length and SHA-1, else the job fails. ``records`` has the exact header of every record: the WARC block, the HTTP block, both with
their blank lines, and the digest that leads to the payload. Of equal payloads of at least ``min_bytes`` the record with the largest
page_id is a response, the others are revisits that name it; smaller payloads are all responses.

``listing`` reads an archive back record by record without moving payloads: types, ids and references come from the header bytes,
lengths and digests from the stored payloads, and what header and payload say of each other is compared. ``records`` joins the payloads to the
headers, and ``export`` writes standard .warc files from them.

Nulls: a null html is an empty payload; a null url has no target line; a null page_id never leads a group unless it has no other, then its
rows are all responses. Rows that repeat the largest page_id of a group are all responses. Line ends in a url are percent-encoded. An empty
table gives an empty archive, other columns are not read. A page is one row, so the longest html must fit into a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastelake.session import stored

MIN_BYTES = 1000
END = "\r\n"
#: Names of the WARC 1.1 standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE, REVISIT = "response", "revisit"
_SCHEMAS = {"records": "key binary, header string", "payloads": "key binary, payload binary"}


def lines(*parts: Column | str) -> Column:
    """The parts as lines; a null part is left out."""
    each = [F.concat(F.lit(p) if isinstance(p, str) else p, F.lit(END)) for p in parts]
    return F.concat(*[F.coalesce(p, F.lit("")) for p in each])


def record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def header(date: str) -> Column:
    """Header bytes of a record from page_id, url, n, sha1, revisit and refers_to."""
    http = lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", F.concat(F.lit("Content-Length: "), F.col("n")), "")
    block = F.octet_length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("n"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    warc = lines(
        "WARC/1.1",
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), REVISIT).otherwise(RESPONSE)),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), url),
        f"WARC-Date: {date}",
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("refers_to")))),
        F.when(F.col("revisit"), F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        "Content-Type: application/http; msgtype=response",
        F.concat(F.lit("Content-Length: "), block),
        "",
    )
    return F.concat(warc, http)


def write(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, date: str = "1970-01-01T00:00:00Z") -> None:
    """The archive of ``pages`` (page_id, url, html) below ``path``.

    Digests are taken first, so groups are found on short rows. Payloads are shuffled once, those equal within a task as one.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    short = pages.select("page_id", "url", payload.alias("payload")).select(
        "page_id", "url", F.octet_length("payload").cast("bigint").alias("n"),
        F.unhex(F.sha2("payload", 256)).alias("key"), F.sha1("payload").alias("sha1"),
    )
    short = stored(short, "pages")
    shared = short.filter(F.col("n") >= min_bytes).groupBy("key").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_rows"))
    led = short.join(shared.filter("_rows > 1").drop("_rows").withColumn("_shared", F.lit(True)), "key", "left")
    revisit = F.coalesce("_shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    led.withColumn("revisit", revisit).select("key", header(date).alias("header")).write.option("compression", "zstd").parquet(f"{path}/records")

    measures = F.struct(F.octet_length("payload").alias("n"), F.sha1("payload").alias("sha1"))
    bodies = pages.select(payload.alias("payload")).select(F.unhex(F.sha2("payload", 256)).alias("key"), "payload", measures.alias("m"))
    once = bodies.groupBy("key").agg(F.first("payload").alias("payload"), F.min("m").alias("least"), F.max("m").alias("most"))
    clash = F.when(F.col("least") != F.col("most"), F.raise_error(F.lit("two payloads share a SHA-256 digest")).cast("binary"))
    once.select("key", F.coalesce(clash, "payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")


def part(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{path}/{name}")


def field(name: str, header: str = "header") -> Column:
    """Value of a named field of the WARC block; null if it is not there."""
    block = F.split(F.substring_index(header, END + END, 1), END)
    found = F.filter(block, lambda line: F.startswith(line, F.lit(f"{name}: ")))
    return F.substring(F.get(found, 0), len(name) + 3, 2**31 - 1)


def page_of(identifier: Column) -> Column:
    return F.substring_index(F.substring_index(identifier, ":", -1), ">", 1).try_cast("bigint")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes and payload_digest of every record, read from the archive.

    The job fails if a payload is missing, does not have the digest it is stored under, or differs from what a header says.
    """
    bodies = part(spark, path, "payloads").select(
        "key", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
        (F.unhex(F.sha2("payload", 256)) == F.col("key")).alias("whole"),
    )
    http = F.substring_index(F.substring_index("header", END + END, -2), END + END, 1)
    said = F.substring_index(http, "Content-Length: ", -1).cast("bigint")
    heads = part(spark, path, "records").select(
        "key", page_of(field("WARC-Record-ID")).alias("page_id"), field("WARC-Target-URI").alias("url"), field("WARC-Type").alias("record_type"),
        page_of(field("WARC-Refers-To")).alias("refers_to"), field("WARC-Payload-Digest").alias("said"), said.alias("said_bytes"),
    )
    joined = heads.join(bodies, "key", "left")
    right = F.col("whole") & (F.concat(F.lit("sha1:"), "payload_digest") == F.col("said")) & (F.col("payload_bytes") == F.col("said_bytes"))
    fault = F.when(~F.coalesce(right, F.lit(False)), F.raise_error(F.concat(F.lit("payload and header differ: "), "said")).cast("string"))
    return joined.select("page_id", "url", "payload_bytes", F.coalesce(fault, "payload_digest").alias("payload_digest"), "record_type", "refers_to")


def records(spark: SparkSession, path: str) -> DataFrame:
    """key, header, payload and the original ``record`` bytes of every record; a revisit's record ends after its headers."""
    joined = part(spark, path, "records").join(part(spark, path, "payloads"), "key")
    body = F.when(field("WARC-Type") == RESPONSE, F.col("payload")).otherwise(F.lit(b""))
    return joined.withColumn("record", F.concat(F.col("header").cast("binary"), body, F.lit((END + END).encode())))


def export(spark: SparkSession, path: str, target: str, rows_per_file: int = 20_000) -> None:
    """Standard WARC 1.1 files of all records below ``target``."""
    body = F.expr(f"decode(substring(record, 1, octet_length(record) - {len(END + END)}), 'UTF-8')")
    text = records(spark, path).select(body.alias("value"))
    text.write.option("lineSep", END + END).option("maxRecordsPerFile", rows_per_file).text(target)
