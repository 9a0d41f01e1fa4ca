"""Content-addressed WARC archive.

Two tables make an archive: `payloads` keeps the bytes of every distinct payload once, under their SHA-256, and
`records` keeps each record's exact header block with the address of its payload. A WARC record is rebuilt by joining
the two; the digest is computed again from the joined bytes and must equal the address and the header's digest.

Among records with equal payloads of at least SMALLEST bytes the one with the largest page_id is the response and the
others are revisits that refer to it; smaller payloads are always responses.

Edge cases. A null html is an empty payload. A null page_id sorts below all others. Of rows that repeat page_id and
payload, one is the response (least url first, null first). A null url is written as an empty target; line ends in a url are percent-encoded.
A payload that very many pages share is stored once; its records are spread by the engine's skew join when they meet
it again. An empty table
gives empty archives. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, stored

SMALLEST = 1000
DATE = "2000-01-01T00:00:00Z"


def _uri(page_id, row) -> F.Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), row.cast("string"))


def write_archive(pages: DataFrame, path: str, smallest: int = SMALLEST) -> None:
    """Writes path/payloads and path/records. Each distinct payload is shuffled once, copies combine before it."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    page = pages.select("page_id", "url", payload.alias("payload")).select(
        "page_id", "url", "payload", F.sha2("payload", 256).alias("address"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("length")
    )
    page.groupBy("address").agg(F.max("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")

    light = stored(page.drop("payload"), "warc-light")
    same = Window.partitionBy("address", "page_id").orderBy("url")
    top = light.groupBy("address").agg(F.max(F.struct(F.col("page_id").isNotNull(), F.col("page_id"))).alias("top")).select("address", F.col("top.page_id").alias("top_id"))
    rows = light.withColumn("row", F.row_number().over(same)).join(top, "address")
    small = F.col("length") < smallest
    response = small | (F.col("page_id").eqNullSafe(F.col("top_id")) & (F.col("row") == 1))
    kind = F.when(response, "response").otherwise("revisit")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("kind")),
        line("WARC-Record-ID", F.concat(F.lit("<"), _uri(F.col("page_id"), F.col("row")), F.lit(">"))),
        line("WARC-Target-URI", F.coalesce(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), F.lit(""))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(F.col("kind") == "revisit", F.concat(
            line("WARC-Refers-To", F.concat(F.lit("<"), _uri(F.col("top_id"), F.lit(1)), F.lit(">"))),
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        )).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(F.col("kind") == "revisit", F.lit("0")).otherwise(F.col("length").cast("string"))),
        F.lit("\r\n"),
    )
    rows.withColumn("kind", kind).select(header.alias("header"), "address").write.option("compression", "zstd").parquet(f"{path}/records")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """header, address, payload of every record; a revisit's payload is the one that it refers to.

    Raises if bytes don't have the digest that they are stored or announced under."""
    records = spark.read.parquet(f"{path}/records")
    payloads = spark.read.parquet(f"{path}/payloads")
    named = F.regexp_extract("header", r"\r\nWARC-Payload-Digest: sha1:([0-9a-f]{40})\r\n", 1)
    sound = payloads.select("address", "payload", F.sha1("payload").alias("sha1"), (F.sha2("payload", 256) == F.col("address")).alias("sound"))
    joined = records.join(sound, "address", "left")
    ok = F.coalesce(F.col("sound") & (F.col("sha1") == named), F.lit(False))
    return joined.select("header", "address", F.when(ok, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("archive: no sound payload for "), "address")).cast("binary")).alias("payload"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The exact bytes of every WARC record: header block, the payload where it is a response, two line ends."""
    body = F.when(F.col("header").contains("\r\nWARC-Type: response\r\n") | F.col("header").startswith("WARC/1.1\r\nWARC-Type: response\r\n"), F.col("payload")).otherwise(F.lit(b""))
    return read_records(spark, path).select(F.concat(F.col("header").cast("binary"), body, F.lit(b"\r\n\r\n")).alias("record"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload; all taken from the archive."""
    get = lambda name, pattern: F.regexp_extract("header", rf"\r\n{name}: {pattern}\r\n", 1)
    number = lambda x: F.when(x != "", x).cast("long")
    kind = get("WARC-Type", r"(\w+)")
    return read_records(spark, path).select(
        number(get("WARC-Record-ID", r"<urn:page:(-?\d*):\d+>")).alias("page_id"),
        get("WARC-Target-URI", r"([^\r\n]*)").alias("url"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        get("WARC-Payload-Digest", r"sha1:([0-9a-f]{40})").alias("payload_digest"),
        kind.alias("record_type"),
        number(get("WARC-Refers-To", r"<urn:page:(-?\d*):\d+>")).alias("refers_to"),
        "payload",
    )


def op5_warc(pages: DataFrame) -> DataFrame:
    path = new_path(pages.sparkSession, "warc")
    write_archive(pages, path)
    return read_pages(pages.sparkSession, path).drop("payload", "url")


OP5_SQL = """
WITH p AS (SELECT page_id, octet_length(CAST(encode(coalesce(html, '')) AS BLOB)) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM p
"""
