"""Whole documents: routing by content type, checked hashes, headers, blocks and full texts of pages and books.

docs: doc_id, content_type, bytes and, where the caller has one, source_hash.

Edge cases. Null content types count as PDF, for which no blocks are read here. Null or broken bytes give a document
without blocks and an error row, never a failed job. A source_hash that isn't 32 small hexadecimal digits is an error;
a missing one is computed. Rows that repeat a doc_id are one document's blocks twice. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.sources import sections as X

from . import blocks as BL

# Content types, versions of what is written.
BOOK, XHTML = "application/epub+zip", "application/xhtml+xml"
SCHEMA_VERSION, PROCESSOR_VERSION = "1.0", 1


def is_book(content_type: Column) -> Column:
    return F.coalesce(content_type == BOOK, F.lit(False))


def is_page(content_type: Column) -> Column:
    return F.coalesce((content_type == XHTML) | F.endswith(content_type, F.lit("html")), F.lit(False))


def kind_of(content_type: Column) -> Column:
    """'epub', 'snapshot', else 'pdf'."""
    return F.when(is_book(content_type), "epub").when(is_page(content_type), "snapshot").otherwise("pdf")


def checked_hash(given: Column) -> Column:
    """A source hash as it is; an error where it isn't an MD5 in small hexadecimal digits."""
    bad = F.raise_error(F.concat(F.lit("not a source hash: "), F.coalesce(given, F.lit("null")))).cast("string")
    return F.when(F.coalesce(given.rlike("^[0-9a-f]{32}$"), F.lit(False)), given).otherwise(bad)


def routed(docs: DataFrame) -> DataFrame:
    """docs with kind, file_size and source_hash, given or computed."""
    own = F.md5(F.coalesce("bytes", F.lit(b"")))
    given = F.when(F.col("source_hash").isNotNull(), checked_hash(F.col("source_hash"))).otherwise(own) if "source_hash" in docs.columns else own
    return docs.withColumn("kind", kind_of(F.col("content_type"))).withColumn("file_size", F.coalesce(F.octet_length("bytes"), F.lit(0)).cast("long")).withColumn("source_hash", given)


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, kind, page, block, type, text: the top-level blocks of snapshots (one page) and books (a page for each
    spine item), texts of nested blocks joined by line ends."""
    r = routed(docs).select("doc_id", "kind", "bytes")
    pages = r.filter("kind = 'snapshot'").select(F.col("doc_id").alias("page_id"), F.decode("bytes", "UTF-8").alias("html"))
    rows = BL.page_blocks(pages)
    leaf = F.when(F.col("text").isNotNull(), F.struct("block_no", "text"))
    of_page = rows.groupBy("page_id", F.col("ref")[0].alias("block")).agg(
        F.min_by("type", "block_no").alias("type"), F.array_join(F.transform(F.array_sort(F.collect_list(leaf)), lambda x: x["text"]), "\n").alias("text")
    ).select(F.col("page_id").alias("doc_id"), F.lit("snapshot").alias("kind"), F.lit(0).alias("page"), "block", "type", "text")
    books = X.sections(r.filter("kind = 'epub'")).filter("kind = 'block'")
    return of_page.unionByName(books.select("doc_id", F.lit("epub").alias("kind"), F.col("spine").alias("page"), "block", "type", "text"))


def headers(docs: DataFrame, of: DataFrame) -> DataFrame:
    """A row per document: kind, content type, hash, size, versions, numbers of blocks and of characters (a separator
    between blocks), and error (name, message) where nothing could be read. of: of `blocks`."""
    n = of.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"), (F.sum(F.char_length("text")) + F.count(F.lit(1)) - 1).alias("character_count"))
    x = routed(docs).join(n, "doc_id", "left")
    failed = F.when(F.col("n_blocks").isNull(), F.struct(F.when(F.col("kind") == "pdf", "UnsupportedType").otherwise("NoBlocks").alias("name"), F.concat(F.lit("nothing read from "), F.coalesce("content_type", F.lit("null"))).alias("message")))
    return x.select(
        "doc_id", "kind", "content_type", "source_hash", "file_size", F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(PROCESSOR_VERSION).alias("processor_version"),
        F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), F.coalesce("character_count", F.lit(0)).alias("character_count"), failed.alias("error"),
    )


def needs_processing(headers: DataFrame, schema_version: str = SCHEMA_VERSION, processor_version: int = PROCESSOR_VERSION) -> DataFrame:
    """Headers of documents that were written by other versions, or not at all."""
    same = (F.col("schema_version") == schema_version) & (F.col("processor_version") == processor_version) & F.col("error").isNull()
    return headers.filter(~F.coalesce(same, F.lit(False)))


def full_text(of: DataFrame) -> DataFrame:
    """doc_id, text, total_pages: blocks joined by line ends, pages by form feeds."""
    by_page = of.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n").alias("t"))
    pages = F.array_sort(F.collect_list(F.struct("page", "t")))
    return by_page.groupBy("doc_id").agg(F.array_join(F.transform(pages, lambda x: x["t"]), "\f").alias("text"), F.count(F.lit(1)).alias("total_pages"))


def entry(files: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (doc_id, path) with found: the archive's entry of that path, else of the percent-decoded path, else the first
    whose path differs by case alone; null without one. files: doc_id, name."""
    a = asked.withColumn("__plain", F.coalesce(F.try_url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), F.col("path")))
    f = files.select(F.col("doc_id").alias("__doc"), F.col("name").alias("__name"))
    x = a.join(f, (a["doc_id"] == f["__doc"]) & (F.lower(f["__name"]).isin(F.lower(a["path"]), F.lower(a["__plain"]))), "left")
    rank = F.when(F.col("__name") == F.col("path"), 0).when(F.col("__name") == F.col("__plain"), 1).otherwise(2)
    best = F.min(F.when(F.col("__name").isNotNull(), F.struct(rank.alias("rank"), F.col("__name").alias("name"))))
    return x.groupBy("doc_id", "path").agg(best.alias("b")).select("doc_id", "path", F.col("b.name").alias("found"))
