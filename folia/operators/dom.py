"""Queries over element tables. Subtrees are intervals of pre-order numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def local_name(tag: Column) -> Column:
    return F.regexp_replace(tag, "^[^:]*:", "")


def attribute(attrs: Column, name: str) -> Column:
    """The plain name, else the first prefixed form."""
    prefixed = F.map_values(F.map_filter(attrs, lambda k, v: k.endswith(f":{name}")))
    return F.coalesce(attrs[name], F.get(prefixed, F.lit(0)))


def elements(nodes: DataFrame, *names: str) -> DataFrame:
    return nodes.filter((F.col("kind") == "element") & local_name(F.col("tag")).isin(*names))


def first_element(nodes: DataFrame, name: str) -> DataFrame:
    """The first element of that name of each page, in document order."""
    return elements(nodes, name).groupBy("page_id").agg(F.min_by(F.struct("pre", "last_pre", "tag", "attrs"), "pre").alias("x")).select("page_id", "x.*")


def children(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """Direct element children of the given elements (page_id, pre)."""
    parent = of.select("page_id", F.col("pre").alias("parent"))
    return nodes.filter("kind = 'element'").join(parent, ["page_id", "parent"], "left_semi")


def text_of(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """page_id, pre, text: the text below each given element (page_id, pre, last_pre), br as a line end."""
    piece = nodes.filter("kind = 'text' or tag = 'br'").select("page_id", F.col("pre").alias("at"), F.when(F.col("kind") == "text", F.col("text")).otherwise("\n").alias("piece"))
    e = of.select("page_id", "pre", "last_pre")
    joined = e.join(piece, (e["page_id"] == piece["page_id"]) & (piece["at"] > e["pre"]) & (piece["at"] <= e["last_pre"]), "left").select(e["page_id"], e["pre"], "at", "piece")
    ordered = F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("at", "piece"))))
    return joined.groupBy("page_id", "pre").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("text"))


def stream_index(nodes: DataFrame) -> DataFrame:
    """Sibling facts and text stream offsets: one window over the page, one over siblings."""
    page = Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length(F.coalesce("text", F.lit("")))
    x = nodes.withColumn("text_start", F.coalesce(F.sum(size).over(page), F.lit(0)))
    kin = Window.partitionBy("page_id", "parent", "tag").orderBy("pre")
    return x.filter("kind = 'element'").withColumn("nth_of_type", F.row_number().over(kin)).withColumn(
        "last_of_type", F.lead("pre").over(kin).isNull()
    )


def metadata(nodes: DataFrame) -> DataFrame:
    """page_id, title, author, description, keywords: the last of each."""
    meta = elements(nodes, "meta").select("page_id", "pre", F.lower(F.col("attrs")["name"]).alias("name"), F.col("attrs")["content"].alias("content"))
    named = meta.groupBy("page_id").agg(*[F.max_by(F.when(F.col("name") == n, F.col("content")), F.when(F.col("name") == n, F.col("pre"))).alias(n) for n in ("author", "description", "keywords")])
    title = text_of(nodes, first_element(nodes, "title")).select("page_id", F.trim("text").alias("title"))
    return nodes.select("page_id").distinct().join(title, "page_id", "left").join(named, "page_id", "left")


def dom_map(index: DataFrame, anchored: DataFrame) -> DataFrame:
    """The rows of stream_index that hold an anchored element (page_id, pre) below the body, or are one; with
    text_length."""
    a = anchored.select("page_id", F.col("pre").alias("__at")).distinct()
    body = index.filter("tag = 'body'").groupBy("page_id").agg(F.min("pre").alias("__body"))
    x = index.join(body, "page_id").filter(F.col("pre") > F.col("__body"))
    return x.join(a, (x["page_id"] == a["page_id"]) & (a["__at"] >= x["pre"]) & (a["__at"] <= x["last_pre"]), "left_semi").drop("__body")


def page_facts(nodes: DataFrame) -> DataFrame:
    """page_id, title, n_headings, n_links, text: of every page, from one pass over its elements; the text is that of the
    first article, or of the body where there is none, without scripts and styles."""
    name = local_name(F.col("tag"))
    row = F.struct("pre", "last_pre", "tag")
    facts = nodes.groupBy("page_id").agg(
        F.count_if(F.col("tag").rlike("^h[1-6]$")).alias("n_headings"), F.count_if(F.col("attrs")["href"].isNotNull()).alias("n_links"),
        F.min(F.when((F.col("kind") == "element") & (name == "article"), row)).alias("article"), F.min(F.when((F.col("kind") == "element") & (name == "body"), row)).alias("body"),
        F.min(F.when((F.col("kind") == "element") & (name == "title"), row)).alias("title"),
        F.filter(F.array_sort(F.collect_list(F.when(F.col("kind") == "element", F.when(name.isin("script", "style"), F.struct("pre", "last_pre"))))), lambda x: x.isNotNull()).alias("hidden"),
        F.array_sort(F.collect_list(F.when((F.col("kind") == "text") | (F.col("tag") == "br"), F.struct("pre", F.when(F.col("kind") == "text", F.col("text")).otherwise("\n").alias("piece"))))).alias("pieces"),
    )
    below = lambda of: F.filter("pieces", lambda p: (p["pre"] > of["pre"]) & (p["pre"] <= of["last_pre"]))
    shown = lambda pieces: F.filter(pieces, lambda p: ~F.exists("hidden", lambda h: (p["pre"] >= h["pre"]) & (p["pre"] <= h["last_pre"])))
    joined = lambda pieces: F.array_join(F.transform(pieces, lambda p: p["piece"]), "")
    main = F.coalesce("article", "body")
    return facts.select("page_id", F.trim(joined(below(F.col("title")))).alias("title"), "n_headings", "n_links", F.coalesce(joined(shown(below(main))), F.lit("")).alias("text"))
