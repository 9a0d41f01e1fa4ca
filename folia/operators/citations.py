"""Citations in running text: names and years, superscripts, figure references, and the index that they meet.

Tokenizing and matching are column functions and equi-joins on the token; a list is cited only from blocks before it.
Only the pairing of names with years near them walks over a block's marks in order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Label words of captions.
LABELS = {
    "figure": "figure", "fig": "figure", "photograph": "photograph", "photo": "photograph", "illustration": "illustration", "illus": "illustration",
    "table": "table", "tbl": "table", "equation": "math", "eq": "math", "example": "example", "ex": "example",
}
FIRST_YEAR = 1800
#: Items whose sums are built together.
CHUNK = 8


def is_year(word: Column, now: int) -> Column:
    return word.rlike("^[1-9][0-9]{3}$") & F.when(word.rlike("^[0-9]{4}$"), word.cast("int")).between(FIRST_YEAR, now)


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def starts(sizes: Column) -> Column:
    """The sum of the sizes before each item of an array. Sums are built by chunks, so that a long array doesn't cost the
    square of its length; nothing is exchanged."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + x)
    first = lambda a, n: F.slice(a, F.lit(1), n)

    def of_chunks(chunks: Column) -> Column:
        begins = _let(F.transform(chunks, total), lambda sums: F.transform(sums, lambda _, i: total(first(sums, i))))
        return _let(begins, lambda begin: F.flatten(F.transform(chunks, lambda c, i: F.transform(c, lambda _, k: F.get(begin, i) + total(first(c, k))))))

    def chunked(sizes: Column) -> Column:
        n_chunks = F.ceil(F.size(sizes) / CHUNK).cast("int")
        at = F.sequence(F.lit(0), F.greatest(n_chunks - 1, F.lit(0)))
        return _let(F.transform(at, lambda k: F.slice(sizes, k * CHUNK + 1, F.lit(CHUNK))), of_chunks)

    return _let(sizes, chunked)


def pieces(rows: DataFrame, key: list[str], text: str, pattern: str) -> DataFrame:
    """key, place, start, piece: a text cut into the pattern's matches, which must cover it."""
    placed = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda cut: F.arrays_zip(
        cut.alias("piece"), starts(F.transform(cut, F.char_length)).alias("start")))
    x = rows.select(*key, F.posexplode(placed).alias("place", "x"))
    return x.select(*key, "place", "x.piece", F.col("x.start").cast("long").alias("start"))


def words(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, start, end (inclusive), word: runs without blanks."""
    x = pieces(rows, key, text, r"\S+\s*|\s+").filter(~F.col("piece").rlike(r"^\s"))
    x = x.select(*key, "start", F.rtrim("piece", F.lit(" \t\n\v\f\r")).alias("word"))
    return x.select(*key, "start", (F.col("start") + F.char_length("word") - 1).alias("end"), "word")


def reference_index(items: DataFrame, regular: DataFrame, now: int) -> DataFrame:
    """list, list_block, reference, token, at, kind of number, name or year: the item's leading number; the capitalized
    words before its first year or opening quote, in lower case, less regular words; its first year.
    items: list, list_block, reference, text."""
    from folia.operators.references import item_id

    own = ["list", "list_block", "reference"]
    x = items.select(*own, "text", F.posexplode(F.regexp_extract_all("text", F.lit(r"""[\p{L}\p{N}]+|["“«‘]"""), F.lit(0))).alias("at", "word"))
    stop = is_year(F.col("word"), now) | F.col("word").rlike("""^["“«‘]""")
    before = Window.partitionBy(*own, "text").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("__stopped", F.coalesce(F.max(stop.cast("int")).over(before), F.lit(0)))
    x = x.withColumn("__years", F.coalesce(F.sum(is_year(F.col("word"), now).cast("int")).over(before), F.lit(0)))
    names = x.filter((F.col("__stopped") == 0) & (F.char_length("word") >= 2) & F.col("word").rlike(r"^\p{Lu}")).withColumn("token", F.lower("word"))
    names = names.join(regular.select(F.col("word").alias("token")).distinct(), "token", "left_anti").select(*own, "token", "at", F.lit("name").alias("kind"))
    years = x.filter((F.col("__years") == 0) & is_year(F.col("word"), now)).select(*own, F.col("word").alias("token"), "at", F.lit("year").alias("kind"))
    numbers = items.select(*own, item_id(F.col("text")).cast("string").alias("token"), F.lit(0).alias("at"), F.lit("number").alias("kind"))
    return numbers.unionByName(names).unionByName(years)


def name_year_marks(rows: DataFrame, index: DataFrame, now: int) -> DataFrame:
    """doc_id, block, start, end, word, kind, list, reference, at: years, matched or not, and words that the index of a
    later list knows as names. rows: doc_id, block, text; index: doc_id besides the columns of reference_index."""
    w = words(rows, ["doc_id", "block"], "text").withColumn("kind", F.when(is_year(F.col("word"), now), "year").otherwise("name"))
    w = w.filter((F.col("kind") == "year") | ~F.col("word").rlike("^[0-9]")).withColumn("token", F.lower("word"))
    i = index.filter("token is not null").select("doc_id", "token", "list", "list_block", "reference", "at")
    hit = w.join(i, ["doc_id", "token"]).filter("block < list_block").drop("list_block", "token")
    lone = w.filter("kind = 'year'").drop("token").join(hit.select("doc_id", "block", "start"), ["doc_id", "block", "start"], "left_anti")
    return hit.unionByName(lone, allowMissingColumns=True)


def superscript_marks(spans: DataFrame, key: list[str]) -> DataFrame:
    """key, start, end, mark, numbers, is_range: digits set as superscripts, one row for each part between commas; a
    range gives its ends, the smaller first. spans: key, place, text, sup."""
    shown = F.when(F.col("sup"), F.col("text")).otherwise(F.repeat(F.lit("\u0001"), F.char_length("text")))
    line = spans.select(*key, F.struct("place", shown.alias("s")).alias("x")).groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "").alias("line"))
    found = pieces(line, key, "line", r"[0-9][0-9,–-]*|(?s:.)").filter(F.col("piece").rlike("^[0-9]"))
    found = found.withColumn("end", F.col("start") + F.char_length("piece") - 1).select(*key, "start", "end", F.explode(F.split("piece", ",")).alias("mark"))
    numbers = F.transform(F.regexp_extract_all("mark", F.lit("[0-9]{1,9}"), F.lit(0)), lambda n: n.cast("int"))
    return found.withColumn("numbers", F.array_sort(numbers)).filter(F.size("numbers").between(1, 2)).withColumn("is_range", F.size("numbers") == 2)


def label_word(word: Column) -> Column:
    """The caption label that a word names, such as figure for '(Fig.'."""
    bare = F.lower(F.regexp_replace(word, r"^[^\p{L}]+|[^\p{L}]+$", ""))
    return F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[bare]


def figure_marks(rows: DataFrame, captions: DataFrame) -> DataFrame:
    """doc_id, block, start, end, label, number, caption: a label word and the number after it, where a caption has both.
    rows: doc_id, block, text; captions: doc_id, label, number (string), caption (the first with both counts)."""
    w = words(rows, ["doc_id", "block"], "text")
    after = Window.partitionBy("doc_id", "block").orderBy("start")
    x = w.withColumn("__after", F.lead("word").over(after)).withColumn("end", F.lead("end").over(after))
    x = x.withColumn("label", label_word(F.col("word"))).withColumn("number", F.regexp_extract("__after", "^([0-9]+)", 1)).filter("label is not null and number <> ''")
    first = captions.groupBy("doc_id", "label", "number").agg(F.min("caption").alias("caption"))
    return x.drop("word", "__after").join(first, ["doc_id", "label", "number"])


def paired(marks: list[tuple[str, str, dict]]) -> list[tuple[int, int, list[str]]]:
    """(mark, reference, years by nearness) for the names among a block's ordered marks: (kind, word, reference to place
    in the item). From a name, marks on either side count up to the first without a reference in common."""
    out = []
    for i, (kind, _, own) in enumerate(marks):
        if kind != "name":
            continue
        years: dict[int, dict[str, int]] = {r: {} for r in own}
        for side in (range(i - 1, -1, -1), range(i + 1, len(marks))):
            for j in side:
                other_kind, word, refs = marks[j]
                common = own.keys() & refs.keys()
                if not common:
                    break
                for r in common if other_kind == "year" else ():
                    years[r][word] = min(abs(i - j), years[r].get(word, abs(i - j)))
        near = {r: min(map(str, y.values()), default="0") for r, y in years.items()}
        for r in sorted(own, key=lambda r: (own[r], -int(near[r]), r)):
            out.append((i, r, sorted(years[r], key=lambda y: (years[r][y], y))))
    return out


def names_with_years(marks: DataFrame) -> DataFrame:
    """doc_id, block, list, start, reference, rank (from 1), years. marks: the rows of name_year_marks."""
    refs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("reference", "at"))))
    one = marks.dropna(subset=["list"]).groupBy("doc_id", "block", "list", "start", "kind", "word", "reference").agg(F.min("at").alias("at"))
    one = one.groupBy("doc_id", "block", "list", "start", "kind", "word").agg(refs.alias("refs"))
    gathered = one.groupBy("doc_id", "block", "list").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "word", F.map_entries("refs").alias("refs")))).alias("marks"))

    def run(frames):
        for f in frames:
            out = []
            for doc, block, name, ms in zip(f.doc_id, f.block, f["list"], f.marks, strict=True):
                found = paired([(m["kind"], m["word"], {r["key"]: r["value"] for r in m["refs"]}) for m in ms])
                rank: dict[int, int] = {}
                for i, r, years in found:
                    rank[i] = rank.get(i, 0) + 1
                    out.append((doc, block, name, ms[i]["start"], r, rank[i], years))
            yield pd.DataFrame(out, columns=["doc_id", "block", "list", "start", "reference", "rank", "years"])

    return gathered.mapInPandas(run, "doc_id long, block long, list long, start long, reference long, rank int, years array<string>")


def expanded(citations: DataFrame, references: DataFrame) -> DataFrame:
    """A row per reference that a numeric citation stands for: doc_id, citation, list, reference. A single number names
    its reference; a range all those of its list from the first end's place to the second's. citations: doc_id,
    citation, list, low, high (null for a single number); references: doc_id, list, reference, number, place."""
    key = ["doc_id", "list"]
    at = references.filter("number is not null").groupBy(*key, "number").agg(F.min("place").alias("at"))
    x = citations.join(at.withColumnsRenamed({"number": "low", "at": "from"}), [*key, "low"])
    x = x.join(at.withColumnsRenamed({"number": "high", "at": "to"}), [*key, "high"], "left").filter("high is null or to is not null")
    x = x.select(*key, "citation", F.explode(F.when(F.coalesce("to", "from") >= F.col("from"), F.sequence("from", F.coalesce("to", "from")))).alias("place"))
    return x.join(references.select(*key, "reference", "place"), [*key, "place"]).select("doc_id", "citation", "list", "reference")
