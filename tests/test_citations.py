"""Outlines and citations on small documents."""

from pyspark.sql import functions as F

from folia.operators import citations as C
from folia.operators import outline as O


def test_number_parts(spark):
    titles = ["1.2.3 On", "A.1: x", "IV.2", "Introduction", "A study", "1) x", "Version 2", "12a", None, ""]
    x = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string").select("i", O.number_parts(F.col("t")).alias("p"), O.mostly_upper(F.col("t")).alias("u"))
    assert [r.p for r in x.orderBy("i").collect()] == [["1", "2", "3"], ["A", "1"], ["IV", "2"], [], ["A"], ["1"], [], [], [], []]
    y = spark.createDataFrame([("ABCDEF+Times Bold", 11.3, "ALL CAPS"), (None, None, None), ("X+", 12.25, "Low")], "f string, s double, t string")
    assert [r[0] for r in y.select(O.style(F.col("f"), F.col("s"), F.col("t"))).collect()] == ["Times Bold|11.5|true", "|0.0|false", "X+|12.5|false"]


def item(block, style, n_parts=0, depth=None, top=False):
    return {"block": block, "style": style, "n_parts": n_parts, "depth": depth, "top": top}


def test_levels():
    assert O.levelled([item(0, "a"), item(1, "b"), item(2, "b"), item(3, "a"), item(4, "b")]) == [(0, 1, None), (1, 2, 0), (2, 2, 0), (3, 1, None), (4, 2, 3)]
    assert O.levelled([item(0, "a", 1), item(1, "b", 2), item(2, "a", 1), item(3, "b", 4)]) == [(0, 1, None), (1, 2, 0), (2, 1, None), (3, 2, 2)]
    # a lone style that holds others is passed over, one at the top isn't
    assert O.levelled([item(0, "t"), item(1, "a"), item(2, "a")]) == [(1, 1, None), (2, 1, None)]
    assert O.levelled([item(0, "t", top=True), item(1, "a"), item(2, "a")]) == [(0, 1, None), (1, 2, 0), (2, 2, 0)]


def test_outline_tables(spark):
    rows = [(1, b, 0, 700.0 - b, t, f, s) for b, (t, f, s) in enumerate([("1 One", "B", 14.0), ("1.1 Sub", "B", 12.0), ("Free", "C", 10.0), ("2 Two", "B", 14.0), ("2.1 Sub", "B", 12.0), ("References", "Z", 9.0)])]
    heads = spark.createDataFrame([*rows, (2, 0, None, None, None, None, None)], "doc_id long, block long, page int, y double, title string, font string, size double")
    none = spark.createDataFrame([], "doc_id long, style string, depth int")
    got = O.heading_outline(heads, none, "doc_id").filter("doc_id = 1").orderBy("block").collect()
    assert [(r.block, r.level, r.parent) for r in got] == [(0, 1, None), (1, 2, 0), (2, 3, 1), (3, 1, None), (4, 2, 3), (5, 1, None)]
    assert O.heading_outline(heads.limit(0), none, "doc_id").count() == 0
    native = spark.createDataFrame([(1, 0, 0, "1  one", 0), (1, 1, 0, "1 One", 0), (1, 2, 0, "nowhere", 1), (1, 3, None, "Free", 1)], "doc_id long, ord int, page int, title string, depth int")
    assert [(r.block, r.title) for r in O.native_matches(native, heads, "doc_id").collect()] == [(0, "1 One")]
    blocks = spark.createDataFrame([(1, 7, "paragraph", "Run in. Then text", "C", 9.0, "C", 10.0), (1, 8, "note", "No", "C", 9.0, "C", 10.0), (1, 9, "paragraph", "Same", "C", 10.0, "C", 10.0)],
                                   "doc_id long, block long, type string, title string, font string, size double, first_font string, first_size double")
    assert [r.block for r in O.inline_headings(blocks, heads, "doc_id").collect()] == [7]
    assert O.cut_title("Heading one and text", "Heading onee") == "Heading one"


def test_index_and_marks(spark):
    regular = spark.createDataFrame([("the",)], "word string")
    items = spark.createDataFrame([(9, 50, 1, '[1] Smith, J., The Jones 1999 "Title"'), (9, 50, 2, "Brown, K. “Quoted Name” 2001, 2002"), (9, 50, 3, None)], "list long, list_block long, reference long, text string")
    index = C.reference_index(items, regular, 2025)
    assert sorted((r.reference, r.token or "", r.kind) for r in index.collect()) == [
        (1, "1", "number"), (1, "1999", "year"), (1, "jones", "name"), (1, "smith", "name"), (2, "", "number"), (2, "2001", "year"), (2, "brown", "name"), (3, "", "number")]
    index = index.withColumn("doc_id", F.lit(1).cast("long"))
    text = spark.createDataFrame([(1, 3, "As Smith and Jones 1999 or Brown 2001 say in 1875 .", "k"), (1, 60, "Smith 1999", "k"), (1, 4, None, "k"), (1, 5, "", "k")], "doc_id long, block long, text string, word string")
    marks = C.name_year_marks(text, index, 2025)
    got = sorted((r.block, r.start, r.word, r.kind, r.reference) for r in marks.collect() if r.block == 3)
    assert got == [(3, 3, "Smith", "name", 1), (3, 13, "Jones", "name", 1), (3, 19, "1999", "year", 1), (3, 27, "Brown", "name", 2), (3, 33, "2001", "year", 2), (3, 45, "1875", "year", None)]
    pairs = sorted((r.start, r.reference, r.rank, tuple(r.years)) for r in C.names_with_years(marks).collect())
    assert pairs == [(3, 1, 1, ("1999",)), (13, 1, 1, ("1999",)), (27, 2, 1, ("2001",))]


def test_superscripts_and_figures(spark):
    spans = spark.createDataFrame([(1, 0, "As 12 said", False), (1, 1, "3,7-5", True), (1, 2, ",9", True), (1, 3, " 8", False), (2, 0, "x", True), (2, 1, "4", True), (3, 0, None, None)], "block long, place int, text string, sup boolean")
    got = sorted((r.block, r.start, r.end, r.mark, r.numbers, r.is_range) for r in C.superscript_marks(spans, ["block"]).collect())
    assert got == [(1, 10, 16, "3", [3], False), (1, 10, 16, "7-5", [5, 7], True), (1, 10, 16, "9", [9], False), (2, 1, 1, "4", [4], False)]
    text = spark.createDataFrame([(1, 3, "see (Fig. 2a) and Table  1, Eq. 7")], "doc_id long, block long, text string")
    captions = spark.createDataFrame([(1, "figure", "2", 40), (1, "figure", "2", 41), (1, "table", "1", 42)], "doc_id long, label string, number string, caption long")
    assert sorted((r.start, r.end, r.caption) for r in C.figure_marks(text, captions).collect()) == [(4, 12, 40), (18, 26, 42)]
