"""Monospace grids, overlays, label paths and blocks against plain versions."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from folia.operators import citations, layout


def chars(line, text, width=6.0, x=72.0, mono=True):
    return [(1, 0, line, i, c, x + i * width, x + (i + 1) * width, mono) for i, c in enumerate(text)]


def test_mono_grid(spark):
    rows = chars(0, "plain", mono=False) + chars(1, "  code") + chars(2, "more code") + chars(3, "x = 1") + chars(4, "text", mono=False) + chars(5, "one") + chars(6, "two")
    off = [(1, 1, n, i, "c", 72 + i * 6 + 2.5 * (i % 2), 78 + i * 6 + 2.5 * (i % 2), True) for n in range(3) for i in range(8)]
    gap = [(2, 0, *r[2:]) for r in chars(0, "ab") + chars(1, "  ") + chars(2, "cd") + chars(3, "ef")]
    df = spark.createDataFrame(rows + off + gap, "doc_id long, page int, line int, ord int, c string, x1 double, x2 double, mono boolean")
    got = layout.mono_grid_regions(df).collect()
    assert [(r.doc_id, r.page, r.first_line, r.last_line, r.n_lines, r.width, r.grid_share) for r in got] == [(1, 0, 1, 3, 3, 6.0, 1.0)]
    assert layout.mono_grid_regions(df.limit(0)).count() == 0


def test_mono_grid_weighs_lines_as_wholes(spark):
    """Characters aren't dealt out: what goes through exchanges has a row per line, and each cell is made once."""
    from folia.plans import registry

    plan = registry.queries()["mono_grid_regions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "posexplode(split(line" not in plan
    mixed = [(1, 0, 0, [(0, "a", 72.0, 78.0, True), (1, "b", 78.0, 83.0, True), (2, "c", 84.0, 90.0, True)]), (1, 0, 1, [(0, "d", 72.0, 78.0, True), (1, "e", None, 84.0, True)]), (1, 0, 2, [(0, "f", 72.0, 78.0, True), (1, "\u00a0", 72.5, 78.5, True)]), (1, 0, 3, [])]
    df = spark.createDataFrame(mixed, "doc_id long, page int, line int, chars array<struct<ord:int,c:string,x1:double,x2:double,mono:boolean>>")
    assert [tuple(r) for r in layout.mono_grid_lines(df).select("first_line", "last_line", "n_lines", "width", "grid_share").collect()] == [(0, 2, 3, 6.0, 1.0)]


def test_overlay(spark):
    blocks = spark.createDataFrame([(1, 0, 0, 9, "a"), (1, 0, 10, 19, "b"), (1, 0, 20, 29, "c"), (1, 0, 30, 39, "d"), (2, 0, 0, 5, "e")], "doc_id long, page int, start int, end int, type string")
    regions = spark.createDataFrame([(1, 0, 5, 14), (1, 0, 22, 24)], "doc_id long, page int, start int, end int")
    got = sorted((r.doc_id, r.start, r.end, r.type) for r in layout.overlaid(blocks, regions).collect())
    assert got == [(1, 0, 4, "a"), (1, 5, 14, "preformatted"), (1, 15, 19, "b"), (1, 20, 21, "c"), (1, 22, 24, "preformatted"), (1, 25, 29, "c"), (1, 30, 39, "d"), (2, 0, 5, "e")]


def test_best_labels(spark):
    rng = np.random.default_rng(3)
    moves, begin, finish = rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3)
    pages, want = [], {}
    for page in range(4):
        s = rng.normal(size=(page + 1, 3))
        pages += [(1, page, k, row.tolist()) for k, row in enumerate(s)]
        value = lambda p: begin[p[0]] + finish[p[-1]] + sum(s[i, k] for i, k in enumerate(p)) + sum(moves[a, b] for a, b in itertools.pairwise(p))  # noqa: E731, B023
        want[page] = max(itertools.product(range(3), repeat=page + 1), key=value)
    df = spark.createDataFrame(pages, "doc_id long, page int, line int, scores array<double>")
    got = layout.best_labels(df, moves.tolist(), begin.tolist(), finish.tolist()).orderBy("page", "line").collect()
    assert {p: tuple(r.label for r in got if r.page == p) for p in range(4)} == want


def test_label_blocks(spark):
    df = spark.createDataFrame([(1, 0, k, b, c) for k, (b, c) in enumerate([("body", True), ("body", True), ("body", False), ("list", True), ("list", None), (None, False)])], "doc_id long, page int, line int, base string, continues boolean")
    got = sorted((r.block, r.base, r.first_line, r.last_line, r.n_lines) for r in layout.label_blocks(df).collect())
    assert got == [(0, "body", 0, 1, 2), (1, "body", 2, 2, 1), (2, "list", 3, 3, 1), (3, "list", 4, 4, 1), (4, None, 5, 5, 1)]


def test_expanded(spark):
    refs = spark.createDataFrame([(1, 9, 100 + p, n, p) for p, n in enumerate([1, 2, 3, None, 5])], "doc_id long, list long, reference long, number int, place int")
    cites = spark.createDataFrame([(1, 0, 9, 2, None), (1, 1, 9, 2, 5), (1, 2, 9, 7, None), (1, 3, 9, 1, 8), (1, 4, 9, 5, 1)], "doc_id long, citation long, list long, low int, high int")
    assert sorted((r.citation, r.reference) for r in citations.expanded(cites, refs).collect()) == [(0, 101), (1, 101), (1, 102), (1, 103), (1, 104)]
