"""What keeps a task's memory and the work from growing faster than the input."""

import re

import pytest

from folia.operators import sequences as Q
from folia.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["region_overlay", "label_blocks", "page_map_scores", "block_context"])
def test_rows_are_dealt_by_size(spark, monkeypatch, name):
    """Twice the rows give about twice the tasks, not tasks of twice the size."""
    parts = {}
    for size in (4_000, 2_000):
        monkeypatch.setattr(Q, "PART_BYTES", size)
        parts[size] = registry.queries()[name](spark, SF).rdd.getNumPartitions()
    assert parts[2_000] >= 1.8 * parts[4_000] > 2 * spark.sparkContext.defaultParallelism


def _plan(spark, name):
    return registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["epub_packages", "annotations_split", "page_block_text", "page_dom_map", "page_dom_index"])
def test_python_holds_a_row_at_a_time(spark, name):
    assert "MapInPandas" not in _plan(spark, name) and "MapInArrow" in _plan(spark, name)


def test_results_go_on_in_small_batches(spark, monkeypatch):
    import pyarrow as pa

    from folia.sources import by_row

    sent = []
    rows = spark.createDataFrame([(1, 3), (2, 0), (3, 5)], "k long, n int")
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, schema: sent.extend(run([pa.RecordBatch.from_pandas(self.toPandas())])))
    by_row.by_row(rows, lambda k, n: ((k, "x" * 1_000_000) for _ in range(n)), "k long, s string")
    assert [b.column(0).to_pylist() for b in sent] == [[1, 1], [1, 3], [3, 3], [3, 3]]


@pytest.mark.parametrize("name, stages", [("epub_note_links", 2), ("epub_contents_places", 4)])
def test_books_are_read_once(spark, name, stages):
    """One stage packs and one reads, for the contents besides one each; before, every join read them again."""
    assert _plan(spark, name).count("MapInArrow") == stages and "Join" not in _plan(spark, name)


def test_offsets_need_no_exchange(spark):
    from folia.operators import citations as C

    lines = [(1, "  a bb" + " \t" * 40 + " ccc" * 70 + " d "), (2, ""), (3, None), (4, "x")]
    got = C.words(spark.createDataFrame(lines, "k int, t string"), ["k"], "t")
    want = [(k, m.start(), m.end() - 1, m[0]) for k, t in lines for m in re.finditer(r"[^ \t]+", t or "")]
    assert sorted(map(tuple, got.collect())) == want
    assert "Window" not in _plan(spark, "word_offsets")
