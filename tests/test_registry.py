"""Every registered query against its DuckDB twin, and the HTML goldens' invariants."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from folia.plans import registry
from folia.sources.html import tree

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    if name not in registry.oracle_sql():
        assert len(got)
        return
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    for x in (got, want):  # the engines' time units differ
        for c in x.select_dtypes("datetime").columns:
            x[c] = x[c].astype("datetime64[us]")
    order = lambda x: x[cols].sort_values(cols).reset_index(drop=True)
    assert len(want)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)


def test_intervals():
    rows = tree("<div><p>a<b>b<p>c</div><ul><li>x<li>y</ul>")
    assert [r[5] for r in rows if r[4] == "element"] == ["div", "p", "b", "p", "ul", "li", "li"]
    for pre, last, parent, *_ in rows:
        assert pre <= last and (parent == -1 or rows[parent][0] < pre <= last <= rows[parent][1])
