"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DIR}/{name}')")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    cursor = duck.execute(entry.oracle_sql()[name])
    places = [[d[0] for d in cursor.description].index(c) for c in columns]
    assert len(cursor.description) == len(columns)
    want = sorted(str(tuple(plain(row[k]) for k in places)) for row in cursor.fetchall())
    assert sorted(str(tuple(plain(r[c]) for c in columns)) for r in df.collect()) == want


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_whole_orders(spark):
    n = entry.plans.vox(spark, DIR).count()
    for name in ("sort_y_desc_all", "line_sort_y_desc_all", "line_reverse_all"):
        assert sorted(r.place for r in entry.queries()[name](spark, DIR).select("place").collect()) == list(range(1, n + 1))


def test_components_of_no_edges(spark):
    from lattica.operators.graph import connected_components

    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("name", ["log_reach", "axis_check_exact", "l_shape_cells", "square_cells", "orphan_split"])
def test_tree_checks_ask_for_exact_trees(monkeypatch, name):
    class Asked(Exception):
        pass

    def components(cells, exact=True):
        raise Asked(exact)

    monkeypatch.setattr(entry.plans, "_cells", lambda spark, d: None)
    monkeypatch.setattr(entry.plans.trees, "components", components)
    with pytest.raises(Asked) as asked:
        entry.plans.QUERIES[name](None, "")
    assert asked.value.args == (True,)
