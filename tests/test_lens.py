"""The graph lens over all rows of its tables, against the inventory's definitions."""

import os
from collections import Counter

import pytest

import __spark_entry__ as entry
from loomgraph.plans import lens
from tests.test_queries import SMALL, plain

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
#: The quantity cuts that LENS_SQL has and the inventory doesn't.
CUTS = [("lineitem WHERE l_quantity >= 45", "lineitem"), ("lineitem WHERE l_quantity <= 5", "lineitem"), ("FROM lineitem WHERE l_quantity BETWEEN 10 AND 12", "FROM lineitem"), (" AND l_quantity BETWEEN 20 AND 22", "")]


def whole(sql: str, keep_calls: bool = False) -> str:
    for cut, all_rows in CUTS[keep_calls:]:
        sql = sql.replace(cut, all_rows)
    return sql


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{file}{'/*' if os.path.isdir(f'{sf_dir}/{file}') else ''}')")
    return con


def test_edges_come_from_every_lineitem(spark):
    want = connect(SMALL).execute("SELECT count(*), count(*) FILTER (l_orderkey % 11 = 0), count(DISTINCT (l_partkey, l_suppkey)) FROM lineitem").fetchone()
    edges = lens.edges(spark, SMALL)
    of_orders = Counter(r.type for r in edges.where(f"source_id >= {lens.ORDER} and source_id < {lens.CHANNEL}").select("type").collect())
    assert of_orders == {"CALLS": want[0], "USAGE": want[0], "TESTS": want[1]}
    assert edges.where("type = 'IMPORTS'").count() == want[2]


@pytest.mark.parametrize("name", ["op31_incident_counts", "op32_unreferenced", "op41_boundary_edges", "op54_hotspots", "op59_invariants", "op110_bfs_both", "op151_find_tests", "op153_impact_findings", "op180_path_groups"])
def test_rows_equal_the_sql_without_cuts(spark, name):
    got = entry.queries()[name](spark, SMALL)
    want = connect(SMALL).execute(whole(entry.oracle_sql()[name], keep_calls=name == "op32_unreferenced"))
    names = [c[0] for c in want.description]
    assert Counter(tuple(map(plain, r)) for r in got.select(*names).collect()) == Counter(tuple(map(plain, r)) for r in want.fetchall())


def test_depths_equal_the_sql_with_methods(spark):
    sql = whole(entry.oracle_sql()["op116_transitive_depth"]).replace("kind = 'Function'", "kind IN ('Function', 'Method')")
    want = Counter(connect(SMALL).execute(sql).fetchall())
    assert Counter(tuple(r) for r in entry.queries()["op116_transitive_depth"](spark, SMALL).select("id", "depth").collect()) == want


def test_the_lens_broadcasts_no_customers(spark):
    nodes = lens.nodes(spark, SMALL)
    # the side of places is 25 rows, but its size is taken for the product of two tables': the other side was sent, 67 MB of rows at 60 times sf0.1
    plan = nodes._jdf.queryExecution().sparkPlan().toString()
    assert "BuildLeft" not in plan and plan.count("BuildRight") >= 2
    want = connect(SMALL).execute(f"{lens.LENS_SQL} SELECT id, qualified_name, file_path FROM g_nodes WHERE kind IN ('Class', 'Interface')").fetchall()
    assert Counter(tuple(r) for r in nodes.where("kind in ('Class', 'Interface')").select("id", "qualified_name", "file_path").collect()) == Counter(want)
