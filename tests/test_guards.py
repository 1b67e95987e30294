"""Checked joins in both their ways, scoped SQL, and rows that no hash may drop."""

import os
import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomgraph import session
from loomgraph.operators import evidence, resolve, search, usage
from loomgraph.operators.history import entity_history
from loomgraph.operators.query_language import QueryError, guarded_sql
from loomgraph.operators.snapshot_diff import snapshot_changes
from tests.conftest import rows_of
from tests.test_graph import EDGES, EVIDENCE, NODES, node

ROOT, SMALL = Path(__file__).resolve().parents[1], "/root/testdata/sf0.001"


@pytest.fixture()
def two(frame):
    nodes = frame(NODES, [node(1, "Function", "a"), node(2, "Function", "b"), node(7, "Class", "secret", project="q")])
    edges = frame(EDGES, [(1, "p", 1, 2, "CALLS", 1), (2, "q", 7, 7, "CALLS", 1)])
    return nodes, edges


@pytest.mark.parametrize(
    "sql, rows",
    [
        ("SELECT n.id, e.id AS e FROM nodes n, edges e WHERE n.id = 1", [(1, 1)]),
        ("SELECT count(*) AS n FROM nodes, edges", [(2,)]),
        ("WITH nodes AS (SELECT 7 AS id) SELECT id FROM nodes", [(7,)]),
        ("WITH x AS (SELECT id FROM nodes), y AS (SELECT id FROM x) SELECT id FROM y ORDER BY id DESC;", [(1,), (2,)]),
        ("SELECT 'FROM nodes, edges {x}' AS t, name FROM nodes WHERE id = 1 -- done", [("FROM nodes, edges {x}", "a")]),
        ("SELECT name FROM nodes WHERE id IN (SELECT target_id FROM edges)", [("b",)]),
        ("SELECT (SELECT max(id) FROM nodes) AS m", [(2,)]),
        ("SELECT id FROM Nodes n WHERE EXISTS (SELECT 1 FROM EDGES e WHERE e.source_id = n.id)", [(1,)]),
        ("SELECT project FROM projects", [("p",)]),
    ],
)
def test_sql_sees_the_project_only(two, sql, rows):
    nodes, edges = two
    nodes.createOrReplaceTempView("nodes")  # whole tables under the same names
    edges.createOrReplaceTempView("edges")
    try:
        assert rows_of(guarded_sql(sql, nodes, edges, "p")) == rows
    finally:
        for name in ("nodes", "edges"):
            nodes.sparkSession.catalog.dropTempView(name)


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT * FROM secrets",
        "SELECT * FROM nodes, secrets",
        "SELECT * FROM nodes WHERE id IN (SELECT id FROM secrets)",
        "SELECT a FROM (SELECT (SELECT max(id) FROM secrets) AS a)",
        "WITH secrets AS (SELECT * FROM secrets) SELECT * FROM secrets",
        "SELECT * FROM (WITH secrets AS (SELECT 1 AS id) SELECT * FROM secrets) JOIN secrets",
        "SELECT * FROM default.nodes",
        "SELECT * FROM parquet.`/etc`",
        "SELECT * FROM range(3)",
        "SELECT 1) x, (SELECT * FROM secrets",
        "SELECT 1; DROP TABLE nodes",
        "DROP TABLE nodes",
        "INSERT INTO nodes SELECT 1",
        "WITH x AS (SELECT 1) INSERT INTO nodes SELECT * FROM x",
        "SELECT " + ", ".join(f"{i} AS c{i}" for i in range(60)) + ", (SELECT max(id) FROM secrets) AS s",
    ],
)
def test_sql_that_reads_more_is_refused(two, spark, sql):
    spark.range(3).createOrReplaceTempView("secrets")
    try:
        with pytest.raises(QueryError):
            guarded_sql(sql, *two, "p")
    finally:
        spark.catalog.dropTempView("secrets")


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
@pytest.mark.parametrize("table, run", [("semantic_entities", entity_history), ("nodes", snapshot_changes)])
def test_both_ways_of_a_bounded_join_agree(spark, monkeypatch, table, run):
    rows, snapshots = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in (table, "graph_snapshots"))
    broadcast = run(rows, snapshots)
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    shuffled = run(rows, snapshots)
    assert "strategy=broadcast" in plan_of(broadcast) and "strategy=broadcast" not in plan_of(shuffled)
    assert rows_of(broadcast) == rows_of(shuffled) != []


def test_bounded_join_measures_bytes(frame):
    left, right = frame("k int, v string", [(1, "a"), (2, "b"), (None, "c")]), frame("k int, t string", [(1, "x" * 100)])
    assert right.select(session.row_bytes(right)).first()[0] == 132
    for most, hint in ((132, True), (131, False)):
        got = session.bounded_join(left, right, ["k"], "left", most)
        assert ("strategy=broadcast" in plan_of(got)) == hint and got.count() == 3


def test_a_cluster_must_name_its_shared_folder():
    code = """
from types import SimpleNamespace as S
from loomgraph.session import shared_dir
conf = S(get=lambda *a: None)
try:
    shared_dir(S(conf=conf, sparkContext=S(master="spark://x:7077", getConf=lambda: conf)))
except RuntimeError as e:
    print(e)
"""
    assert "spark.checkpoint.dir" in subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120, capture_output=True, text=True).stdout


ARCHIVED = "id long, ts string, type string, project string, query_hash string, files_avoided int, tokens_saved long, event_id string, tool_hint string"


def test_events_with_one_label_are_kept(frame, monkeypatch):
    monkeypatch.setattr(usage, "fnv1a", lambda text: F.lit("00000000"))
    rows = [(i, f"2026-01-01T00:00:{i:02d}Z", "t", "p", None, None, 1, None, "") for i in range(20)]
    again = [(100, rows[0][1], "t", "p", "", 0, 1, None, ""), (101, rows[0][1], "t", "p", "", 0, 1, "keyed", "")]
    got = usage.without_legacy_repeats(frame(ARCHIVED, rows + again))
    assert sorted(r.id for r in got.collect()) == list(range(20))


@pytest.mark.parametrize("kind, hint, want", [("tool_observation", "detect_changes", "impact_analysis"), ("tool_observation", "unknown", "other"), ("tool_observation", "", "other"), ("tool_observation", None, "other"), ("architecture_overview", None, "architecture_overview"), ("detect_changes", None, "other"), ("search_code", "detect_changes", "direct_discovery"), (None, None, "other")])
def test_categories(frame, kind, hint, want):
    assert frame("k string, h string", [(kind, hint)]).select(usage.category(F.col("k"), F.col("h"))).first()[0] == want


def test_conflicting_evidence_is_refused(frame):
    at = datetime(2026, 1, 1)
    rows = [("r", "1", "ast", "supports", 0.8, "s", at), ("r", "1", "ast", "supports", 0.9, "s", at)]
    with pytest.raises(Exception, match="conflicting copies of evidence 1"):
        evidence.reconcile(frame(EVIDENCE, rows), "2026-01-01 00:00:00").collect()


def test_activity_over_slice_edges(frame):
    minutes = [0, 10, 1435, 1445, 1460, 2000, 2029, 2059, 4500]  # slices of a day: 1440 minutes
    rows = [(i, "p", m * 60_000_000) for i, m in enumerate(minutes)]
    got = rows_of(usage.activity(frame("id long, project string, at long", rows)).select("started", "n"))
    assert got == sorted([(0, 2), (1435 * 60_000_000, 3), (2000 * 60_000_000, 2), (2059 * 60_000_000, 1), (4500 * 60_000_000, 1)], key=repr)


def test_equal_matches_stay(frame):
    nodes = frame(NODES, [node(1, "Class", "A", start=1, end=50), node(2, "Method", "m", start=10, end=20)])
    matches = frame("file_path string, line int, content string", [("src/a.ts", 12, "x"), ("src/a.ts", 12, "x"), ("src/a.ts", 30, None), ("src/b.ts", 1, "y"), (None, 3, "z")])
    got = rows_of(search.enclosing_symbols(matches, nodes).select("file_path", "line", "content", "id"))
    assert got == sorted([("src/a.ts", 12, "x", 2), ("src/a.ts", 12, "x", 2), ("src/a.ts", 30, None, 1), ("src/b.ts", 1, "y", None), (None, 3, "z", None)], key=repr)


@pytest.mark.parametrize("name, test", [("test", True), ("it", True), ("testOpen", True), ("test_x", True), ("TestBox", True), ("Test", True), ("BenchmarkX", True), ("ExampleY", True), ("testing", False), ("should", False), ("openTest", False), ("Tested", False)])
def test_names_of_tests(frame, name, test):
    nodes = frame("id long, kind string, name string, qualified_name string, file_path string, start_line int, is_exported int", [(1, "Function", "caller", "t.caller", "tests/a.ts", 1, 1), (2, "Function", name, "a.f", "src/a.ts", 1, 1)])
    found = resolve.test_edges(nodes, frame("source_id long, target_id long, line int", []), frame("source_id long, target_id long, line int", [(1, 2, 3)]))
    assert (found.count() == 0) == test


@pytest.mark.parametrize("path, test", [("a/FooTest.java", True), ("a/FooSpec.scala", True), ("a/test_x.ts", True), ("a/x_spec.rb", True), ("a/x_test.go", True), ("a/__tests__/x.ts", True), ("test/x.ts", True), ("a/Tests/x.ts", False), ("a/contest.ts", False), ("a/latest/x.ts", False), ("a/x.spec.ts", True)])
def test_paths_of_tests(frame, path, test):
    from loomgraph.functions.texts import is_test_path

    assert frame("p string", [(path,)]).select(is_test_path(F.col("p"))["resolver"]).first()[0] is test


def test_nearest_rank(frame):
    rows = [("a", v) for v in range(1, 21)] + [("b", None), (None, 3), ("c", 5)]
    got = {r.g: (r.p50, r.p95, r.most) for r in usage.nearest_rank(frame("g string, v int", rows), "g", "v").collect()}
    assert got == {"a": (10, 19, 20), "b": (None, None, None), None: (3, 3, 3), "c": (5, 5, 5)}


@pytest.mark.parametrize("text, paths", [("switch (x) { case 1: break; default : y ?? z }", 5), ("do { } while (a)", 3), ("s = 'a && b' + \"c || d\" + `e ?? f`", 1), ("if (a) {} else if (b) {}", 3), ("default_value: 1; iffy()", 1)])
def test_cyclomatic(frame, text, paths):
    from loomgraph.functions.texts import cyclomatic

    assert frame("t string", [(text,)]).select(cyclomatic(F.col("t"))).first()[0] == paths
