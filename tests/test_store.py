"""Merges into the stored graph, composite tools and sinks."""

import json

from loomgraph.operators import graph_stats, store, tools
from tests.conftest import rows_of
from tests.test_graph import EDGES, NODES, edges, node

STORED = "id long, project string, qualified_name string, kind string"
LINKS = "id long, project string, source_id long, target_id long, type string, properties string"


def test_upsert_nodes_keeps_ids(frame):
    stored = frame(STORED, [(1, "p", "a", "Function"), (2, "p", "b", "Function"), (7, "q", "a", "Class")])
    incoming = frame("project string, qualified_name string, kind string, ord int", [("p", "a", "Method", 1), ("p", "a", "Class", 2), ("p", "new", "Class", 3), ("r", "new", "Class", 4)])
    got = rows_of(store.upsert_nodes(stored, incoming, "ord"))
    assert {r[0]: r[1:] for r in got if r[0] <= 7} == {1: ("p", "a", "Class"), 2: ("p", "b", "Function"), 7: ("q", "a", "Class")}
    assert {r[1:] for r in got if r[0] in (8, 9)} == {("p", "new", "Class"), ("r", "new", "Class")} and len(got) == 5
    again = store.upsert_nodes(store.upsert_nodes(stored, incoming, "ord"), incoming, "ord")
    assert rows_of(again) == got


def test_upsert_edges_keeps_parallel_ones(frame):
    stored = frame(LINKS, [(1, "p", 1, 2, "CALLS", '{"line":1}'), (2, "p", 1, 2, "CALLS", None)])
    incoming = frame(LINKS.replace("id long, ", "", 1), [("p", 1, 2, "CALLS", '{"line":1}'), ("p", 1, 2, "CALLS", '{"line":9}'), ("p", 1, 2, "CALLS", '{"line":9}'), ("p", 1, 2, "CALLS", None)])
    assert rows_of(store.upsert_edges(stored, incoming).select("id", "properties")) == [(1, '{"line":1}'), (2, None), (3, '{"line":9}')]


def test_delete_cascades(frame):
    nodes = frame(NODES, [node(1, "Function", "a"), node(2, "Function", "b", file="src/b.ts"), node(3, "Function", "c", file="src/b.ts")])
    links = edges(frame, [(1, 2), (2, 3), (3, 1)])
    evidence = frame("edge_id long, strength double", [(1, 0.5), (2, 0.5)])
    kept = store.delete_files(nodes, links, evidence, frame("file_path string", [("src/a.ts",)]))
    assert [sorted(r[0] for r in rows_of(k)) for k in kept] == [[2, 3], [2], [2]]


def test_compare_runs(frame):
    schema = "id long, project string, run_at string, mode string, total_nodes long, total_edges long, avg_complexity double"
    rows = [(1, "p", "t1", "full", 10, 20, 3.0), (2, "p", "t2", "full", 12, 19, 2.875), (3, "q", "t1", "fast", 1, 1, 1.0)]
    assert rows_of(store.compare_runs(frame(schema, rows))) == [("p", "t2", 2, -1, -0.12, True), ("q", "t1", None, None, None, False)]


def test_find_tests_levels(frame):
    nodes = frame(NODES, [node(1, "Function", "a"), node(2, "Function", "b"), node(3, "Function", "c", file="src/c.ts"), node(9, "Function", "t", file="t/x.test.ts")])
    links = edges(frame, [(9, 1)], "TESTS")
    assert rows_of(tools.find_tests(nodes, links, nodes.where("id < 9"))) == [(1, "symbol", 1), (2, "file", 1), (3, "none", 0)]


def test_digest_ratio_and_status(frame):
    nodes = frame(NODES, [node(1, "Function", "a"), node(2, "Function", "b")])
    one, two = tools.digest(nodes, edges(frame, [(1, 2)])), tools.digest(nodes, edges(frame, [(1, 2), (2, 1)]))
    assert tools.changed_ratio(one, one).first()[0] == 0 and tools.changed_ratio(one, two).first()[0] > 0
    assert [r.status for r in tools.index_status(nodes, frame(EDGES, [])).collect()] == ["unresolved"]


def test_findings(frame):
    schema = "id long, target_file string, category string, title string, description string, created_at string"
    rows = frame(schema, [(1, "a", "size", "Big thing", "", "t1"), (2, "b", "size", "x", "another big one", "t2"), (3, "b", "risk", "x", "y", "t3")])
    assert [r.id for r in tools.findings_matching(rows, "the big").collect()] == [2, 1]
    assert [r.id for r in tools.findings_matching(rows, file="b", category="risk").collect()] == [3]
    assert [r.id for r in tools.findings_matching(rows, limit=2).collect()] == [3, 2]


def test_sinks(frame, spark, tmp_path):
    rows = frame("a int, b string", [(1, None), (2, "x|y")])
    tools.write_jsonl(rows, str(tmp_path / "out"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(lines, key=lambda r: r["a"]) == [{"a": 1, "b": None}, {"a": 2, "b": "x|y"}]
    assert tools.markdown(rows.orderBy("a")) == "| a | b |\n| - | - |\n| 1 |  |\n| 2 | x\\|y |"


def test_suffixes_of_paths(frame):
    wanted, paths = frame("wanted string", [("x/src/a.ts",), ("b.ts",), ("none.ts",)]), frame("path string", [("src/a.ts",), ("lib/a.ts",), ("p/b.ts",), ("q/b.ts",)])
    assert rows_of(graph_stats.unique_longest_suffix(wanted, paths)) == [("x/src/a.ts", "src/a.ts", 2)]
    got = tools.suffix_either_way(frame("a string", [("repo/src/a.ts",), ("a.ts",)]), paths.withColumnRenamed("path", "b"))
    assert rows_of(got) == [("a.ts", "lib/a.ts"), ("a.ts", "src/a.ts"), ("repo/src/a.ts", "src/a.ts")]
