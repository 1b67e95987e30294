"""Scanners of sources, HTTP calls, discovery, partitioned replacement, impact and walks."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomgraph.operators import resolve as R
from loomgraph.operators import rules, tools, traversal
from loomgraph.sources import manifests as M
from loomgraph.streaming import events as S
from tests.conftest import rows_of
from tests.test_graph import EDGES, NODES, edges, node


@pytest.mark.parametrize(
    "text, found",
    [
        ("const toolHandlers = { a: one, 'b c': two, nested: { x: y }, f: (a, b) => c, last: three };", [("toolHandlers", "one"), ("toolHandlers", "two"), ("toolHandlers", "three")]),
        ("let myMap: Record<string, F> = {\n // c: no,\n a: one, /* b: no, */\n d: ns.fn }", [("myMap", "one"), ("myMap", "ns")]),
        ("const handlers = { a: one }", []),  # the word is the whole name
        ("var theRegistry = { a: one }; const other = { b: two }", []),
        ("const aRegistry = { a: 'x, b: no', c: `}`, d: one", [("aRegistry", "one")]),
        ("const xDispatch = {}", []),
        ("", []),
    ],
)
def test_registries(text, found):
    if text.endswith("d: one"):  # a literal that is cut off gives the entries that end
        assert R.registries(text) == [] and R.registries(text + " }") == found
    else:
        assert R.registries(text) == found


@pytest.mark.parametrize("argument, url", [("'/a/b'", "/a/b"), (' "https://x/y" ', "https://x/y"), ("`/a/${id}/b`", "/a/:param/b"), ("`http${s}://x`", "http:param://x"), ("`/" + "x" * 200 + "`", "/" + "x" * 200), ("`/${a}" + "x" * 200 + "`", "/:param" + "x" * 93 + "..."), ("'text'", None), ("opts.baseUrl", "[dynamic]"), ("curl", None), ("'", None), ("", None), (None, None)])
def test_url_of(frame, argument, url):
    assert frame("a string", [(argument,)]).select(R.url_of(F.col("a"))).first()[0] == url


def test_kept_paths(frame):
    paths = ["src/a.py", "src/.git/HEAD", "lib/x/.git/HEAD", "lib/x/a.py", "lib/b.py", "node_modules/a.js", "a/dist/b.js", ".hidden/a.py", "gen/a.py", "sub/gen/a.py", "sub/only/b.py", "docs/readme.md", "b.py", "obj"]
    rows = [(p, None) for p in paths] + [(".gitignore", "# c\ngen/\n*.log\n"), ("sub/.gitignore", "/only\r\n")]
    kept = {r.path for r in M.kept_paths(frame("path string, content string", rows)).collect()}
    assert kept == {"lib/b.py", "sub/gen/a.py", "docs/readme.md", "b.py", "obj", ".gitignore", "sub/.gitignore"}
    assert "docs/readme.md" not in {r.path for r in M.kept_paths(frame("path string, content string", rows), fast=True).collect()}


def test_discover(spark, tmp_path):
    for path, text in (("a.py", "x"), ("Dockerfile", "FROM x"), ("lib/b.ts", "y"), ("skip/c.ts", "z"), ("notes.xyz", "n")):
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / ".gitignore").write_text("skip/\n")
    (tmp_path / "nested" / ".git").mkdir(parents=True)
    (tmp_path / "nested" / "a.py").write_text("n")
    (tmp_path / ".git").mkdir()
    assert rows_of(M.discover(spark, str(tmp_path)).select("path", "language", "content")) == [("Dockerfile", "dockerfile", "FROM x"), ("a.py", "python", "x"), ("lib/b.ts", "typescript", "y")]


def test_replace_parts(spark, frame, tmp_path):
    table = str(tmp_path / "t")
    extract = lambda batch: batch.select(F.col("path").alias("file_path"), F.explode(F.split("content", " ")).alias("name"))
    write = S.replace_parts(table, extract, parts=4)
    assert S.read_parts(spark, table) is None
    files = [(f"f{i}", f"x{i} y") for i in range(20)]
    write(frame("path string, content string", files), 0)
    for _ in range(2):  # the second is a repeated batch
        write(frame("path string, content string", [("f3", "new")]), 1)
    want = sorted([(f, n) for f, c in files if f != "f3" for n in c.split()] + [("f3", "new")], key=repr)
    assert rows_of(S.read_parts(spark, table)) == want
    write(frame("path string, content string", []), 2)
    assert rows_of(S.read_parts(spark, table)) == want
    assert sum(len(list((tmp_path / "t" / f"b{b}").glob("part=*"))) for b in (0, 1)) == 5  # batch 1 wrote one part


def test_assessment(frame):
    nodes = frame(NODES, [node(1, "Function", "a", file="src/a.ts"), node(2, "Function", "b", file="src/b.ts"), node(3, "Function", "t", file="tests/t.ts", test=1), node(4, "Function", "gone", file="src/gone.ts"), node(5, "Channel", "ch", file=""), node(6, "Function", "far", file="src/far.ts")])
    links = frame(EDGES, [(1, "p", 3, 1, "TESTS", 1), (2, "p", 2, 4, "CALLS", 1), (3, "p", 1, 2, "IMPORTS", 1), (4, "p", 1, 5, "EMITS", 1), (5, "p", 6, 5, "LISTENS_ON", 1), (6, "p", 2, 5, "EMITS", 1)])
    changed, deleted = frame("file_path string", [("src/a.ts",), ("new.ts",)]), frame("file_path string", [("src/gone.ts",)])
    got = rows_of(rules.assessment(nodes, links, changed, deleted, {"low": "src/a*", "high": "src/b*"}, [("low", "high")]))
    assert got == sorted([("covered_by", "src/a.ts", "m.t", "high"), ("no_callers", "src/a.ts", "m.a", "low"), ("deleted_in_use", "src/gone.ts", "m.gone", "high"), ("not_indexed", "new.ts", "", "low"), ("downstream", "src/b.ts", "", "medium"), ("async_dependent", "src/far.ts", "", "medium"), ("broken_rule", "src/a.ts", "m.a", "high")], key=repr)


def test_walk_with_edges_and_budget(frame):
    nodes = frame(NODES, [node(i, "Function", f"n{i}") for i in range(1, 8)])
    links = edges(frame, [(1, 2), (1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (4, 6), (7, 1)])
    start = nodes.where("id = 1")
    for walk in (None, traversal.prepared(links)):
        reached = traversal.bfs(links, start, "outbound", ("CALLS",), 2, walk=walk)
        assert rows_of(reached) == [(1, 0), (2, 1), (3, 1), (4, 2)]
        passed = traversal.walked(links, nodes, reached, "outbound", ("CALLS",), 2, walk)
        assert rows_of(passed.select("source_id", "target_id", "occurrences", "hop")) == [(1, 2, 2, 0), (1, 3, 1, 0), (2, 4, 1, 1), (3, 4, 1, 1)]
        assert rows_of(traversal.bfs(links, start, "outbound", None, 9, 2, walk)) == [(1, 0), (2, 1), (3, 1)]
        assert rows_of(traversal.bfs(links, start, "outbound", None, 9, 3, walk)) == [(1, 0), (2, 1), (3, 1), (4, 2)]
        both = traversal.bfs(links, start, "both", None, 1, walk=walk)
        assert rows_of(both) == [(1, 0), (2, 1), (3, 1), (7, 1)]
    entries = traversal.trace_entries(traversal.trace(nodes, links, "m.n4", "inbound", "auto", 1), nodes, traversal.walked(links, nodes, traversal.bfs(links, nodes.where("id = 4"), "inbound", None, 1), "inbound", None, 1))
    assert rows_of(entries.select("name", "hop", "kind")) == [("n2", 1, "direct_call"), ("n3", 1, "direct_call")]


def test_large_frontiers_are_joined_by_shuffle(frame, monkeypatch):
    monkeypatch.setattr(traversal, "FRONTIER_IDS", 0)
    links = edges(frame, [(i, i * 2) for i in range(1, 40)] + [(i, i * 2 + 1) for i in range(1, 40)])
    got = rows_of(traversal.bfs(links, links.selectExpr("source_id as id").where("id = 1"), "outbound", None, 4))
    assert got == sorted([(i, i.bit_length() - 1) for i in range(1, 32)], key=repr)


def test_tests_found_by_text(frame):
    nodes = frame(NODES, [node(1, "Function", "openBox"), node(2, "Function", "box"), node(3, "Function", "$x")])
    links = frame(EDGES, [])
    sources = frame("file_path string, content string", [("t1", "openBox(1); $x"), ("t2", "reopenBox openBox"), ("t3", None), ("t4", "")])
    assert rows_of(tools.find_tests_by_text(nodes, links, nodes, sources)) == [(1, "text", 2), (2, "none", 0), (3, "text", 1)]


def test_risk_of_symbols(frame):
    nodes = frame(NODES, [node(i, "Function", f"f{i}") for i in range(1, 30)])
    links = frame(EDGES, [(j * 100 + i, "p", i, t, k, 1) for j, (t, k, n) in enumerate([(1, "CALLS", 12), (1, "USAGE", 8), (2, "TESTS", 10), (3, "CALLS", 5), (4, "READS", 20)]) for i in range(5, 5 + n)])
    risk = {r.id: r.risk for r in tools.explain_symbols(nodes, links).collect()}
    assert [risk[i] for i in (1, 2, 3, 4)] == ["critical", "high", "medium", "low"]


@pytest.mark.parametrize("text, score", [("if (a) {\n  if (b && c) {\n    x ? y : z\n  }\n}", 1 + 2 + 0.75 + 3), ("// if (a)\n* for\n}\n}\nwhile (x) {", 1.0), ("", 0.0), ("a ?? b", 0.5)])
def test_cognitive(frame, text, score):
    from loomgraph.functions.texts import cognitive

    assert frame("t string", [(text,)]).select(cognitive(F.col("t"))).first()[0] == pytest.approx(int(score * 10 + 0.5) / 10)


@pytest.mark.parametrize("text, name, itself", [("function f(n) {\n return f(n - 1)\n}", "f", True), ("function f(n) {\n return xf(n)\n}", "f", False), ("def a.b():\n  a.b ()", "a.b", True), ("one line f(1)", "f", False), ("x\n(1)", "", False)])
def test_calls_itself(frame, text, name, itself):
    from loomgraph.functions.texts import calls_itself

    assert frame("t string, n string", [(text, name)]).select(calls_itself(F.col("t"), F.col("n"))).first()[0] is itself


def test_tiers_of_changes(frame):
    nodes = frame(NODES, [node(1, "Function", "a", file="src/x/a.ts"), node(2, "Function", "b", file="src/x/b.ts"), node(3, "Function", "c", file="src/c.ts"), node(4, "Function", "d", file="src/x/d.ts")])
    links = frame(EDGES, [(1, "p", 2, 1, "HTTP_CALLS", 1), (2, "p", 3, 4, "HTTP_CALLS", 1), (3, "p", 3, 2, "IMPORTS", 1)])
    changed = frame("file_path string", [("src/x/a.ts",), ("src/x/b.ts",), ("src/x/d.ts",), ("none",)])
    got = tools.changed_symbols(nodes, links, changed, frame("qualified_name string", [("m.d",), ("m.d",)]))
    assert rows_of(got) == [(1, 1, False, "low", "probable"), (2, 0, False, "low", "confirmed"), (4, 1, True, "critical", "nominal")]
    assert rows_of(tools.change_risk(got)) == [(3, 1, 1, 1, "critical")] and rows_of(tools.change_risk(got.where("id < 0"))) == [(0, 0, 0, 0, "low")]


def test_every_query_is_named_after_the_inventory():
    assert all(name.startswith(("op", "p", "fn_")) for name in entry.queries())
