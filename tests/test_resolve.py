"""Resolver passes and extraction on small sources."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import resolve as R
from loomgraph.plans.resolve_queries import among, seen
from loomgraph.sources import manifests as M
from loomgraph.sources.python_code import extract_python, observe
from tests.conftest import rows_of

NODES = "id long, kind string, name string, qualified_name string, file_path string, start_line int, is_exported int"
CALLS = "file string, callee string, caller string, line int"
VISIBLE = "file string, qualified_name string"


@pytest.fixture()
def nodes(frame):
    rows = [
        (1, "File", "a.ts", "src.a", "src/a.ts"), (2, "File", "b.ts", "src.b", "src/b.ts"), (3, "File", "c.go", "src.c", "src/c.go"), (4, "File", "a.test.ts", "tests.a", "tests/src/a.test.ts"),
        (10, "Class", "Box", "src.a.Box", "src/a.ts"), (11, "Method", "open", "src.a.Box.open", "src/a.ts"), (12, "Method", "shut", "src.a.Box.shut", "src/a.ts"), (13, "Function", "local", "src.a.local", "src/a.ts"), (14, "Variable", "load", "src.a.load", "src/a.ts"),
        (20, "Function", "load", "src.b.load", "src/b.ts"), (21, "Function", "twin", "src.b.twin", "src/b.ts"), (22, "Class", "Tool", "src.b.Tool", "src/b.ts"), (23, "Method", "run", "src.b.Tool.run", "src/b.ts"), (24, "Function", "single", "src.b.single", "src/b.ts"), (25, "Function", "hidden", "src.b.hidden", "src/b.ts"),
        (30, "Function", "twin", "src.c.twin", "src/c.go"), (31, "Function", "twin", "lib.twin", "lib/x.ts"), (40, "Function", "testOpen", "tests.a.testOpen", "tests/src/a.test.ts"), (41, "Class", "BaseError", "src.b.BaseError", "src/b.ts"),
    ]
    return frame(NODES, [(*r, 1, 0 if r[2] == "hidden" else 1) for r in rows])


def test_call_cascade(frame, nodes):
    calls = [("src/a.ts", "this.shut", "src.a.Box.open", 5), ("src/a.ts", "local", "src.a.Box.open", 6), ("src/a.ts", "load", "src.a.local", 7), ("src/a.ts", "twin", "src.a.local", 8), ("src/a.ts", "Tool.run", "src.a.local", 9), ("src/a.ts", "db.get", "src.a.local", 10), ("src/a.ts", "single", "src.a.local", 11), ("src/a.ts", "hidden", "src.a.local", 12), ("src/a.ts", "nothing", "src.a.local", 13), ("src/a.ts", "box.open", "src.a.local", 14), ("src/c.go", "single", "src.c.twin", 3), ("lib/y.ts", "twin", "lib.y.f", 1)]
    visible = frame(VISIBLE, [("src/a.ts", "src.b.twin"), ("src/a.ts", "src.b.Tool")])
    bindings = frame("owner string, name string, type_name string, declaration_line int, scope_start int, scope_end int, origin string", [("src.a.local", "box", "Box<T>", 3, 1, 20, "constructor"), ("src.a.local", "box", "Tool", 15, 1, 20, "annotation")])
    got = {r.line if r.file == "src/a.ts" else r.file: (r.target_id, r.reason, r.confidence) for r in R.resolve_calls(frame(CALLS, calls), nodes, visible, bindings).collect()}
    assert got == {5: (12, "lexical-receiver", 0.98), 6: (13, "same-file", 0.95), 7: (None, "shadowed", 0.0), 8: (21, "imported-name", 0.92), 9: (23, "imported-owner", 0.96), 10: (None, "unknown-receiver", 0.0), 11: (24, "unique-name", 0.8), 12: (None, "not-exported", 0.0), 13: (None, "not-found", 0.0), 14: (11, "scoped-local-type", 0.99), "src/c.go": (None, "not-found", 0.0), "lib/y.ts": (31, "package-name", 0.55)}
    resolved = R.resolve_calls(frame(CALLS, calls), nodes, visible, bindings)
    assert (11, 12, "CALLS") in {tuple(r)[:3] for r in R.call_edges(resolved, nodes).collect()}
    stats = {r.file: (r.total, r.unresolved, r.reasons) for r in R.resolution_stats(resolved).collect()}
    assert stats["src/a.ts"] == (10, 4, {"shadowed": 1, "unknown-receiver": 1, "not-exported": 1, "not-found": 1})


def test_imports_and_tests(frame, nodes):
    imports = frame("file string, local_name string, module_path string, line int", [("src/a.ts", "twin", "./b.js", 1), ("tests/src/a.test.ts", "Box", "../../src/a", 1), ("src/a.ts", "x", "left-pad", 2)])
    edges, visible = R.imported(nodes, imports)
    assert rows_of(edges.select("source_id", "target_id", "resolution", "confidence")) == [(1, 2, "module", 0.95), (1, 21, "module-export", 0.9), (4, 1, "module", 0.95), (4, 10, "module-export", 0.9)]
    assert rows_of(visible) == [("src/a.ts", "src.b.twin"), ("tests/src/a.test.ts", "src.a.Box")]
    calls = frame("source_id long, target_id long, line int", [(40, 11, 3), (13, 11, 3)])
    assert rows_of(R.test_edges(nodes, edges, calls).select("source_id", "target_id", "type", "confidence")) == [(4, 1, "TESTS_FILE", 0.9), (4, 1, "TESTS_FILE", 0.95), (40, 11, "TESTS", 0.95)]


@pytest.mark.parametrize("module, file, key", [("../x/y.js", "a/b/c.ts", "a.x.y"), ("./index", "a/c.ts", "a"), ("pkg/mod", "a/c.ts", "pkg.mod"), ("../../../z", "a/c.ts", "z")])
def test_import_key(frame, module, file, key):
    assert frame("m string, f string", [(module, file)]).select(R.import_key(F.col("m"), F.col("f"))).first()[0] == key


def test_usages_throws_heritage_decorators(frame, nodes):
    usages = frame("file string, name string, owner string, line int, is_write boolean", [("src/a.ts", "Tool", "src.a.local", 1, False), ("src/a.ts", "load", "src.a.local", 2, True), ("src/a.ts", "single", "src.a.local", 3, False), ("src/a.ts", "env", "src.a.local", 4, False), ("src/a.ts", "Tool", "src.a.local", 5, False)])
    got = R.usage_edges(usages, nodes, frame(VISIBLE, [("src/a.ts", "src.b.Tool")]), generic=("single",))
    assert rows_of(got.select("source_id", "target_id", "type", "confidence", "line")) == [(13, 14, "WRITES", 0.85, 2), (13, 22, "USAGE", 0.85, 1), (13, 22, "USAGE", 0.85, 5)]
    assert rows_of(R.settings(usages, nodes)) == [(1, "env", 4)]
    edges, external = R.throw_edges(frame("file string, name string, owner string, line int", [("src/a.ts", "BaseError", "src.a.local", 1), ("src/a.ts", "Stop", "gone", 2)]), nodes)
    assert rows_of(edges.select("source_id", "target_id", "type")) == [(13, 41, "RAISES")] and rows_of(external.select("source_id", "name", "type")) == [(1, "Stop", "THROWS")]
    files = frame("path string, content string", [("src/a.ts", "export class Box<T> extends Tool<A, B> implements Missing {\n}")])
    bases = R.declared_bases(files)
    assert rows_of(bases.select("name", "base")) == [("Box", "Missing"), ("Box", "Tool")]
    assert rows_of(R.heritage(nodes, bases).select("source_id", "target_id", "confidence")) == [(10, 22, 0.75)]
    assert rows_of(R.decorator_edges(frame("file string, name string, target string, line int", [("src/a.ts", "single", "src.a.Box", 1)]), nodes).select("source_id", "target_id")) == [(24, 10)]


def test_source_patterns(frame, nodes):
    text = "const toolHandlers = {\n  a: single,\n  'b': local,\n};\nbus.emit('made');\nbus.on(\"made\", f)\nbus.emit('made')"
    files = frame("path string, content string", [("src/a.ts", text), ("web/app/api/users/[id]/route.ts", "export async function POST() {}\nexport function GET() {}"), ("src/app/docs/[...rest]/page.tsx", "")])
    assert rows_of(R.channels(files)) == [("src/a.ts", "made", "EMITS", 5), ("src/a.ts", "made", "LISTENS_ON", 6)]
    assert rows_of(R.routes(files)) == [("src/app/docs/[...rest]/page.tsx", "/docs/*", "ALL"), ("web/app/api/users/[id]/route.ts", "/api/users/:id", "GET,POST")]
    calls = frame(CALLS, [("src/a.ts", "toolHandlers[kind]", "src.a.Box.open", 9)])
    assert rows_of(R.registry_edges(files, calls, nodes).select("source_id", "target_id", "confidence")) == [(11, 13, 0.35), (11, 24, 0.35)]
    seen = R.observed_channels(frame("file string, channel string, owner string, direction string, line int", [("src/a.ts", "c", "src.a.local", "emit", 1), ("src/a.ts", "c", "src.b.load", "listen", 2)]), nodes)
    assert rows_of(seen) == [(1, "c", "LISTENS_ON", 2), (13, "c", "EMITS", 1)]


def test_structure_and_definitions(frame, nodes):
    folders, edges = R.structure(nodes)
    assert rows_of(folders) == [("lib",), ("src",), ("tests",), ("tests/src",)]
    assert ("tests/src", "tests/src/a.test.ts", "CONTAINS_FILE") in rows_of(edges) and ("", "src", "CONTAINS_FOLDER") in rows_of(edges)
    got = {tuple(r)[:3] for r in R.definitions(nodes).collect()}
    assert (1, 10, "DEFINES") in got and (10, 11, "DEFINES_METHOD") in got and (22, 23, "DEFINES_METHOD") in got


def test_as_of_and_identities(frame):
    uses = frame("use_id long, file string, owner string, name string, line int", [(1, "f", "o", "x", 10), (2, "f", "o", "x", 3), (3, "f", "o", "x", 40), (4, "f", "o", "y", 10)])
    declared = frame("decl_id long, file string, owner string, name string, start_line int, scope_end int", [(7, "f", "o", "x", 2, 50), (8, "f", "o", "x", 8, 20), (9, "f", "o", "x", 11, 20)])
    assert rows_of(R.nearest_declaration(uses, declared)) == [(1, 8), (2, 7), (3, 7)]
    got = dict(rows_of(R.module_identities(frame("path string", [("a/b.ts",), ("a/b.py",), ("a.b.py",), ("a/c.ts",)]))))
    assert got["a/c.ts"] == "a.c" and got["a/b.ts"] == "a.b~ts" and got["a/b.py"] != got["a.b.py"] and got["a.b.py"].startswith("a.b~py~")


SOURCE = '''
import os.path as p
from .other import helper

class Base(Root):
    @cached
    def go(self, n):
        for i in range(n):
            while i and n:
                self.stop(i)
        raise ValueError("x")

    def stop(self, i): ...

def twice(x):
    return helper(x)
'''


def test_python_observations(frame):
    files = frame("path string, content string", [("pkg/mod.py", SOURCE), ("pkg/bad.py", "def ("), ("pkg/none.py", None), ("x.ts", "no")])
    rows = extract_python(files).collect()
    defined = {(r.kind, r.qualified_name): (r.complexity, r.loop_depth) for r in rows if r.what == "node"}
    assert defined == {("File", "pkg.mod"): (None, None), ("File", "pkg.bad"): (None, None), ("File", "pkg.none"): (None, None), ("Class", "pkg.mod.Base"): (4, 0), ("Method", "pkg.mod.Base.go"): (4, 2), ("Method", "pkg.mod.Base.stop"): (1, 0), ("Function", "pkg.mod.twice"): (1, 0)}
    of = lambda what: {(r.name, r.detail or r.owner) for r in rows if r.what == what}
    assert of("import") == {("p", "os.path"), ("helper", "pkg.other.helper")}
    assert {("self.stop", "pkg.mod.Base.go"), ("helper", "pkg.mod.twice")} <= of("call")
    assert of("throw") == {("ValueError", "pkg.mod.Base.go")} and {n for n, _ in of("decorator")} == {"cached"} and {n for n, _ in of("base")} == {"Root"}
    assert observe("a.py", "x = 1\nprint(x)")[1]["what"] == "write"


def test_golden_call_edges(frame):
    """entry calls twice, which calls add in another file."""
    files = frame("path string, content string", [("m/main.py", "from m.util import add\n\ndef twice(x):\n    return add(x)\n\ndef entry():\n    return twice(1)\n"), ("m/util.py", "def add(x):\n    return x\n")])
    seen = extract_python(files).orderBy("file", "line", "what").cache()
    nodes = seen.where("what = 'node'").select(F.abs(F.xxhash64("qualified_name")).alias("id"), "kind", "name", "qualified_name", F.col("file").alias("file_path"), F.col("line").alias("start_line"), F.lit(1).alias("is_exported"))
    imports = seen.where("what = 'import'").select("file", F.col("name").alias("local_name"), F.regexp_replace(F.regexp_replace("detail", r"\.[^.]*$", ""), r"\.", "/").alias("module_path"), "line")
    _, visible = R.imported(nodes, imports)
    calls = seen.where("what = 'call'").select("file", F.col("name").alias("callee"), F.col("owner").alias("caller"), "line")
    named = {r.id: r.qualified_name for r in nodes.collect()}
    got = {(named[r.source_id], named[r.target_id]) for r in R.call_edges(R.resolve_calls(calls, nodes, visible), nodes).collect()}
    assert got == {("m.main.entry", "m.main.twice"), ("m.main.twice", "m.util.add")}


def test_discovery(spark, tmp_path):
    for name, text in {"src/a.py": "x = 1", "src/b.bin": "?", "node_modules/x/y.js": "1", ".git/z.py": "1", "src/big.py": "#" * 300, "lib/c.ts": "let a"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = M.discover(spark, str(tmp_path), max_bytes=200)
    assert rows_of(found.select("path", "language", "size")) == [("lib/c.ts", "typescript", 5), ("src/a.py", "python", 5)]


def test_dependency_manifests(frame):
    files = frame("path string, content string", [("package.json", '{"dependencies":{"a":"^1"},"devDependencies":{"b":"2"}}'), ("x/package.json", "{broken"), ("requirements.txt", "flask>=2 ; python_version > '3'\r\n# note\n-r more.txt\nnumpy\nx==1.0 # pin")])
    assert rows_of(M.package_json(files)) == [("package.json", "a", "^1", False), ("package.json", "b", "2", True)]
    assert rows_of(M.requirements(files)) == [("requirements.txt", "flask", "2"), ("requirements.txt", "numpy", ""), ("requirements.txt", "x", "1.0")]


def test_status_lines(frame):
    lines = frame("value string", [(" M src/a.ts",), ("M  src/a.ts",), ("?? new file",), ("R  old.ts -> new.ts",), ("D  gone.ts",), ("nonsense",)])
    got = {r.path: (r.old_path, r.change) for r in M.status_lines(lines).where("path <> 'src/a.ts'").collect()}
    assert got == {"new file": (None, "untracked"), "new.ts": ("old.ts", "renamed"), "gone.ts": (None, "deleted")}
    assert rows_of(M.merged_status(M.status_lines(lines)).where("path = 'src/a.ts'")) == [("src/a.ts", True, True, "modified")]


def test_logs_with_rejects(spark, tmp_path):
    (tmp_path / "index.jsonl").write_text('{"timestamp":"t","project":"p","tasks":3,"valid":true,"cost":1.5}\n{"valid":false,"tasks":1}\n{"valid":true,"tasks":0}\n{oops\n\n')
    rows, rejects = M.benchmark_index(spark, str(tmp_path / "index.jsonl"))
    assert rows_of(rows) == [("t", "p", 3, 1.5)] and rows_of(rejects) == [("invalid_flag", 1), ("legacy_empty_tasks", 1), ("malformed_json", 1)]
    (tmp_path / "usage.jsonl").write_text('{"ts":"x","project":"p","files":["a"]}\n{"project":"q"}\nnot json\n')
    good, bad = M.usage_log(spark, str(tmp_path / "usage.jsonl"), "p")
    assert good.count() == 1 and bad.count() == 1


def _operators(df, name):
    return df._jdf.queryExecution().sparkPlan().toString().count(name)


def test_calls_are_resolved_in_one_lookup(frame, nodes):
    calls = frame(CALLS, [("src/a.ts", "twin", "src.a.local", 8), ("src/a.ts", "twin", "src.a.local", 8), ("src/a.ts", "Tool.run", None, 9), (None, "single", "src.a.local", 1)])
    resolved = R.resolve_calls(calls, nodes, frame(VISIBLE, [("src/a.ts", "src.b.twin"), ("src/a.ts", "src.b.Tool")]))
    # one join per rule made plans of 40 exchanges, which the driver holds and plans again after every stage
    assert _operators(resolved, "Join") <= 4
    assert rows_of(resolved.select("file", "target_id", "reason")) == [("src/a.ts", 21, "imported-name"), ("src/a.ts", 21, "imported-name"), ("src/a.ts", 23, "imported-owner"), (None, None, "not-found")]


def test_stats_of_calls_plan_few_joins(frame, nodes):
    calls = frame(CALLS, [("src/a.ts", "db.get", "src.a.local", 10), ("src/a.ts", "twin", "src.a.local", 8), ("src/a.ts", "db.get", None, 3)])
    stats = R.resolution_stats(R.resolve_calls(calls, nodes, frame(VISIBLE, [("src/a.ts", "src.b.twin")])))
    assert _operators(stats, "Join") <= 4
    assert [tuple(r) for r in stats.collect()] == [("src/a.ts", 3, 2, {"unknown-receiver": 2})]


def test_edges_of_calls_plan_few_joins(frame, nodes):
    calls = frame(CALLS, [("src/a.ts", "twin", "src.a.local", 8), ("src/a.ts", "local", "gone", 9), ("src/a.ts", "db.get", "src.a.local", 10)])
    edges = R.call_edges(R.resolve_calls(calls, nodes, frame(VISIBLE, [("src/a.ts", "src.b.twin")])), nodes)
    assert _operators(edges, "Join") <= 6
    assert rows_of(edges.select("source_id", "target_id", "resolution", "line")) == [(1, 13, "same-file", 9), (13, 21, "imported-name", 8)]


def test_stats_of_calls_broadcast_nothing(frame, nodes):
    calls = frame(CALLS, [("src/a.ts", "db.get", f"src.a.f{i}", i) for i in range(40)] + [("src/a.ts", "twin", "src.a.local", 8)])
    stats = R.resolution_stats(R.resolve_calls(calls, nodes, frame(VISIBLE, [("src/a.ts", "src.b.twin"), ("src/a.ts", "src.b.Tool")])))
    # stored keys and facts are small as files only: the driver would hold their rows
    assert _operators(stats, "BroadcastHashJoin") == 0 and _operators(stats, "SortMergeJoin") == 3
    assert [tuple(r) for r in stats.collect()] == [("src/a.ts", 41, 40, {"unknown-receiver": 40})]


def test_edges_of_calls_make_the_calls_once(frame, nodes):
    lines = frame("line int, file string", [(8, "src/a.ts"), (9, "src/a.ts")])
    calls = frame(CALLS, [("src/a.ts", "twin", "src.a.local", 8), ("src/a.ts", "this.shut", "src.a.Box.open", 9), ("src/a.ts", "this.shut", "src.a.local", 9)]).join(lines, ["line", "file"]).select("file", "callee", "caller", "line")
    edges = R.call_edges(R.resolve_calls(calls, nodes, frame(VISIBLE, [("src/a.ts", "src.b.twin")])), nodes)
    assert _operators(edges, "BroadcastHashJoin") == 0 and _operators(edges, "SortMergeJoin") == 5
    assert rows_of(edges.select("source_id", "target_id", "resolution", "line")) == [(11, 12, "lexical-receiver", 9), (13, 12, "same-file-name", 9), (13, 21, "imported-name", 8)]


def test_nodes_among_the_ends_of_edges(frame, nodes):
    ends = frame("source_id long, target_id long, type string, line int", [(13, 20, "CALLS", 1), (12, 20, "CALLS", 2)])
    assert [r[0] for r in rows_of(among(nodes, ends).select("id"))] == [12, 13, 14, 20]
    assert among(nodes, ends.where("line > 2")).count() == 0
    assert rows_of(seen(among(nodes, ends), ends, "CALLS").select("owner", "target", "line")) == rows_of(seen(nodes, ends, "CALLS").select("owner", "target", "line"))
