"""Python sources to nodes and observations, with the standard library's parser."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: One row per observation; columns that an observation lacks are null.
OBSERVATIONS = "what string, file string, name string, qualified_name string, kind string, owner string, line int, end_line int, detail string, complexity int, loop_depth int"
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case)
_LOOPS = (ast.For, ast.AsyncFor, ast.While)


def module_name(path: str) -> str:
    return path.removesuffix(".py").removesuffix("/__init__").replace("/", ".")


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Attribute):
        base = _dotted(node.value)
        return f"{base}.{node.attr}" if base else node.attr
    return node.id if isinstance(node, ast.Name) else _dotted(node.func) if isinstance(node, ast.Call) else ""


def _depth(node: ast.AST) -> int:
    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
        return 0
    return isinstance(node, _LOOPS) + max(map(_depth, ast.iter_child_nodes(node)), default=0)


class _Reader(ast.NodeVisitor):
    def __init__(self, path: str):
        self.path, self.scope, self.rows = path, [module_name(path)], []

    def add(self, what: str, node: ast.AST, name: str, **more) -> None:
        row = dict.fromkeys(c.split(" ")[0] for c in OBSERVATIONS.split(", "))
        self.rows.append(row | {"what": what, "file": self.path, "name": name, "owner": ".".join(self.scope), "line": getattr(node, "lineno", 1), "end_line": getattr(node, "end_lineno", 1)} | more)

    def _define(self, node, kind: str) -> None:
        qualified = ".".join([*self.scope, node.name])
        branches = sum(isinstance(n, _BRANCHES) + (len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0) for n in ast.walk(node))
        self.add("node", node, node.name, qualified_name=qualified, kind=kind, complexity=branches + 1, loop_depth=max(map(_depth, node.body), default=0))
        for d in node.decorator_list:
            self.add("decorator", d, _dotted(d), qualified_name=qualified)
        for base in getattr(node, "bases", []):
            self.add("base", node, _dotted(base), qualified_name=qualified)
        self.scope.append(node.name)
        for child in node.body:
            self.visit(child)
        self.scope.pop()

    def visit_ClassDef(self, node):
        self._define(node, "Class")

    def visit_FunctionDef(self, node):
        inside = any(r["what"] == "node" and r["kind"] == "Class" and r["qualified_name"] == ".".join(self.scope) for r in self.rows)
        self._define(node, "Method" if inside else "Function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Import(self, node):
        for a in node.names:
            self.add("import", node, a.asname or a.name.split(".")[0], detail=a.name)

    def visit_ImportFrom(self, node):
        base = self.scope[0].split(".")
        package = base[: len(base) - node.level] if node.level else []
        for a in node.names:
            self.add("import", node, a.asname or a.name, detail=".".join([*package, *([node.module] if node.module else []), a.name]))

    def visit_Call(self, node):
        self.add("call", node, _dotted(node.func))
        self.generic_visit(node)

    def visit_Raise(self, node):
        if node.exc is not None:
            self.add("throw", node, _dotted(node.exc))
        self.generic_visit(node)

    def visit_Name(self, node):
        self.add("write" if isinstance(node.ctx, ast.Store) else "read", node, node.id)


def observe(path: str, source: str) -> list[dict]:
    """All observations of one file; a file that doesn't parse gives its file node only."""
    reader = _Reader(path)
    reader.add("node", ast.Pass(), path.rsplit("/", 1)[-1], qualified_name=module_name(path), kind="File")
    try:
        reader.visit(ast.parse(source))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        del reader.rows[1:]
    return reader.rows


def extract_python(files: DataFrame) -> DataFrame:
    """Observations of the Python files in (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split(" ")[0] for c in OBSERVATIONS.split(", ")]
        for frame in frames:
            rows = [row for path, content in zip(frame["path"], frame["content"]) for row in observe(path, content or "")]
            yield pd.DataFrame(rows, columns=columns).astype({c: "Int32" for c in ("line", "end_line", "complexity", "loop_depth")})

    return files.where("path like '%.py'").select("path", "content").mapInPandas(run, OBSERVATIONS)
