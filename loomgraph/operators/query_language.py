"""A small pattern language over the graph, and guarded SQL.

    MATCH (a:Function)-[r:CALLS]->(b) WHERE b.name = 'x' AND a.cyclomaticComplexity >= 3
    RETURN b.name AS callee, count(*) AS n ORDER BY n DESC SKIP 1 LIMIT 5

One node or one outgoing step; conditions are joined by AND; RETURN items that are no
aggregates group the others. The text becomes a DataFrame plan, never SQL text. Properties
that are no columns are read from the JSON properties.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT, MAX_ROWS = 100, 1000
_TOKEN = re.compile(r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>-?\d+(?:\.\d+)?)|(?P<word>[A-Za-z_]\w*)|(?P<sign><>|!=|<=|>=|->|[-()\[\]:.,=<>*]))")
_FLAGS = ("is_exported", "is_test", "is_entry_point")
_NUMERIC = ("id", "start_line", "end_line", "line", "source_id", "target_id", *_FLAGS)
_AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


class QueryError(ValueError):
    """The text is outside the language."""


@dataclass
class Item:
    """One RETURN item: a property, or an aggregate of one."""

    variable: str
    name: str | None
    aggregate: str | None = None
    distinct: bool = False
    alias: str | None = None

    def label(self, path: bool) -> str:
        if self.alias:
            return self.alias
        if self.aggregate:
            return f"{self.aggregate}_{self.name or 'all'}"
        return (f"{self.variable}_{self.name}" if path else self.name) or self.variable


@dataclass
class Query:
    nodes: list[tuple[str, str | None]] = field(default_factory=list)
    edge: tuple[str, str | None] | None = None
    conditions: list[tuple[str, str, str, object]] = field(default_factory=list)
    items: list[Item] = field(default_factory=list)
    order: list[tuple[str, bool]] = field(default_factory=list)
    skip: int = 0
    limit: int = DEFAULT_LIMIT


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"unexpected {text[at:at + 12]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][1].upper() in values and self.tokens[self.at][0] != "string"

    def take(self, *values: str) -> bool:
        found = self.peek(*values)
        self.at += found
        return found

    def need(self, *values: str) -> str:
        if not self.peek(*values):
            raise QueryError(f"{' or '.join(values)} expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def next(self, *kinds: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] not in kinds:
            raise QueryError(f"{' or '.join(kinds)} expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def named(self) -> tuple[str, str | None]:
        name = self.next("word")
        return name, self.next("word") if self.take(":") else None

    def property(self) -> tuple[str, str | None]:
        name = self.next("word")
        return name, self.next("word") if self.take(".") else None

    def query(self) -> Query:
        q = Query()
        self.need("MATCH")
        self.need("(")
        q.nodes.append(self.named())
        self.need(")")
        if self.take("-"):
            self.need("[")
            q.edge = self.named()
            self.need("]")
            self.need("->")
            self.need("(")
            q.nodes.append(self.named())
            self.need(")")
        if self.take("WHERE"):
            q.conditions.append(self.condition())
            while self.take("AND"):
                q.conditions.append(self.condition())
        self.need("RETURN")
        q.items.append(self.item())
        while self.take(","):
            q.items.append(self.item())
        if self.take("ORDER"):
            self.need("BY")
            q.order.append(self.ordering())
            while self.take(","):
                q.order.append(self.ordering())
        while self.peek("SKIP", "LIMIT"):
            word = self.need("SKIP", "LIMIT").upper()
            n = int(self.next("number"))
            if word == "SKIP":
                q.skip = n
            else:
                q.limit = n
        if self.at < len(self.tokens):
            raise QueryError(f"unexpected {self.tokens[self.at][1]!r}")
        known = {v for v, _ in q.nodes} | ({q.edge[0]} if q.edge else set())
        for v in (*(c[0] for c in q.conditions), *(i.variable for i in q.items if i.variable != "*")):
            if v not in known:
                raise QueryError(f"{v} is not matched")
        return q

    def condition(self) -> tuple[str, str, str, object]:
        variable, name = self.property()
        if name is None:
            raise QueryError("a property is expected")
        sign = self.need("=", "<>", "!=", "<", "<=", ">", ">=", "CONTAINS").upper()
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        self.next("string", "number", "word")
        value = re.sub(r"\\(.)", r"\1", text[1:-1]) if kind == "string" else float(text) if kind == "number" else {"true": True, "false": False}.get(text.lower(), text)
        return variable, name, sign, value

    def item(self) -> Item:
        if self.at + 1 < len(self.tokens) and self.tokens[self.at][1].lower() in _AGGREGATES and self.tokens[self.at + 1][1] == "(":
            aggregate = self.next("word").lower()
            self.need("(")
            distinct = self.take("DISTINCT")
            variable, name = ("*", None) if self.take("*") else self.property()
            self.need(")")
            item = Item(variable, name, aggregate, distinct)
        else:
            item = Item(*self.property())
        if self.take("AS"):
            item.alias = self.next("word")
        return item

    def ordering(self) -> tuple[str, bool]:
        variable, name = self.property()
        down = self.take("DESC")
        if not down:
            self.take("ASC")
        return f"{variable}.{name}" if name else variable, down


def parse(text: str) -> Query:
    return _Parser(text).query()


def _property(frame_columns: set[str], variable: str, name: str) -> Column:
    column = f"{variable}__{name}"
    if column in frame_columns:
        return F.col(column)
    return F.get_json_object(f"{variable}__properties", f"$.{name}") if f"{variable}__properties" in frame_columns else F.lit(None).cast("string")


def run(text: str, nodes: DataFrame, edges: DataFrame, project: str, max_rows: int = DEFAULT_LIMIT) -> DataFrame:
    """The rows of a query over one project."""
    q = parse(text)
    path = q.edge is not None
    named = lambda rows, v: rows.select(*(F.col(c).alias(f"{v}__{c}") for c in rows.columns))
    of_kind = lambda v, kind: named(nodes.where((F.col("project") == project) & (F.col("kind") == kind if kind else F.lit(True))), v)
    if path:
        (a, ka), (b, kb), (r, type_) = q.nodes[0], q.nodes[1], q.edge
        step = named(edges.where((F.col("project") == project) & (F.col("type") == type_ if type_ else F.lit(True))), r)
        rows = step.join(of_kind(a, ka), F.col(f"{r}__source_id") == F.col(f"{a}__id")).join(of_kind(b, kb), F.col(f"{r}__target_id") == F.col(f"{b}__id"))
    else:
        rows = of_kind(*q.nodes[0])
    columns = set(rows.columns)
    for variable, name, sign, value in q.conditions:
        left = _property(columns, variable, name)
        if isinstance(value, bool):
            test = left.cast("string").isin("1", "true") if value else ~F.coalesce(left.cast("string"), F.lit("0")).isin("1", "true")
            test = ~test if sign in ("<>", "!=") else test
        elif sign == "CONTAINS":
            test = left.contains(str(value))
        else:
            left = left.try_cast("double") if isinstance(value, float) else left.cast("string")
            test = {"=": left == value, "<>": left != value, "!=": left != value, "<": left < value, "<=": left <= value, ">": left > value, ">=": left >= value}[sign]
        rows = rows.where(test)
    keys, aggregates = [], []
    for item in q.items:
        label = item.label(path)
        if item.aggregate:
            inner = F.lit(1) if item.name is None else _property(columns, item.variable, item.name)
            inner = inner.try_cast("double") if item.aggregate in ("sum", "avg") else inner
            made = F.count_distinct(inner) if item.aggregate == "count" and item.distinct else _AGGREGATES[item.aggregate](inner)
            aggregates.append(made.alias(label))
        elif item.name is None:
            keys.append(F.col(f"{item.variable}__qualified_name" if item.variable != (q.edge or ("",))[0] else f"{item.variable}__type").alias(label))
        else:
            keys.append(_property(columns, item.variable, item.name).alias(label))
    labels = [item.label(path) for item in q.items]
    found = rows.groupBy(*keys).agg(*aggregates).select(*labels) if aggregates else rows.select(*keys)
    by_source = {f"{i.variable}.{i.name}": i.label(path) for i in q.items if not i.aggregate}
    order = []
    for name, down in q.order:
        label = by_source.get(name, name.replace(".", "_") if path else name.split(".")[-1])
        label = label if label in labels else name
        if label not in labels:
            raise QueryError(f"{name} is not returned")
        order.append(F.col(label).desc_nulls_last() if down else F.col(label).asc_nulls_first())
    rest = [F.col(label).asc_nulls_first() for label in labels]
    return found.orderBy(*order, *rest).offset(q.skip).limit(min(q.limit, max(1, min(max_rows, MAX_ROWS))))


ALLOWED = ("nodes", "edges", "projects")
#: Kinds of plan nodes that read or do anything besides naming a table.
REFUSED = ("UnresolvedTableValuedFunction", "ScriptTransformation", "UnresolvedIdentifier", "PlanWithUnresolvedIdentifier", "RelationTimeTravel")


def _each(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _foreign(plan, known: frozenset[str]) -> set[str]:
    """Names that a parsed plan reads, subqueries included, and that are neither in `known` nor
    common table expressions in scope where they are read."""
    kind = plan.getClass().getSimpleName()
    if kind in REFUSED or plan.getClass().getName().startswith("org.apache.spark.sql.catalyst.plans.logical.Insert"):
        raise QueryError(f"{kind} is not allowed")
    if kind == "UnresolvedRelation":
        parts = _each(plan.multipartIdentifier())
        return set() if len(parts) == 1 and parts[0].lower() in known else {".".join(parts)}
    found, inner = set(), plan.innerChildren()
    if kind == "UnresolvedWith":
        for cte in _each(plan.cteRelations()):
            name = cte._1().lower()
            found |= _foreign(cte._2(), known | {name} if plan.allowRecursion() else known)
            known = known | {name}
    else:
        for child in _each(inner):
            found |= _foreign(child, known)
    for child in _each(plan.children()):
        found |= _foreign(child, known)
    return found


def guarded_sql(sql: str, nodes: DataFrame, edges: DataFrame, project: str, max_rows: int = DEFAULT_LIMIT) -> DataFrame:
    """A read-only query over nodes, edges and projects, each already limited to the project.

    What it reads is taken from the tree of the parsed plan: only the three names, and its own
    common table expressions where they are in scope. The frames are bound as common table
    expressions around the text, which is not rewritten, so session views of these names are
    out of reach; an expression of the query's own may take one of the names for itself."""
    spark = nodes.sparkSession
    text = sql.strip().rstrip(";").rstrip()
    if not re.match(r"(SELECT|WITH)\b", text, re.I):
        raise QueryError("only SELECT and WITH")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as error:
        raise QueryError("not a query") from error
    foreign = _foreign(plan, frozenset(ALLOWED))
    if foreign:
        raise QueryError(f"only {', '.join(ALLOWED)} can be read, not {', '.join(sorted(foreign))}")
    scoped = {"nodes": nodes.where(F.col("project") == project), "edges": edges.where(F.col("project") == project)}
    scoped["projects"] = scoped["nodes"].select("project").distinct()
    bound = ", ".join(f"{t} AS (SELECT * FROM {{{t}}})" for t in ALLOWED)
    whole = f"WITH {bound} SELECT * FROM (\n{text.replace('{', '{{').replace('}', '}}')}\n)"
    return spark.sql(whole, **scoped).limit(max(1, min(max_rows, MAX_ROWS)))
