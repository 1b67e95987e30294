"""Building edges from extracted observations.

Every lookup is an aggregate with one row per key (how many candidates, and the first), so a
name that thousands of files define joins once per use instead of multiplying rows; the rules
of a cascade are then one chain of conditions in order of strength.

Frames: nodes(id, project, kind, name, qualified_name, file_path, start_line, is_exported),
calls(file, callee, caller, line), imports(file, local_name, module_path, line),
usages(file, name, owner, line, is_write), files(path, content), and so on as named below.
Edges are (source_id, target_id, type, resolution, confidence, line).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.texts import is_test_path, split_type_list, test_to_source
from loomgraph.session import bounded_join, written
from loomgraph.sources.manifests import language

CALLABLE = ("Function", "Method")
TYPES = ("Class", "Interface", "Type", "Enum")
SYMBOLS = (*CALLABLE, *TYPES, "Variable", "Macro")
HEADER = r"[.](h|hh|hpp|hxx)$"
# Words within a name that make an object literal a registry, verbs of events, and
# names that decide what counts as a route.
REGISTRY_WORDS = ("handlers", "registry", "dispatch", "map")
CHANNEL_VERBS = {
    "emit": "EMITS", "send": "EMITS", "publish": "EMITS", "broadcast": "EMITS",
    "on": "LISTENS_ON", "once": "LISTENS_ON", "subscribe": "LISTENS_ON", "addListener": "LISTENS_ON",
}
HTTP_METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
HTTP_VERBS = {"fetch": "GET", "request": "GET", "get": "GET", "post": "POST", "put": "PUT", "patch": "PATCH", "delete": "DELETE", "del": "DELETE", "head": "HEAD", "options": "OPTIONS"}
URL_WORDS = ("url", "endpoint", "path", "href", "link", "apiUrl", "baseUrl")
MAX_URL = 100
ROUTE_FILE = r"^(?:.*/)?(?:src/)?app/(.+?)/(route|page)[.](ts|tsx|js|jsx)$"


def _edge(rows: DataFrame, type: str | Column, resolution: str | Column, confidence: float | Column, line: str | None = "line") -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select("source_id", "target_id", lit(type).alias("type"), lit(resolution).alias("resolution"), lit(confidence).cast("double").alias("confidence"), (F.col(line) if line else F.lit(None)).cast("int").alias("line")).where("source_id is not null and target_id is not null and source_id <> target_id").distinct()


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def group(path: Column) -> Column:
    """Languages that call each other count as one."""
    name = language(path)
    return F.when(name.isin("typescript", "javascript"), "script").when(name.isin("c", "cpp"), "c").when(name.isin("java", "kotlin"), "jvm").otherwise(name)


def module_key(path: Column) -> Column:
    """Dotted key of a file or module path: no extension, no trailing index or __init__."""
    bare = F.regexp_replace(F.regexp_replace(path, r"[.][A-Za-z0-9]+$", ""), r"/(index|__init__)$", "")
    return F.replace(bare, F.lit("/"), F.lit("."))


def import_key(module: Column, file: Column) -> Column:
    """Dotted key that an import asks for; relative ones are taken from the file's folder."""
    raw = F.split(F.concat(folder(file), F.lit("/"), module), "/")
    parts = F.aggregate(raw, F.array().cast("array<string>"), lambda a, p: F.when(p.isin(".", ""), a).when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    relative = F.regexp_replace(F.array_join(parts, "/"), r"[.](js|ts|jsx|tsx|mjs|h|hpp)$", "")
    plain = F.regexp_replace(module, r"[.](js|ts|jsx|tsx|mjs|h|hpp)$", "")
    return F.replace(F.regexp_replace(F.when(module.startswith("."), relative).otherwise(plain), r"/(index|__init__)$", ""), F.lit("/"), F.lit("."))


def file_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'File'").groupBy("file_path").agg(F.min("id").alias("file_id"))


def sources_of(rows: DataFrame, nodes: DataFrame, owner: str) -> DataFrame:
    """Rows with source_id: the node of the enclosing qualified name, else the file's node."""
    named = nodes.groupBy(F.col("qualified_name").alias(owner)).agg(F.min("id").alias("owner_id"))
    return rows.join(named, owner, "left").join(file_nodes(nodes).withColumnRenamed("file_path", "file"), "file", "left").withColumn("source_id", F.coalesce("owner_id", "file_id")).drop("owner_id", "file_id")


def structure(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(folders, edges): every folder of a file's path by path, and containment edges
    (parent, child, type) by path; top folders and files have the parent ''."""
    files = nodes.where("file_path <> ''").select("file_path").distinct()
    parts = F.split("file_path", "/")
    paths = files.select("file_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("path")).select("path", (F.col("path") == F.col("file_path")).alias("is_file")).distinct()
    edges = paths.select(folder(F.col("path")).alias("parent"), F.col("path").alias("child"), F.when(F.col("is_file"), "CONTAINS_FILE").otherwise("CONTAINS_FOLDER").alias("type"))
    return paths.where("not is_file").select("path"), edges


def branch(nodes: DataFrame, name: str) -> DataFrame:
    """(source_id, branch): the project's node and the current branch."""
    return nodes.where("kind = 'Project'").select(F.col("id").alias("source_id"), F.lit(name).alias("branch"), F.lit("HAS_BRANCH").alias("type"))


def definitions(nodes: DataFrame) -> DataFrame:
    """File to everything in it; types to their methods."""
    inside = nodes.where("kind not in ('File', 'Folder')").join(file_nodes(nodes), "file_path")
    by_file = _edge(inside.select(F.col("file_id").alias("source_id"), F.col("id").alias("target_id"), F.col("start_line").alias("line")), "DEFINES", "file", 1.0)
    owner = nodes.where(F.col("kind").isin(*TYPES)).select(F.col("id").alias("source_id"), F.col("qualified_name").alias("owner"))
    methods = nodes.where("kind = 'Method'").select(F.col("id").alias("target_id"), F.regexp_extract("qualified_name", r"^(.*)\.[^.]*$", 1).alias("owner"), F.col("start_line").alias("line"))
    return by_file.unionByName(_edge(methods.join(owner, "owner"), "DEFINES_METHOD", "parent", 1.0))


def declared_bases(files: DataFrame) -> DataFrame:
    """(file, name, base, kind): base types declared in brace languages."""
    text = F.col("content")
    heads = files.select(F.col("path").alias("file"), F.explode(F.regexp_extract_all(text, F.lit(r"\b((?:class|interface)\s+\w+[^{;]*)\{"), F.lit(1))).alias("head"))
    kind = F.regexp_extract("head", r"^(class|interface)", 1)
    bases = F.concat(split_type_list(F.regexp_extract("head", r"\bextends\s+(.+?)(?:\s+implements\b|$)", 1)), split_type_list(F.regexp_extract("head", r"\bimplements\s+(.+)$", 1)))
    return heads.select("file", F.regexp_extract("head", r"^\w+\s+(\w+)", 1).alias("name"), F.explode(bases).alias("base"), kind.alias("kind")).withColumn("base", F.regexp_replace("base", r"\s*<.*$", ""))


def _by_name(nodes: DataFrame, kinds: tuple[str, ...], *keys: str) -> DataFrame:
    """Candidates per key: how many, and the one with the least id."""
    return nodes.where(F.col("kind").isin(*kinds)).groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("first"))


def near_or_unique(rows: DataFrame, nodes: DataFrame, kinds: tuple[str, ...], name: str) -> DataFrame:
    """Rows (file, `name`, ...) with `near`, the candidate in the same file, and `only`, the one
    candidate anywhere."""
    near = _by_name(nodes, kinds, "file_path", "name").select(F.col("file_path").alias("file"), F.col("name").alias(name), F.col("first").alias("near"))
    only = _by_name(nodes, kinds, "name").where("n = 1").select(F.col("name").alias(name), F.col("first").alias("only"))
    return rows.join(near, ["file", name], "left").join(only, name, "left")


def heritage(nodes: DataFrame, bases: DataFrame) -> DataFrame:
    """INHERITS from (file, name, base)."""
    own = nodes.where(F.col("kind").isin("Class", "Interface")).select(F.col("file_path").alias("file"), "name", F.col("id").alias("source_id"))
    found = near_or_unique(bases.select("file", "name", "base").join(own, ["file", "name"]), nodes, ("Class", "Interface"), "base")
    return _edge(found.withColumn("target_id", F.coalesce("near", "only")), "INHERITS", "heritage", F.when(F.col("near").isNotNull(), 0.9).otherwise(0.75), None)


def imported(nodes: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, visible): IMPORTS edges to files and symbols, and (file, qualified_name) of what
    each file may call by import; a header shows all its symbols and their implementations."""
    keyed = imports.withColumn("key", import_key(F.col("module_path"), F.col("file")))
    modules = nodes.where("kind = 'File'").select(module_key(F.col("file_path")).alias("key"), F.col("id").alias("target_id"), F.col("file_path").alias("target_file"))
    one = modules.groupBy("key").agg(F.min(F.struct("target_id", "target_file")).alias("m")).select("key", "m.*")
    placed = keyed.join(one, "key", "left").join(file_nodes(nodes).select(F.col("file_path").alias("file"), F.col("file_id").alias("source_id")), "file")
    to_files = _edge(placed, "IMPORTS", "module", 0.95)
    symbols = nodes.where(F.col("kind").isin(*SYMBOLS)).select(F.col("id").alias("symbol_id"), F.col("name").alias("local_name"), F.col("file_path").alias("target_file"), "qualified_name")
    at = Window.partitionBy("file", "local_name", "module_path", "line").orderBy("symbol_id")
    targets = placed.drop("target_id").join(symbols, ["target_file", "local_name"]).withColumn("rank", F.row_number().over(at))
    same = F.col("target_file") == F.col("file")
    to_symbols = _edge(targets.where("rank <= 4").withColumn("target_id", F.col("symbol_id")), "IMPORTS", F.when(same, "local-name").otherwise("module-export"), F.when(same, 0.65).otherwise(0.9))
    headers = placed.where(F.col("target_file").rlike(HEADER)).select("file", "target_file").distinct().join(symbols.select("target_file", "qualified_name", F.col("local_name").alias("name")), "target_file")
    bodies = _by_name(nodes.where(~F.col("file_path").rlike(HEADER)), CALLABLE, "name").where("n = 1").join(nodes.select(F.col("id").alias("first"), F.col("qualified_name").alias("body")), "first").select("name", "body")
    visible = targets.select("file", "qualified_name").unionByName(headers.select("file", "qualified_name")).unionByName(headers.join(bodies, "name").select("file", F.col("body").alias("qualified_name"))).distinct()
    return to_files.unionByName(to_symbols), visible


def _merged(left: DataFrame, right: DataFrame, on: list[str] | Column, how: str = "inner") -> DataFrame:
    """Join by shuffle. Spark goes by the bytes of a stored table's files, of which the rows may take
    a hundred times as much, in what it sends to all executors by way of the driver."""
    return left.join(right.hint("merge"), on, how)


def _key(role: str, k1: str | Column, k2: str | Column, k3: str | Column = "") -> Column:
    """Under which a rule of `resolve_calls` looks up; parts that are null match nothing."""
    col = lambda k: k if isinstance(k, Column) else F.col(k) if k else F.lit("")
    return F.struct(F.lit(role).alias("role"), col(k1).alias("k1"), col(k2).alias("k2"), col(k3).alias("k3"))


def _facts(callables: DataFrame, visible: DataFrame, by_name: DataFrame, variables: DataFrame) -> DataFrame:
    """One row per key of every rule: how many definitions, the first, and the same of the free ones
    (of imports: of those that are no header's), and the first in another file."""
    c = F.col
    free = (c("kind") != "Method") & (F.coalesce("is_exported", F.lit(1)) != 0)
    none = F.array().cast("array<struct<role:string,k1:string,k2:string,k3:string>>")
    parts = F.split("qualified_name", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    named = F.array(_key("near", "file_path", "name"), _key("child", F.regexp_extract("qualified_name", r"^(.*)\.[^.]*$", 1), "name", "lang"), _key("name", "lang", "name"), _key("package", "lang", "dir", "name"))
    qualified = F.concat(F.array(_key("own", "file_path", "qualified_name")), F.transform(tails, lambda t: _key("tail", "file_path", t)), F.when(c("kind") != "Method", F.transform(tails, lambda t: _key("suffix", "lang", t))).otherwise(none))
    keys = F.concat(F.when(c("called") == c("name"), named).otherwise(none), F.when(c("called") == F.substring_index("qualified_name", ".", -1), qualified).otherwise(none))
    other = F.lit(None).cast("long")
    own = callables.select("id", free.alias("is_free"), other.alias("other"), F.explode(keys).alias("k")).select("k.*", "id", "is_free", "other")
    seen = _merged(visible, by_name, ["qualified_name"])
    shown = seen.select(F.lit("import").alias("role"), c("file").alias("k1"), c("name").alias("k2"), c("lang").alias("k3"), "id", (~c("file_path").rlike(HEADER)).alias("is_free"), F.when(c("file_path") != c("file"), c("id")).alias("other"))
    held = variables.select(F.lit("shadow").alias("role"), "k1", "k2", F.lit("").alias("k3"), "id", F.lit(True).alias("is_free"), other.alias("other"))
    rows = own.unionByName(shown).unionByName(held)
    return rows.groupBy("role", "k1", "k2", "k3").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.count_if("is_free").alias("free_n"), F.min(F.when(c("is_free"), c("id"))).alias("free"), F.bool_and("is_free").alias("all_free"), F.min("other").alias("away"))


def resolve_calls(calls: DataFrame, nodes: DataFrame, visible: DataFrame, bindings: DataFrame | None = None) -> DataFrame:
    """Calls with target_id, reason and confidence, null where no rule holds.

    In order: the receiver is the caller's own class; its declared type is known (`bindings`:
    owner, name, type_name, declaration_line, scope_start, scope_end, origin); same file;
    a variable of that name in the file blocks the rest; imported; owner imported; another
    receiver blocks the rest; one exported definition; the same folder; one definition; one
    suffix."""
    c = F.col
    use = ["file", "callee", "own_qn"]  # all that the lookups depend on, but for the declared type
    method, parent, word = F.substring_index("callee", ".", -1), F.regexp_extract("caller", r"^(.*)\.[^.]*$", 1), c("callee").rlike(r"^\w+\.\w+$")
    own_qn = F.when(c("callee").rlike(r"^(this|self)\.\w+$") & (parent != ""), F.concat(parent, F.lit("."), method))
    said = {"method": method, "lang": group(c("file")), "receiver": F.when(word, F.substring_index("callee", ".", 1))}
    columns, calls = calls.columns, written(calls.withColumn("own_qn", own_qn), "calls")  # read again for what is asked and what is found
    asked = written(calls.select(*use).distinct().withColumns(said | {"dir": folder(c("file"))}), "asked")
    visible = written(visible.select("file", "qualified_name"), "visible")

    # only definitions whose name, or whose qualified name's last part, is called; `called` is that text
    last = F.substring_index("qualified_name", ".", -1)
    defined = nodes.where(c("kind").isin(*CALLABLE)).select("id", "kind", "name", "qualified_name", "file_path", "is_exported", F.explode(F.array_distinct(F.array("name", last))).alias("called"))
    wanted = bounded_join(defined, asked.select(c("method").alias("called")).distinct(), ["called"], "left_semi")
    callables = written(wanted.withColumns({"lang": group(c("file_path")), "dir": folder(c("file_path"))}), "callables")
    by_name = callables.where("called = name")
    local = nodes.where("kind = 'Variable'").select(c("file_path").alias("k1"), c("name").alias("k2"), "id")
    facts = written(_facts(callables, visible, by_name, local), "facts")

    owners = visible.select("file", c("qualified_name").alias("owner"), F.substring_index("qualified_name", ".", -1).alias("receiver")).groupBy("file", "receiver").agg(F.count("*").alias("n"), F.min("owner").alias("owner")).where("n = 1").drop("n")
    keys = [_key("own", "file", "own_qn"), _key("near", "file", "method"), _key("tail", "file", "callee"), _key("shadow", "file", "method"), _key("import", "file", "method", "lang"), _key("child", "owner", "method", "lang"), _key("name", "lang", "method"), _key("package", "lang", "dir", "method"), _key("suffix", "lang", "callee")]
    met = _merged(_merged(asked, owners, ["file", "receiver"], "left").select(*use, F.explode(F.array(*keys)).alias("k")).select(*use, "k.*"), facts, ["role", "k1", "k2", "k3"])
    of = lambda role, value, test=F.lit(True): F.max(F.when((c("role") == role) & test, c(value)))
    one = c("n") == 1
    held = {
        "own": of("own", "first"), "near": of("near", "first"), "tail": of("tail", "first"), "shadow": F.bool_or(c("role") == "shadow"), "child": of("child", "first", one), "suffix": of("suffix", "first", one),
        "imp_n": of("import", "n"), "imp": of("import", "first"), "body_n": of("import", "free_n"), "body": of("import", "free"), "away": of("import", "away"),
        "all_n": of("name", "n"), "any": of("name", "first"), "exp_n": of("name", "free_n"), "exp": of("name", "free"), "any_free": of("name", "all_free"), "pkg": of("package", "first"), "pkg_exp": of("package", "free"),
    }
    found = met.groupBy(*use).agg(*(v.alias(k) for k, v in held.items()))
    rows = calls.withColumn("qualified", c("callee").contains("."))
    rows = _merged(rows, found.withColumnsRenamed({k: f"_{k}" for k in use}), reduce(Column.__and__, (c(k).eqNullSafe(c(f"_{k}")) for k in use)), "left").drop(*(f"_{k}" for k in use))

    if bindings is None:
        rows = rows.withColumns({"typed": F.lit(None).cast("long"), "origin": F.lit(None).cast("string")})
    else:
        bound = bindings.select(c("owner").alias("caller"), c("name").alias("receiver"), F.regexp_replace("type_name", r"\s*(<.*|\[\].*|\|.*)$", "").alias("type_name"), "declaration_line", "scope_start", "scope_end", "origin")
        at = ["file", "callee", "caller", "line"]  # calls that agree in these have one type
        hit = calls.select(*at).distinct().withColumns(said).join(bound, ["caller", "receiver"]).where("declaration_line <= line and line between scope_start and scope_end")
        first = hit.groupBy(*at, "method", "lang").agg(F.min(F.struct("declaration_line", "type_name", "origin")).alias("b")).select(*at, "method", "lang", "b.type_name", "b.origin")
        kinds = nodes.where(c("kind").isin("Class", "Interface")).select(c("name").alias("type_name"), c("qualified_name").alias("owner"), c("file_path").alias("at"), group(c("file_path")).alias("lang"))
        inside = kinds.select(c("at").alias("file"), "type_name", "owner", "lang")
        away = visible.join(kinds.withColumnRenamed("owner", "qualified_name"), "qualified_name").select("file", "type_name", c("qualified_name").alias("owner"), "lang")
        typed_owner = inside.unionByName(away).distinct().groupBy("file", "type_name", "lang").agg(F.count("*").alias("n"), F.min("owner").alias("owner")).where("n = 1").drop("n")
        children = facts.where("role = 'child' and n = 1").select(c("k1").alias("owner"), c("k2").alias("method"), c("k3").alias("lang"), c("first").alias("typed"))
        typed = _merged(_merged(first, typed_owner, ["file", "type_name", "lang"]), children, ["owner", "method", "lang"]).select(*at, "typed", "origin")
        rows = _merged(rows, typed, at, "left")

    hit = lambda target, reason, sure: F.struct(target.alias("target_id"), F.lit(reason).alias("reason"), (sure if isinstance(sure, Column) else F.lit(sure)).cast("double").alias("confidence"))
    none = F.lit(None).cast("long")
    rule = (
        F.when(c("own").isNotNull(), hit(c("own"), "lexical-receiver", 0.98))
        .when(c("typed").isNotNull(), hit(c("typed"), "scoped-local-type", F.when(c("origin") == "constructor", 0.99).otherwise(0.97)))
        .when(c("tail").isNotNull(), hit(c("tail"), "same-file", 0.95))
        .when(~c("qualified") & c("near").isNotNull(), hit(c("near"), "same-file", 0.95))
        .when(c("shadow"), hit(none, "shadowed", 0.0))
        .when(c("near").isNotNull(), hit(c("near"), "same-file-name", 0.9))
        .when(c("imp_n") == 1, hit(c("imp"), "imported-name", 0.92))
        .when(c("body_n") == 1, hit(c("body"), "imported-implementation", 0.96))
        .when(c("imp_n") > 1, hit(F.coalesce("away", "imp"), "imported-name", 0.85))
        .when(c("child").isNotNull(), hit(c("child"), "imported-owner", 0.96))
        .when(c("qualified"), hit(none, "unknown-receiver", 0.0))
        .when(c("exp_n") == 1, hit(c("exp"), "unique-name", 0.8))
        .when((c("exp_n") > 1) & c("pkg_exp").isNotNull(), hit(c("pkg_exp"), "package-name", 0.55))
        .when(c("all_n") == 1, F.when(c("any_free"), hit(c("any"), "unique-name", 0.8)).otherwise(hit(none, "not-exported", 0.0)))
        .when(c("suffix").isNotNull(), hit(c("suffix"), "suffix-index", 0.7))
        .when(c("pkg").isNotNull(), hit(c("pkg"), "package-name", 0.55))
        .otherwise(hit(none, "not-found", 0.0))
    )
    return rows.withColumn("r", rule).select(*columns, "r.target_id", "r.reason", "r.confidence")


def call_edges(resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    placed = sources_of(resolved.where("target_id is not null"), nodes.hint("merge"), "caller")  # as _merged
    return _edge(placed, "CALLS", F.col("reason"), F.col("confidence"))


def url_of(argument: Column) -> Column:
    """The address that a call's argument (source text) stands for: a quoted absolute path or
    address; a template's text with its holes named, cut at MAX_URL; a mark where only the name
    of a variable speaks of an address; else null."""
    text = F.trim(argument)
    quote, inner = F.substring(text, 1, 1), F.substring(text, F.lit(2), F.length(text) - 2)
    closed = (F.length(text) >= 2) & quote.isin("'", '"', "`") & (F.substring(text, -1, 1) == quote)
    plain = closed & ~inner.rlike("['\"`]") & (inner.startswith("/") | inner.rlike("^https?://")) & ~((quote == "`") & inner.contains("${"))
    named = F.regexp_replace(inner, r"\$\{[^}]*\}", ":param")
    template = closed & (quote == "`") & (named.startswith("/") | named.startswith("http"))
    short = F.when(F.length(named) > MAX_URL, F.concat(F.substring(named, 1, MAX_URL), F.lit("..."))).otherwise(named)
    return F.when(plain, inner).when(template, short).when(text.rlike(rf"(?i)\b({'|'.join(URL_WORDS)})\b"), F.lit("[dynamic]"))


def http_calls(calls: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(routes, edges) of calls (file, callee, caller, line, args array<string>) whose last name is a
    verb of HTTP and one of whose arguments, the first that does, names an address: routes
    (qualified_name, url, method), and HTTP_CALLS (source_id, route, type, line) to them."""
    verbs = F.create_map(*(F.lit(x) for pair in HTTP_VERBS.items() for x in pair))
    method = F.try_element_at(verbs, F.lower(F.substring_index("callee", ".", -1)))
    url = F.get(F.filter(F.transform("args", url_of), lambda u: u.isNotNull()), F.lit(0))
    rows = calls.select("file", "caller", "line", method.alias("method"), url.alias("url")).where("method is not null and url is not null")
    named = rows.withColumn("route", F.concat(F.lit("route."), F.sha2(F.concat_ws(":", "method", "url"), 256)))
    edges = sources_of(named, nodes, "caller").where("source_id is not null").select("source_id", "route", F.lit("HTTP_CALLS").alias("type"), "line").distinct()
    return named.select(F.col("route").alias("qualified_name"), "url", "method").distinct(), edges


def package_folder(imports: DataFrame, folders: DataFrame) -> DataFrame:
    """(module_path, folder) for imports by package path: the folder that shares the longest run of
    last parts with it, where only one does. Suffixes of folders are joined, not all pairs."""
    parts = lambda c: F.split(c, "/")
    tails = lambda c: F.transform(F.sequence(F.lit(1), F.size(parts(c))), lambda i: F.array_join(F.slice(parts(c), i, F.size(parts(c))), "/"))
    wanted = imports.select("module_path").where("module_path <> ''").distinct().select("module_path", F.explode(tails("module_path")).alias("tail"))
    known = folders.select("folder").where("folder <> ''").distinct().select("folder", F.explode(tails("folder")).alias("tail"))
    shared = wanted.join(known, "tail").groupBy("module_path", "folder").agg(F.max(F.size(parts("tail"))).alias("n"))
    best = shared.groupBy("module_path").agg(F.max("n").alias("n"))
    return shared.join(best, ["module_path", "n"]).groupBy("module_path").agg(F.count("*").alias("k"), F.min("folder").alias("folder")).where("k = 1").select("module_path", "folder")


def resolution_stats(resolved: DataFrame) -> DataFrame:
    """Per file: calls, unresolved ones and the unresolved by reason."""
    missing = F.col("target_id").isNull()
    per = resolved.groupBy("file", F.when(missing, F.col("reason")).alias("why")).agg(F.count("*").alias("n"))
    return per.groupBy("file").agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("why").isNotNull(), F.col("n"))), F.lit(0)).alias("unresolved"), F.map_from_entries(F.filter(F.collect_list(F.struct("why", "n")), lambda e: e["why"].isNotNull())).alias("reasons"))


def usage_edges(usages: DataFrame, nodes: DataFrame, visible: DataFrame, skip: tuple[str, ...] = (), generic: tuple[str, ...] = ()) -> DataFrame:
    """READS, WRITES and USAGE: imported, same file, one definition anywhere, same folder. The
    last two don't hold for generic names."""
    c = F.col
    rows = sources_of(usages.where(~c("name").isin(*skip)) if skip else usages, nodes, "owner").withColumns({"lang": group(c("file")), "dir": folder(c("file"))})
    symbols = nodes.where(c("kind").isin(*SYMBOLS)).withColumns({"lang": group(c("file_path")), "dir": folder(c("file_path"))})
    seen = visible.join(symbols.select("qualified_name", "name", "id"), "qualified_name").groupBy("file", "name").agg(F.min("id").alias("imp"))
    near = symbols.groupBy(c("file_path").alias("file"), "name").agg(F.min("id").alias("near"))
    only = symbols.groupBy("lang", "name").agg(F.count("*").alias("n"), F.min("id").alias("only"))
    package = symbols.groupBy("lang", "dir", "name").agg(F.min("id").alias("pkg"))
    rows = rows.join(seen, ["file", "name"], "left").join(near, ["file", "name"], "left").join(only, ["lang", "name"], "left").join(package, ["lang", "dir", "name"], "left")
    weak = ~c("name").isin(*generic) if generic else F.lit(True)
    hit = lambda target, how, sure: F.struct(c(target).alias("target_id"), F.lit(how).alias("how"), F.lit(sure).alias("sure"))
    rule = F.when(c("imp").isNotNull(), hit("imp", "import-map", 0.85)).when(c("near").isNotNull(), hit("near", "same-file", 0.85)).when(weak & (c("n") == 1), hit("only", "unique-name", 0.7)).when(weak & c("pkg").isNotNull(), hit("pkg", "same-package", 0.55))
    found = rows.withColumn("r", rule).where("r is not null").select("source_id", "r.*", "line", "is_write")
    found = found.join(nodes.select(c("id").alias("target_id"), c("kind").alias("target_kind")), "target_id")
    kind = F.when(c("is_write"), "WRITES").when(c("target_kind") == "Variable", "READS").otherwise("USAGE")
    return _edge(found, kind, c("how"), c("sure"))


def throw_edges(throws: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, external): RAISES and THROWS to known types; (source_id, name, type, line) of
    exceptions that are no nodes."""
    kind = F.when(F.col("name").rlike("Error|Panic|error|panic"), "RAISES").otherwise("THROWS")
    rows = near_or_unique(sources_of(throws, nodes, "owner").withColumn("type", kind), nodes, TYPES, "name").withColumn("target_id", F.coalesce("near", "only"))
    return _edge(rows, F.col("type"), "throw-extraction", 0.7), rows.where("target_id is null").select("source_id", "name", "type", "line", F.lit(0.55).alias("confidence"))


def test_edges(nodes: DataFrame, import_edges: DataFrame, calls: DataFrame) -> DataFrame:
    """TESTS_FILE by import and by naming, TESTS from calls of test files."""
    c = F.col
    files = nodes.where("kind = 'File'")
    test = is_test_path(c("file_path"))["resolver"]
    source = files.where(test).select(c("id").alias("source_id"), c("file_path").alias("test_path"))
    target = files.select(c("id").alias("target_id"), c("file_path").alias("path"))
    by_import = _edge(import_edges.select("source_id", "target_id", "line").join(source, "source_id").join(target, "target_id"), "TESTS_FILE", "test-import", 0.9, None)
    by_name = _edge(source.withColumn("path", test_to_source(c("test_path"))).join(target, "path"), "TESTS_FILE", "test-name-convention", 0.95, None)
    ends = nodes.select("id", "name", test.alias("test"))
    s, t = (ends.select(c("id").alias(f"{e}_id"), c("name").alias(f"{e}_name"), c("test").alias(f"{e}_test")) for e in ("source", "target"))
    named = lambda n: c(n).rlike(r"^(test|it|describe)$|^test(_|[A-Z])|^(Test|Benchmark|Example)([A-Z]|$)")
    placed = calls.join(s, "source_id").join(t, "target_id").where(c("source_test") & ~c("target_test") & ~named("target_name"))
    return by_import.unionByName(by_name).unionByName(_edge(placed, "TESTS", "test-call", F.when(named("source_name"), 0.95).otherwise(0.8)))


def routes(files: DataFrame) -> DataFrame:
    """(file, url, methods): routes that file paths define: ``[x]`` is a parameter, ``[...x]``
    takes the rest, exported functions name the methods."""
    path = F.regexp_extract("path", ROUTE_FILE, 1)
    url = F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), path), r"\[\.\.\.[^\]]*\]", "*"), r"\[([^\]]*)\]", ":$1")
    found = F.regexp_extract_all("content", F.lit(rf"export\s+(?:async\s+)?function\s+({'|'.join(HTTP_METHODS)})\b"), F.lit(1))
    order = F.array(*(F.lit(m) for m in HTTP_METHODS))
    methods = F.array_join(F.filter(order, lambda m: F.array_contains(found, m)), ",")
    return files.where(path != "").select(F.col("path").alias("file"), url.alias("url"), F.when(methods == "", "ALL").otherwise(methods).alias("methods"))


def channels(files: DataFrame, verbs: dict[str, str] = CHANNEL_VERBS) -> DataFrame:
    """(file, channel, type, line): events that sources emit or listen on, first line of each:
    method calls whose name is one of the verbs and whose first argument is a quoted text."""
    lines = files.select(F.col("path").alias("file"), F.posexplode(F.split("content", "\n")).alias("at", "text"))
    any_call = F.lit(r"[.](\w+)\s*[(]\s*[\"']([^\"']+)[\"']")
    calls = F.arrays_zip(F.regexp_extract_all("text", any_call, F.lit(1)).alias("verb"), F.regexp_extract_all("text", any_call, F.lit(2)).alias("channel"))
    type_of = F.create_map(*(F.lit(x) for pair in verbs.items() for x in pair))
    found = lines.select("file", "at", F.explode(calls).alias("c")).select("file", "at", "c.channel", F.try_element_at(type_of, F.col("c.verb")).alias("type"))
    return found.where("type is not null").groupBy("file", "channel", "type").agg((F.min("at") + 1).alias("line"))


def observed_channels(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source_id, channel, type, line): extracted (file, channel, owner, direction, line), at the
    enclosing callable of the same file, else at the file."""
    inside = nodes.where(F.col("kind").isin(*CALLABLE)).select(F.col("qualified_name").alias("owner"), F.col("file_path").alias("file"), F.col("id").alias("owner_id"))
    placed = rows.join(inside, ["owner", "file"], "left").join(file_nodes(nodes).withColumnRenamed("file_path", "file"), "file", "left")
    return placed.select(F.coalesce("owner_id", "file_id").alias("source_id"), "channel", F.when(F.col("direction") == "emit", "EMITS").otherwise("LISTENS_ON").alias("type"), "line").where("source_id is not null")


def settings(usages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source_id, key, line): references to the environment, CONFIGURES edges to be."""
    hits = usages.where("name in ('process', 'env') or name like 'NEXT\\_PUBLIC\\_%'")
    return hits.join(file_nodes(nodes).withColumnRenamed("file_path", "file"), "file").groupBy(F.col("file_id").alias("source_id"), F.col("name").alias("key")).agg(F.min("line").alias("line"))


def decorator_edges(decorators: DataFrame, nodes: DataFrame) -> DataFrame:
    """DECORATES from (file, name, target, line): the decorator in the file, else the only one."""
    rows = near_or_unique(decorators, nodes, (*CALLABLE, "Class"), "name").withColumn("source_id", F.coalesce("near", "only"))
    return _edge(rows.join(nodes.select(F.col("qualified_name").alias("target"), F.col("id").alias("target_id")), "target"), "DECORATES", "decorator", 0.8)


_ASSIGNED = re.compile(r"\b(?:const|let)\s+([\w$]+)[^={};]*=\s*(?=\{)")
_KEY = re.compile(r"\s*(?:[\w$]+|\"[^\"]+\"|'[^']+')\s*:\s*([A-Za-z_$][\w$]*)")


def object_entries(text: str, start: int) -> Iterator[str]:
    """The entries of the object literal that opens at `start`, as texts without comments: cut at
    the commas of its own level, whatever braces, brackets and quotes lie within."""
    level, at, entry = 0, start, []
    while at < len(text):
        sign = text[at]
        if text.startswith("//", at):
            at = (text.find("\n", at) + len(text) + 1) % (len(text) + 1)  # the end where there is no line end
            continue
        if text.startswith("/*", at):
            end = text.find("*/", at)
            at = len(text) if end < 0 else end + 2
            continue
        if sign in "\"'`":
            end = at + 1
            while end < len(text) and text[end] != sign:
                end += 2 if text[end] == "\\" else 1
            entry.append(text[at : end + 1])
            at = end + 1
            continue
        level += (sign in "{[(") - (sign in "}])")
        if level == 0 or (level == 1 and sign == ","):
            yield "".join(entry)
            entry = []
            if level == 0:
                return
        elif at > start:
            entry.append(sign)
        at += 1


def registries(text: str, words: tuple[str, ...] = REGISTRY_WORDS) -> list[tuple[str, str]]:
    """(registry, name) of the names that object literals hold under their keys, for literals
    whose own name has one of the words after its first letter."""
    out = []
    for found in _ASSIGNED.finditer(text):
        if any(w in found[1][1:].lower() for w in words):
            out += [(found[1], key[1]) for key in map(_KEY.match, object_entries(text, found.end())) if key]
    return out


def registry_edges(files: DataFrame, calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """REGISTRY_DISPATCH: calls through an object literal of functions may reach each of them."""

    @F.pandas_udf("array<struct<registry:string,name:string>>")
    def held(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"registry": r, "name": n} for r, n in registries(t or "")])

    found = files.where(F.col("path").rlike("[.](ts|tsx|js|jsx)$")).select(F.col("path").alias("file"), F.explode(held("content")).alias("p")).select("file", "p.registry", "p.name").distinct()
    used = calls.where("callee like '%[%'").select("file", F.substring_index("callee", "[", 1).alias("registry"), "caller", "line")
    rows = near_or_unique(sources_of(used.join(found, ["file", "registry"]), nodes, "caller"), nodes, CALLABLE, "name")
    return _edge(rows.withColumn("target_id", F.coalesce("near", "only")), "REGISTRY_DISPATCH", "static-registry-pattern", 0.35)


def nearest_declaration(uses: DataFrame, declarations: DataFrame) -> DataFrame:
    """As-of join: each use (use_id, file, owner, name, line) with the latest declaration
    (decl_id, file, owner, name, start_line, scope_end) at or before its line whose scope still
    holds. The condition is tested within one file, owner and name."""
    hit = uses.join(declarations, ["file", "owner", "name"]).where("start_line <= line and line <= scope_end")
    return hit.groupBy("use_id").agg(F.max(F.struct("start_line", "decl_id"))["decl_id"].alias("decl_id"))


def module_identities(files: DataFrame) -> DataFrame:
    """(path, identity): the dotted path without extension; where two share it, with the
    extension; where that is shared too, with a hash of the path."""
    base = F.replace(F.regexp_replace("path", r"[.][A-Za-z0-9]+$", ""), F.lit("/"), F.lit("."))
    tagged = F.concat(base, F.lit("~"), F.regexp_extract("path", r"[.]([A-Za-z0-9]+)$", 1))
    one = F.count("*").over(Window.partitionBy("base"))
    first = files.select("path").distinct().withColumns({"base": base, "tagged": tagged}).withColumn("n", one)
    second = first.withColumn("m", F.count("*").over(Window.partitionBy("tagged")))
    return second.select("path", F.when(F.col("n") == 1, F.col("base")).when(F.col("m") == 1, F.col("tagged")).otherwise(F.concat("tagged", F.lit("~"), F.substring(F.sha2("path", 256), 1, 8))).alias("identity"))
