"""Queries of the resolver's passes over the graph lens, with observations made from its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import resolve as V
from loomgraph.plans.lens import CUSTOMER, PART, SUPPLIER
from loomgraph.plans.registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
_COLUMNS = ["id", "kind", "name", "qualified_name", "file_path", "start_line", "is_exported"]
FILES = 10**15  # offset of the ids of file nodes

_GN = f", gf AS (SELECT file_path, min(id) + {FILES} AS id FROM g_nodes GROUP BY file_path), gn AS (SELECT id, kind, name, qualified_name, file_path, start_line, is_exported FROM g_nodes UNION ALL SELECT id, 'File', file_path, file_path, file_path, 0, 1 FROM gf)"
_TEST = "regexp_matches({}, '__tests__/|(^|/)tests?/|(^|/)test_[^/]*$|[.](test|spec)[.]|(_test|_spec|Test|Spec)[.][^.]+$')".format


def with_files(nodes: DataFrame) -> DataFrame:
    """The lens with a node for each file, as an index has them."""
    path = F.col("file_path")
    files = nodes.groupBy("file_path").agg((F.min("id") + FILES).alias("id")).select("id", F.lit("File").alias("kind"), path.alias("name"), path.alias("qualified_name"), "file_path", F.lit(0).alias("start_line"), F.lit(1).alias("is_exported"))
    return nodes.select(*_COLUMNS).unionByName(files)


def seen(nodes: DataFrame, edges: DataFrame, type: str) -> DataFrame:
    """Edges of a type as observations in a file: (file, name, owner, target_file, target, line)."""
    c = F.col
    source = nodes.select(c("id").alias("source_id"), c("file_path").alias("file"), c("qualified_name").alias("owner"))
    target = nodes.select(c("id").alias("target_id"), "name", c("file_path").alias("target_file"), c("qualified_name").alias("target"))
    return edges.where(c("type") == type).join(source, "source_id").join(target, "target_id")


def among(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes whose ids lie in the span of the edges' ends, to be joined by shuffle: no other is
    an end, so that those of other kinds needn't be moved."""
    ends = edges.select(F.least("source_id", "target_id").alias("low"), F.greatest("source_id", "target_id").alias("high"))
    return nodes.where(F.col("id").between(*ends.agg(F.min("low"), F.max("high")).first())).hint("merge")


def _seen(type: str) -> str:
    return f"(SELECT e.source_id, e.target_id, e.line, s.file_path AS file, s.qualified_name AS owner, t.name, t.file_path AS target_file, t.qualified_name AS target FROM g_edges e JOIN g_nodes s ON s.id = e.source_id JOIN g_nodes t ON t.id = e.target_id WHERE e.type = '{type}')"


@R.graph("op131_branch", "SELECT id AS source_id, 'main' AS branch, 'HAS_BRANCH' AS type FROM g_nodes WHERE kind = 'Folder'")
def _(nodes, edges):
    return V.branch(nodes.withColumn("kind", F.when(F.col("kind") == "Folder", "Project").otherwise(F.col("kind"))), "main")


@R.graph("op132_definitions", f"{_GN}, m AS (SELECT c.id AS owner, i.id, i.start_line FROM g_nodes i JOIN g_nodes c ON c.id = {SUPPLIER} + (i.id - {CUSTOMER}) % 10 + 1 WHERE i.kind = 'Interface') SELECT gf.id AS source_id, n.id AS target_id, 'DEFINES' AS type, n.start_line AS line FROM g_nodes n JOIN gf USING (file_path) WHERE kind NOT IN ('File', 'Folder') UNION ALL SELECT owner, id, 'DEFINES_METHOD', start_line FROM m")
def _(nodes, edges):
    c = F.col
    owner = nodes.where("kind = 'Class'").select(c("id").alias("owner"), c("qualified_name").alias("owner_name"))
    methods = nodes.where("kind = 'Interface'").withColumn("owner", SUPPLIER + (c("id") - CUSTOMER) % 10 + 1).join(owner, "owner", "left")
    named = methods.withColumns({"kind": F.when(c("owner_name").isNotNull(), "Method").otherwise(c("kind")), "qualified_name": F.coalesce(F.concat("owner_name", F.lit("."), "name"), "qualified_name")}).select(*nodes.columns)
    return V.definitions(with_files(nodes.where("kind <> 'Interface'").unionByName(named))).select("source_id", "target_id", "type", "line")


_BASES = f"bases AS (SELECT s.file_path AS file, s.name, i.name AS base FROM g_nodes s JOIN g_nodes i ON i.id = {CUSTOMER} + 3 * (s.id - {SUPPLIER}) WHERE s.kind = 'Class' UNION ALL SELECT file_path, name, 'Missing' FROM g_nodes WHERE kind = 'Class' UNION ALL SELECT s.file_path, s.name, o.name FROM g_nodes s JOIN g_nodes o ON o.file_path = s.file_path AND o.id <> s.id WHERE s.kind = 'Class' AND o.kind = 'Class')"


@R.graph("op133_heritage", f", {_BASES}, k AS (SELECT * FROM g_nodes WHERE kind IN ('Class', 'Interface')), near AS (SELECT file_path AS file, name AS base, min(id) AS near FROM k GROUP BY ALL), lone AS (SELECT name AS base, min(id) AS lone FROM k GROUP BY name HAVING count(*) = 1) SELECT DISTINCT k.id AS source_id, coalesce(near, lone) AS target_id, CASE WHEN near IS NOT NULL THEN 0.9 ELSE 0.75 END::DOUBLE AS confidence FROM bases b JOIN k ON k.file_path = b.file AND k.name = b.name LEFT JOIN near USING (file, base) LEFT JOIN lone USING (base) WHERE coalesce(near, lone) <> k.id")
def _(nodes, edges):
    c = F.col
    classes = nodes.where("kind = 'Class'").select(c("file_path").alias("file"), "name", "id")
    other = nodes.where("kind = 'Interface'").select(((c("id") - CUSTOMER) / 3 + SUPPLIER).alias("at"), c("name").alias("base"))
    far = classes.join(other, c("id") == c("at")).select("file", "name", "base")
    near = classes.join(classes.select("file", c("name").alias("base")), "file").where("base <> name").select("file", "name", "base")
    bases = far.unionByName(near).unionByName(classes.select("file", "name", F.lit("Missing").alias("base")))
    return V.heritage(nodes, bases).select("source_id", "target_id", "confidence")


_IMPORTS = f"""{_GN}, i AS (SELECT DISTINCT file, name, target_file, line FROM {_seen("IMPORTS")}), files_edges AS (SELECT DISTINCT a.id AS source_id, b.id AS target_id, line FROM i JOIN gf a ON a.file_path = file JOIN gf b ON b.file_path = target_file WHERE a.id <> b.id),
symbols AS (SELECT DISTINCT a.id AS source_id, n.id AS target_id, i.line FROM i JOIN gf a ON a.file_path = file JOIN g_nodes n ON n.file_path = target_file AND n.name = i.name WHERE n.kind IN ('Function', 'Method', 'Class', 'Interface', 'Type', 'Enum', 'Variable', 'Macro'))"""


def _imports(nodes, edges):
    rows = seen(nodes, edges, "IMPORTS").select("file", F.col("name").alias("local_name"), F.regexp_replace("target_file", "[.]ts$", "").alias("module_path"), "line").distinct()
    return V.imported(with_files(nodes), rows)


@R.graph("op134_imports", f"{_IMPORTS} SELECT source_id, target_id, 'module' AS resolution, line FROM files_edges UNION ALL SELECT source_id, target_id, 'module-export', line FROM symbols")
def _(nodes, edges):
    return _imports(nodes, edges)[0].select("source_id", "target_id", "resolution", "line")


@R.graph("op140_tests", f"{_IMPORTS} SELECT DISTINCT e.source_id, e.target_id, 'TESTS_FILE' AS type, 0.9::DOUBLE AS confidence FROM files_edges e JOIN gf s ON s.id = source_id WHERE {_TEST('s.file_path')} UNION ALL SELECT DISTINCT e.source_id, e.target_id, 'TESTS', 0.8 FROM g_edges e JOIN g_nodes s ON s.id = source_id JOIN g_nodes t ON t.id = target_id WHERE e.type = 'CALLS' AND {_TEST('s.file_path')} AND NOT {_TEST('t.file_path')} AND source_id <> target_id")
def _(nodes, edges):
    return V.test_edges(with_files(nodes), _imports(nodes, edges)[0], edges.where("type = 'CALLS'")).select("source_id", "target_id", "type", "confidence").distinct()


_CALLS = f"""{_GN}, calls AS (SELECT file, CASE WHEN target_id % 9 = 0 THEN 'box.' || name WHEN target_id % 9 = 1 THEN 'no_' || name ELSE name END AS callee, owner AS caller, line, source_id, CASE WHEN target_id % 9 = 0 THEN 1 ELSE 0 END AS qualified FROM {_seen("REGISTRY_DISPATCH")}),
k AS (SELECT *, regexp_replace(file_path, '/?[^/]*$', '') AS dir, (kind <> 'Method' AND is_exported <> 0) AS free FROM g_nodes WHERE kind IN ('Function', 'Method')),
visible AS (SELECT DISTINCT file, target AS qualified_name FROM {_seen("CALLS")} WHERE source_id % 3 = 0 AND source_id < {PART + 10**12}),
c2 AS (SELECT *, regexp_replace(callee, '^.*[.]', '') AS method, regexp_replace(file, '/?[^/]*$', '') AS dir FROM calls),
near AS (SELECT file_path AS file, name AS method, min(id) AS near FROM k GROUP BY ALL), imp AS (SELECT v.file, name AS method, count(*) AS imp_n, min(id) AS imp, min(id) FILTER (k.file_path <> v.file) AS away FROM visible v JOIN k USING (qualified_name) GROUP BY ALL),
names AS (SELECT name AS method, count(*) AS all_n, min(id) AS any_id, count(*) FILTER (free) AS exp_n, min(id) FILTER (free) AS exp, bool_and(free) AS any_free FROM k GROUP BY name), pkg AS (SELECT dir, name AS method, min(id) FILTER (free) AS pkg_exp, min(id) AS pkg FROM k GROUP BY ALL),
r AS (SELECT c2.*, CASE WHEN qualified = 0 AND near IS NOT NULL THEN struct_pack(t := near, why := 'same-file') WHEN near IS NOT NULL THEN struct_pack(t := near, why := 'same-file-name') WHEN imp_n = 1 THEN struct_pack(t := imp, why := 'imported-name') WHEN imp_n > 1 THEN struct_pack(t := coalesce(away, imp), why := 'imported-name')
  WHEN qualified = 1 THEN struct_pack(t := NULL::BIGINT, why := 'unknown-receiver') WHEN exp_n = 1 THEN struct_pack(t := exp, why := 'unique-name') WHEN exp_n > 1 AND pkg_exp IS NOT NULL THEN struct_pack(t := pkg_exp, why := 'package-name')
  WHEN all_n = 1 THEN CASE WHEN any_free THEN struct_pack(t := any_id, why := 'unique-name') ELSE struct_pack(t := NULL::BIGINT, why := 'not-exported') END WHEN pkg IS NOT NULL THEN struct_pack(t := pkg, why := 'package-name') ELSE struct_pack(t := NULL::BIGINT, why := 'not-found') END AS x
  FROM c2 LEFT JOIN near USING (file, method) LEFT JOIN imp USING (file, method) LEFT JOIN names USING (method) LEFT JOIN pkg USING (dir, method)),
resolved AS (SELECT file, callee, caller, line, source_id, x.t AS target_id, x.why AS reason FROM r)"""


def _resolved(nodes, edges):
    c = F.col
    few = edges.where((c("type") == "REGISTRY_DISPATCH") | ((c("type") == "CALLS") & (c("source_id") % 3 == 0) & (c("source_id") < PART + 10**12)))
    ends = among(nodes, few)
    rows = seen(ends, few, "REGISTRY_DISPATCH")
    # single-word names, so that a receiver is one word: others would be no call at all
    callee = F.when(c("target_id") % 9 == 0, F.concat(F.lit("box."), "name")).when(c("target_id") % 9 == 1, F.concat(F.lit("no_"), "name")).otherwise(c("name"))
    visible = seen(ends, few, "CALLS").select("file", c("target").alias("qualified_name")).distinct()
    return V.resolve_calls(rows.select("file", callee.alias("callee"), c("owner").alias("caller"), "line"), nodes, visible)


@R.graph("op135_resolved_calls", f"{_CALLS} SELECT file, callee, caller, line, target_id, reason FROM resolved")
def _(nodes, edges):
    return _resolved(nodes, edges).select("file", "callee", "caller", "line", "target_id", "reason")


@R.graph("op135_call_edges", f"{_CALLS} SELECT DISTINCT source_id, target_id, reason AS resolution, line FROM resolved WHERE target_id IS NOT NULL AND target_id <> source_id")
def _(nodes, edges):
    return V.call_edges(_resolved(nodes, edges), with_files(nodes)).select("source_id", "target_id", "resolution", "line")


@R.graph("op145_resolution_stats", f"{_CALLS} SELECT file, (SELECT count(*) FROM resolved t WHERE t.file = r.file) AS total, (SELECT count(*) FROM resolved t WHERE t.file = r.file AND t.target_id IS NULL) AS unresolved, reason, count(*) AS n FROM resolved r WHERE target_id IS NULL GROUP BY file, reason")
def _(nodes, edges):
    return V.resolution_stats(_resolved(nodes, edges)).select("file", "total", "unresolved", F.explode("reasons").alias("reason", "n"))


_REGISTRY = f"{_GN}, held AS (SELECT file_path AS file, unnest([name, 'nowhere']) AS name FROM g_nodes WHERE kind = 'Function')"


@R.graph("op136_registry_dispatch", f"{_REGISTRY}, k AS (SELECT * FROM g_nodes WHERE kind IN ('Function', 'Method')), near AS (SELECT file_path AS file, name, min(id) AS near FROM k GROUP BY ALL), calls AS (SELECT file_path AS file, id AS source_id, start_line AS line FROM g_nodes WHERE kind = 'Function' AND id % 4 = 0) SELECT DISTINCT c.source_id, near AS target_id, line FROM calls c JOIN held USING (file) JOIN near USING (file, name) WHERE near <> c.source_id")
def _(nodes, edges):
    c = F.col
    functions = nodes.where("kind = 'Function'")
    entry = F.concat(F.lit("  '"), c("id").cast("string"), F.lit("': "), "name", F.lit(", // }\n"))
    lines = functions.groupBy(c("file_path").alias("path")).agg(F.array_join(F.sort_array(F.collect_list(entry)), "").alias("lines"))  # a file's own functions
    files = lines.select("path", F.concat(F.lit("const toolHandlers: Table = {\n  nested: { a: x, b: [1, 2] },\n"), "lines", F.lit("  last: nowhere };\nconst other = { a: ignored };")).alias("content"))
    calls = functions.where("id % 4 = 0").select(c("file_path").alias("file"), F.lit("toolHandlers[kind]").alias("callee"), c("qualified_name").alias("caller"), c("start_line").alias("line"))
    return V.registry_edges(files, calls, with_files(nodes)).select("source_id", "target_id", "line")


@R.graph("op137_routes", "SELECT 'web/app/' || replace(regexp_replace(file_path, '[.]ts$', ''), '#', '') || '/[id]/route.ts' AS file, '/' || replace(regexp_replace(file_path, '[.]ts$', ''), '#', '') || '/:id' AS url, CASE id % 3 WHEN 0 THEN 'GET,POST' WHEN 1 THEN 'DELETE' ELSE 'ALL' END AS methods FROM g_nodes WHERE kind = 'Class'")
def _(nodes, edges):
    c = F.col
    path = F.concat(F.lit("web/app/"), F.replace(F.regexp_replace("file_path", "[.]ts$", ""), F.lit("#"), F.lit("")), F.lit("/[id]/route.ts"))
    content = F.when(c("id") % 3 == 0, "export async function POST() {}\nexport function GET() {}").when(c("id") % 3 == 1, "export function DELETE() {}").otherwise("function GET() {}")
    return V.routes(nodes.where("kind = 'Class'").select(path.alias("path"), content.alias("content")))


@R.graph("op138_usages", f"{_GN}, visible AS (SELECT DISTINCT file, target AS qualified_name FROM {_seen('USAGE')} WHERE target_id % 2 = 0 AND target_id % 11 <> 0), seen AS (SELECT v.file, n.name, min(n.id) AS imp FROM visible v JOIN g_nodes n USING (qualified_name) GROUP BY ALL) SELECT DISTINCT u.source_id, u.target_id, CASE WHEN line % 2 = 1 THEN 'WRITES' ELSE 'USAGE' END AS type, CASE WHEN imp IS NOT NULL THEN 'import-map' ELSE 'unique-name' END AS resolution, line FROM {_seen('USAGE')} u LEFT JOIN seen USING (file, name) WHERE target_id % 11 <> 0")
def _(nodes, edges):
    c = F.col
    rows = seen(nodes, edges, "USAGE").where("target_id % 11 <> 0")
    visible = rows.where("target_id % 2 = 0").select("file", c("target").alias("qualified_name")).distinct()
    found = V.usage_edges(rows.select("file", "name", "owner", "line", (c("line") % 2 == 1).alias("is_write")), with_files(nodes), visible)
    return found.select("source_id", "target_id", "type", "resolution", "line")


def _thrown(nodes, edges):
    c = F.col
    rows = seen(nodes, edges, "IMPORTS").select("file", F.when(c("target_id") % 3 == 0, F.lit("TimeoutError")).when(c("target_id") % 3 == 1, F.lit("Stop")).otherwise(c("name")).alias("name"), "owner", (c("target_id") % 50).cast("int").alias("line"))
    return V.throw_edges(rows, with_files(nodes))


@R.graph("op139_throws", f"SELECT DISTINCT source_id, target_id, 'THROWS' AS type, (target_id % 50)::INT AS line FROM {_seen('IMPORTS')} WHERE target_id % 3 = 2")
def _(nodes, edges):
    return _thrown(nodes, edges)[0].select("source_id", "target_id", "type", "line")


@R.graph("op139_external_exceptions", f"SELECT DISTINCT source_id, CASE target_id % 3 WHEN 0 THEN 'TimeoutError' ELSE 'Stop' END AS name, CASE target_id % 3 WHEN 0 THEN 'RAISES' ELSE 'THROWS' END AS type, (target_id % 50)::INT AS line FROM {_seen('IMPORTS')} WHERE target_id % 3 < 2")
def _(nodes, edges):
    return _thrown(nodes, edges)[1].select("source_id", "name", "type", "line").distinct()


@R.graph("op141_settings", f"{_GN}, u AS (SELECT file_path AS file, CASE id % 5 WHEN 0 THEN 'process' WHEN 1 THEN 'env' WHEN 2 THEN 'NEXT_PUBLIC_' || (id % 7) WHEN 3 THEN 'NEXTxPUBLIC_' ELSE name END AS name, start_line AS line FROM g_nodes WHERE kind = 'Method') SELECT gf.id AS source_id, name AS key, min(line) AS line FROM u JOIN gf ON gf.file_path = file WHERE name IN ('process', 'env') OR starts_with(name, 'NEXT_PUBLIC_') GROUP BY ALL")
def _(nodes, edges):
    last = F.col("id") % 5
    name = F.when(last == 0, "process").when(last == 1, "env").when(last == 2, F.concat(F.lit("NEXT_PUBLIC_"), (F.col("id") % 7).cast("string"))).when(last == 3, "NEXTxPUBLIC_").otherwise(F.col("name"))
    return V.settings(nodes.where("kind = 'Method'").select(F.col("file_path").alias("file"), name.alias("name"), F.col("start_line").alias("line")), with_files(nodes))


@R.graph("op142_observed_channels", f"{_GN} SELECT coalesce(CASE WHEN n.id % 3 > 0 THEN n.id END, gf.id) AS source_id, 'c' || (n.id % 5) AS channel, CASE WHEN n.id % 2 = 0 THEN 'EMITS' ELSE 'LISTENS_ON' END AS type, start_line AS line FROM g_nodes n JOIN gf USING (file_path) WHERE kind = 'Function'")
def _(nodes, edges):
    c = F.col
    owner = F.when(c("id") % 3 == 0, "elsewhere").otherwise(c("qualified_name"))
    rows = nodes.where("kind = 'Function'").select(c("file_path").alias("file"), F.concat(F.lit("c"), (c("id") % 5).cast("string")).alias("channel"), owner.alias("owner"), F.when(c("id") % 2 == 0, "emit").otherwise("listen").alias("direction"), c("start_line").alias("line"))
    return V.observed_channels(rows, with_files(nodes))


_SAID = "WITH t AS (SELECT doc_id::VARCHAR AS file, text || chr(10) || 'bus.emit(' || chr(39) || 'd' || (doc_id % 7) || chr(39) || ')' || chr(10) || 'x.once( \"d' || (doc_id % 3) || '\" , f); y.of(''no'')' AS content FROM documents WHERE text IS NOT NULL), l AS (SELECT file, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM t)"
_CALLED = r"""'[.]({v})\s*[(]\s*["'']([^"'']+)["'']'""".format
_ONE = "SELECT file, line, unnest(regexp_extract_all(text, {p}, 2)) AS channel, '{t}' AS type FROM l".format


@R.table("op142_text_channels", f"{_SAID}, c AS ({_ONE(p=_CALLED(v='emit|send|publish|broadcast'), t='EMITS')} UNION ALL {_ONE(p=_CALLED(v='on|once|subscribe|addListener'), t='LISTENS_ON')}) SELECT file, channel, type, min(line)::INT AS line FROM c GROUP BY ALL")
def _(read):
    last = lambda n: (F.col("doc_id") % n).cast("string")
    content = F.concat("text", F.lit("\nbus.emit('d"), last(7), F.lit("')\nx.once( \"d"), last(3), F.lit("\" , f); y.of('no')"))
    return V.channels(read("documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), content.alias("content")))


@R.graph("op144_decorators", f", d AS (SELECT file, name, owner AS target, line, source_id FROM {_seen('USAGE')} WHERE source_id % 3 = 0) SELECT DISTINCT n.id AS source_id, d.source_id AS target_id, line FROM d JOIN g_nodes n ON n.name = d.name AND n.kind = 'Class'")
def _(nodes, edges):
    rows = seen(nodes, edges, "USAGE").where("source_id % 3 = 0").select("file", "name", F.col("owner").alias("target"), "line")
    return V.decorator_edges(rows, nodes).select("source_id", "target_id", "line")


_HTTP = f"""{_GN}, h AS (SELECT id AS source_id, start_line AS line, id % 6 AS k, file_path AS file, CASE id % 5 WHEN 0 THEN 'api.get' WHEN 1 THEN 'fetch' WHEN 2 THEN 'axios.POST' WHEN 3 THEN 'other' ELSE 'x.client.delete' END AS callee FROM g_nodes WHERE kind = 'Function'),
u AS (SELECT source_id, line, CASE split_part(callee, '.', -1) WHEN 'get' THEN 'GET' WHEN 'fetch' THEN 'GET' WHEN 'POST' THEN 'POST' WHEN 'delete' THEN 'DELETE' END AS method, CASE k WHEN 0 THEN '/' || file WHEN 1 THEN 'https://h/' || (source_id % 7) WHEN 2 THEN '/a/:param/b' WHEN 3 THEN '[dynamic]' END AS url FROM h), r AS (SELECT *, 'route.' || sha256(method || ':' || url) AS route FROM u WHERE method IS NOT NULL AND url IS NOT NULL)"""


def _http(nodes):
    c = F.col
    k = c("id") % 6
    callee = F.when(c("id") % 5 == 0, "api.get").when(c("id") % 5 == 1, "fetch").when(c("id") % 5 == 2, "axios.POST").when(c("id") % 5 == 3, "other").otherwise("x.client.delete")
    args = F.when(k == 0, F.array(F.lit("'text'"), F.concat(F.lit(" '/"), "file_path", F.lit("' ")))).when(k == 1, F.array(F.concat(F.lit('"https://h/'), (c("id") % 7).cast("string"), F.lit('"')))).when(k == 2, F.array(F.lit("`/a/${id}/b`"))).when(k == 3, F.array(F.lit("opts"), F.lit("this.baseUrl"))).when(k == 4, F.array(F.lit("x + 1"), F.lit("'plain'")))
    calls = nodes.where("kind = 'Function'").select(c("file_path").alias("file"), callee.alias("callee"), c("qualified_name").alias("caller"), c("start_line").alias("line"), F.coalesce(args, F.array().cast("array<string>")).alias("args"))
    return V.http_calls(calls, with_files(nodes))


@R.graph("op135_http_calls", f"{_HTTP} SELECT DISTINCT source_id, route, 'HTTP_CALLS' AS type, line FROM r")
def _(nodes, edges):
    return _http(nodes)[1]


@R.graph("op135_http_routes", f"{_HTTP} SELECT DISTINCT route AS qualified_name, url, method FROM r")
def _(nodes, edges):
    return _http(nodes)[0]


@R.graph("op134_package_folders", ", f AS (SELECT DISTINCT regexp_replace(file_path, '/[^/]*$', '') AS folder FROM g_nodes WHERE contains(file_path, '/')), m AS (SELECT DISTINCT 'example.org/mod/' || folder AS module_path FROM f UNION SELECT 'x/' || string_split(folder, '/')[-1] FROM f), t AS (SELECT module_path, folder, len(list_filter(range(1, least(len(string_split(folder, '/')), len(string_split(module_path, '/'))) + 1), lambda i: list_slice(string_split(folder, '/'), -i, -1) = list_slice(string_split(module_path, '/'), -i, -1))) AS n FROM m, f), b AS (SELECT module_path, max(n) AS n FROM t WHERE n > 0 GROUP BY 1) SELECT module_path, min(folder) AS folder FROM t JOIN b USING (module_path, n) GROUP BY 1 HAVING count(*) = 1")
def _(nodes, edges):
    folders = nodes.where("contains(file_path, '/')").select(V.folder(F.col("file_path")).alias("folder")).distinct()
    imports = folders.select(F.concat(F.lit("example.org/mod/"), "folder").alias("module_path")).unionByName(folders.select(F.concat(F.lit("x/"), F.element_at(F.split("folder", "/"), -1)).alias("module_path")))
    return V.package_folder(imports, folders)
