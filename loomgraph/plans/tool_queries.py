"""Queries of the composite tools."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import evidence as E
from loomgraph.operators import resolve as R0
from loomgraph.operators import tools as T
from loomgraph.operators.search import degrees
from loomgraph.plans.lens import PART
from loomgraph.plans.registry import Registry
from loomgraph.sources import manifests as M

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
_DEG = ", deg AS (SELECT id, count(*) AS n FROM (SELECT source_id AS id FROM g_edges UNION ALL SELECT target_id FROM g_edges) GROUP BY id)"


@R.graph("op151_find_tests", ", t AS (SELECT DISTINCT source_id, target_id FROM g_edges WHERE type IN ('TESTS', 'TESTS_FILE')), own AS (SELECT target_id AS id, count(*) AS n FROM t GROUP BY 1), f AS (SELECT file_path, count(DISTINCT source_id) AS n FROM t JOIN g_nodes n ON n.id = target_id GROUP BY 1) SELECT g.id, CASE WHEN own.n IS NOT NULL THEN 'symbol' WHEN f.n IS NOT NULL THEN 'file' ELSE 'none' END AS level, coalesce(own.n, f.n, 0) AS tests FROM g_nodes g LEFT JOIN own ON own.id = g.id LEFT JOIN f ON f.file_path = g.file_path WHERE g.kind IN ('Function', 'Class')")
def _(nodes, edges):
    return T.find_tests(nodes, edges, nodes.where("kind in ('Function', 'Class')"))


@R.table("op151_tests_by_text", """WITH w AS (SELECT DISTINCT id, name FROM nodes WHERE name IS NOT NULL), s AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_$]+')) AS name FROM documents), k AS (SELECT name, count(*) AS n FROM s WHERE name IN (SELECT name FROM w) GROUP BY name)
SELECT id, CASE WHEN id % 5 = 0 THEN 'symbol' WHEN n IS NULL THEN 'none' ELSE 'text' END AS level, CASE WHEN id % 5 = 0 THEN 2 ELSE coalesce(n, 0) END AS tests FROM w LEFT JOIN k USING (name)""")
def _(read):
    nodes = read("nodes").where("name is not null").select("id", "name", F.concat(F.lit("f"), F.col("id").cast("string")).alias("file_path"))
    edges = nodes.where("id % 5 = 0").select(F.explode(F.array(-F.col("id") - 1, -F.col("id") - 2)).alias("source_id"), F.col("id").alias("target_id"), F.lit("TESTS").alias("type"))
    texts = read("documents").where("text is not null").select(F.col("doc_id").cast("string").alias("file_path"), F.col("text").alias("content"))
    return T.find_tests_by_text(nodes, edges, nodes, texts)


_PROD = "is_test = 0 AND file_path NOT LIKE 'tests/%' AND file_path NOT LIKE '%/tests/%'"
_HOT = f"""fan AS (SELECT e.target_id AS id, count(*) AS fan_in, count(DISTINCT nullif(s.qualified_name, '')) AS callers FROM g_edges e JOIN g_nodes s ON s.id = source_id WHERE type = 'CALLS' GROUP BY 1),
hot AS (SELECT qualified_name, fan_in, round(fan_in * 0.4 + callers * 0.6, 6)::DOUBLE AS score, id FROM g_nodes JOIN fan USING (id) WHERE kind IN ('Function', 'Method') AND {_PROD} ORDER BY score DESC, qualified_name, id LIMIT 20)"""


@R.graph("op158_hotspot_report", f""", {_HOT}, m AS (SELECT *, (properties->>'cyclomaticComplexity')::DOUBLE AS cc, (properties->>'lineCount')::DOUBLE AS lines FROM g_nodes WHERE {_PROD}), f AS (SELECT * FROM m WHERE kind IN ('Function', 'Method'))
SELECT 'hotspot' AS part, qualified_name AS name, score AS value FROM hot UNION ALL SELECT * FROM (SELECT 'complex', qualified_name, cc FROM f WHERE cc IS NOT NULL ORDER BY cc DESC, qualified_name LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'coupled', qualified_name, count(*)::DOUBLE FROM m JOIN g_edges e ON e.target_id = m.id WHERE kind IN ('Function', 'Method', 'Class', 'Module') GROUP BY m.id, qualified_name ORDER BY count(*) DESC, qualified_name LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'large', qualified_name, lines FROM m WHERE kind IN ('Module', 'Class') AND lines > 10 ORDER BY lines DESC, qualified_name LIMIT 20)
UNION ALL SELECT 'stats', 'functions', count(*)::DOUBLE FROM f UNION ALL SELECT 'stats', 'avg_complexity', round(avg(cc), 2) FROM f UNION ALL SELECT 'stats', 'avg_lines', round(avg(lines), 2) FROM f""")
def _(nodes, edges):
    return T.hotspot_report(nodes, edges)


@R.graph("op159_architecture", f""", {_HOT} SELECT 'total' AS part, 'nodes' AS name, count(*) AS n FROM g_nodes UNION ALL SELECT 'total', 'edges', count(*) FROM g_edges UNION ALL SELECT 'extension', regexp_extract(file_path, '[.]([A-Za-z0-9]+)$', 1), count(DISTINCT file_path) FROM g_nodes GROUP BY 2
UNION ALL SELECT 'kind', kind, count(*) FROM g_nodes GROUP BY kind UNION ALL SELECT 'type', type, count(*) FROM g_edges GROUP BY type
UNION ALL SELECT * FROM (SELECT 'entry', qualified_name, start_line::BIGINT FROM g_nodes WHERE is_entry_point = 1 AND kind IN ('Function', 'Method', 'Class', 'Module', 'Route') AND file_path <> '' ORDER BY (kind = 'Route')::INT DESC, regexp_matches(file_path, '(^|/)index[.]')::INT DESC, file_path, start_line, id LIMIT 20) UNION ALL SELECT 'hotspot', qualified_name, fan_in FROM hot""")
def _(nodes, edges):
    return T.architecture(nodes, edges)


@R.graph("op163_investigate", f""", i_all AS (SELECT {PART + 12}::BIGINT AS id, 0 AS hop UNION SELECT e.source_id, hop + 1 FROM i_all r JOIN g_edges e ON e.target_id = r.id WHERE type = 'CALLS' AND hop < 2), o_all AS (SELECT {PART + 12}::BIGINT AS id, 0 AS hop UNION SELECT e.target_id, hop + 1 FROM o_all r JOIN g_edges e ON e.source_id = r.id WHERE type = 'CALLS' AND hop < 2),
way AS (SELECT 'inbound' AS layer, id, min(hop) AS hop FROM i_all GROUP BY id UNION ALL SELECT 'outbound', id, min(hop) FROM o_all GROUP BY id), n AS (SELECT * FROM g_nodes WHERE id = {PART + 12})
SELECT way.layer, qualified_name AS name, hop::BIGINT AS value FROM way JOIN g_nodes USING (id) WHERE hop > 0 AND is_test = 0 AND NOT regexp_matches(file_path, '(^|/)(tests?|__tests__)/|[.](test|spec)[.]')
UNION ALL SELECT 'explain', qualified_name || ':fan_in', (SELECT count(*) FROM g_edges WHERE type IN ('CALLS', 'USAGE', 'TESTS') AND target_id = n.id) FROM n UNION ALL SELECT 'explain', qualified_name || ':fan_out', (SELECT count(*) FROM g_edges WHERE type IN ('CALLS', 'USAGE', 'IMPORTS') AND source_id = n.id) FROM n UNION ALL SELECT 'explain', qualified_name || ':callers', (SELECT count(DISTINCT source_id) FROM g_edges WHERE type IN ('CALLS', 'USAGE', 'TESTS') AND target_id = n.id) FROM n
UNION ALL SELECT 'tests:symbol', qualified_name, (SELECT count(DISTINCT source_id) FROM g_edges WHERE type = 'TESTS' AND target_id = n.id) FROM n""", walks=True)
def _(nodes, edges, walk):
    name = nodes.where(F.col("id") == PART + 12).select("qualified_name").first()[0]
    return T.investigate(nodes, edges, name, 2, walk).where("layer <> 'search'")  # ranked search is op90


@R.graph("op157_explain_symbols", ", i AS (SELECT target_id AS id, count(*) AS fan_in, count(DISTINCT source_id) AS callers FROM g_edges WHERE type IN ('CALLS', 'USAGE', 'TESTS') GROUP BY 1), o AS (SELECT source_id AS id, count(*) AS fan_out FROM g_edges WHERE type IN ('CALLS', 'USAGE', 'IMPORTS') GROUP BY 1), r AS (SELECT n.id, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, coalesce(callers, 0) AS callers, n.id IN (SELECT target_id FROM g_edges WHERE type IN ('TESTS', 'TESTS_FILE')) AS tested, (properties->>'cyclomaticComplexity')::DOUBLE AS complexity FROM g_nodes n LEFT JOIN i USING (id) LEFT JOIN o USING (id) WHERE kind IN ('Function', 'Method', 'Class', 'Interface')) SELECT *, CASE WHEN fan_in >= 20 OR complexity > 100 THEN 'critical' WHEN fan_in >= 10 OR complexity > 50 THEN 'high' WHEN fan_in >= 5 OR complexity > 20 THEN 'medium' ELSE 'low' END AS risk FROM r")
def _(nodes, edges):
    return T.explain_symbols(nodes, edges)


@R.graph("op157_explain_context", f", w AS (SELECT id, qualified_name FROM g_nodes WHERE id BETWEEN {PART + 1} AND {PART + 40}), c AS (SELECT target_id AS id, type, source_id AS other, row_number() OVER (PARTITION BY target_id ORDER BY source_id, type, id) AS r FROM g_edges WHERE type IN ('CALLS', 'USAGE', 'TESTS')), d AS (SELECT source_id AS id, type, target_id AS other, row_number() OVER (PARTITION BY source_id ORDER BY target_id, type, id) AS r FROM g_edges WHERE type IN ('CALLS', 'USAGE', 'IMPORTS')) SELECT id, 'caller' AS role, type, other::VARCHAR AS other FROM c SEMI JOIN w USING (id) WHERE r <= 20 UNION ALL SELECT id, 'callee', type, other::VARCHAR FROM d SEMI JOIN w USING (id) WHERE r <= 20 UNION ALL SELECT DISTINCT source_id, 'parent', 'INHERITS', target_id::VARCHAR FROM g_edges e JOIN w ON w.id = source_id WHERE type = 'REGISTRY_DISPATCH' UNION ALL SELECT id, 'finding', 'size', '' FROM w WHERE id % 3 = 0")
def _(nodes, edges):
    wanted = nodes.where(F.col("id").between(PART + 1, PART + 40))
    shown = edges.withColumn("type", F.when(F.col("type") == "REGISTRY_DISPATCH", "INHERITS").otherwise(F.col("type")))
    findings = nodes.where("id % 3 = 0").select(F.col("qualified_name").alias("target_qn"), F.lit("size").alias("category"))
    return T.explain_context(nodes, shown, wanted, findings)


_EVIDENCE = "ev AS (SELECT id AS edge_id, id * 2 AS id, CASE WHEN line % 3 = 0 THEN 0.98 WHEN line % 3 = 1 THEN 0.85 ELSE 0.6 END::DOUBLE AS strength FROM g_edges WHERE line % 7 <> 2)"


def _evidence(edges):
    strength = F.when(F.col("line") % 3 == 0, 0.98).when(F.col("line") % 3 == 1, 0.85).otherwise(0.6)
    return edges.where("line % 7 <> 2").select(F.col("id").alias("edge_id"), (F.col("id") * 2).alias("id"), strength.alias("strength"))


@R.graph("op76_node_evidence", f", {_EVIDENCE} SELECT 'inbound' AS direction, edge_id, ev.id, strength FROM ev JOIN g_edges e ON e.id = edge_id WHERE target_id = {PART + 12} ORDER BY strength DESC, ev.id LIMIT 30")
def _(nodes, edges):
    return T.node_evidence(edges, _evidence(edges), PART + 12, "inbound")


@R.graph("op160_edge_evidence", f", {_EVIDENCE}, p AS (SELECT {PART + 100}::BIGINT AS id, 0 AS hop, []::BIGINT[] AS via UNION ALL SELECT e.target_id, hop + 1, list_append(via, e.id) FROM p JOIN g_edges e ON e.source_id = p.id WHERE e.type = 'CALLS' AND hop < 3), best AS (SELECT via FROM p WHERE id = {PART + 6} AND hop > 0 ORDER BY hop, via LIMIT 1), steps AS (SELECT unnest(via) AS edge, generate_subscripts(via, 1) AS hop FROM best) SELECT hop::INT AS hop, edge, count(strength) AS evidence, max(strength) AS strength, CASE WHEN max(strength) >= 0.98 THEN 'exact_ast' WHEN max(strength) >= 0.85 THEN 'resolver' WHEN max(strength) IS NOT NULL THEN 'heuristic' END AS tier FROM steps LEFT JOIN ev ON edge_id = edge GROUP BY ALL")
def _(nodes, edges):
    return T.edge_evidence(edges, _evidence(edges), PART + 100, PART + 6)


@R.table("op166_freshness", "SELECT project, CASE WHEN n % 5 = 0 THEN 'empty' WHEN status = 'failed' THEN 'failed' WHEN source_commit IS NOT NULL AND id % 3 = 0 THEN 'moved' WHEN created_at IS NULL THEN 'unknown' WHEN epoch_us(TIMESTAMP '2026-06-30') - epoch_us(created_at) > 720 * 3600000000 THEN 'stale' ELSE 'fresh' END AS freshness, id FROM (SELECT *, id % 10 AS n FROM graph_snapshots)")
def _(read):
    c = F.col
    rows = read("graph_snapshots").select(F.struct("project", "id").alias("project"), "status", c("created_at").alias("indexed_at"), c("source_commit").alias("indexed_commit"), F.when(c("id") % 3 == 0, F.lit("other")).otherwise(c("source_commit")).alias("head"), (c("id") % 5).alias("nodes"))
    return T.freshness(rows, "2026-06-30 00:00:00", 720).select("project.project", "freshness", "project.id")


@R.table("op165_upsert_decisions", "SELECT project, snapshot_id, max(id) AS id FROM graph_snapshots WHERE project IS NOT NULL AND snapshot_id IS NOT NULL GROUP BY ALL")
def _(read):
    rows = read("graph_snapshots").where("project is not null and snapshot_id is not null").select("project", "snapshot_id", "id")
    first = rows.groupBy("project", "snapshot_id").agg(F.min("id").alias("id"))
    return T.upsert_records(first, rows.where("id % 2 = 0").unionByName(rows.where("id % 2 = 1")), ["project", "snapshot_id"], "id")


@R.table("op165_memory", "SELECT id, source_branch FROM graph_snapshots WHERE project = 'atlas-gateway' AND (contains(lower(source_branch), 'main') OR contains(lower(source_branch), 'feature') OR contains(lower(status), 'main') OR contains(lower(status), 'feature')) ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 20")
def _(read):
    c = F.col
    findings = read("graph_snapshots").select("id", c("project").alias("target_file"), F.lit("x").alias("category"), c("source_branch").alias("title"), c("status").alias("description"), "created_at")
    return T.findings_matching(findings, "main or feature", "atlas-gateway").select("id", c("title").alias("source_branch"))


@R.table("op171_value_layers", """WITH v AS (SELECT id, greatest(coalesce(tokens_saved, 0), 0)::DOUBLE AS observed, coalesce(unique_files, 0)::DOUBLE AS files, coalesce(result_count, 0)::DOUBLE AS results, (id % 900)::DOUBLE AS symbols, CASE WHEN id % 4 = 0 THEN coalesce(tokens_saved, 0) * 3 ELSE 0 END::DOUBLE AS potential, id % 3 AS calls, id % 5 = 0 AS other, confidence, id % 50 = 1 AS conflict FROM events_archive),
w AS (SELECT *, greatest(observed, potential) AS whole, round(least(1200, 90 * log2(greatest(files + 1, 2)) + least(CASE WHEN files > 0 THEN symbols / files ELSE 0 END * 8, 480))) AS search FROM v), x AS (SELECT *, CASE WHEN whole > observed THEN round(observed + (whole - observed) * 0.35) ELSE observed + search END AS likely FROM w)
SELECT id, observed, likely, CASE WHEN whole > observed THEN whole ELSE round(likely * 1.3) END AS maximum, CASE WHEN conflict THEN 'conflicting_evidence' WHEN observed = 0 AND results + calls = 0 THEN 'evidence_gap' WHEN calls > 0 AND NOT other AND confidence IN ('high', 'medium') THEN 'confirmed' ELSE 'partial' END AS status FROM x""")
def _(read):
    c = F.col
    rows = read("events_archive").select("id", c("tokens_saved").alias("tokens"), F.when(c("id") % 4 == 0, F.coalesce("tokens_saved", F.lit(0)) * 3).otherwise(0).alias("potential"), c("unique_files").alias("files"), (c("id") % 900).alias("symbols"), (c("id") % 3).alias("calls"), (c("id") % 5 == 0).cast("int").alias("other_relations"), c("result_count").alias("results"), "confidence", (c("id") % 50 == 1).alias("conflict"))
    return T.value_layers(rows)


@R.graph("op97_candidate_order", f"{_DEG} SELECT g.id, round(coalesce(n, 0) / 7.0::DOUBLE, 3) AS score, split_part(file_path, '/', 1) AS area FROM g_nodes g LEFT JOIN deg USING (id) ORDER BY score DESC, area, coalesce(n, 0) DESC, g.id LIMIT 200")
def _(nodes, edges):
    total = F.coalesce(F.col("in_degree") + F.col("out_degree"), F.lit(0).cast("long"))
    rows = nodes.join(degrees(edges), "id", "left").select("id", F.split_part("file_path", F.lit("/"), F.lit(1)).alias("area"), total.alias("fan_in"), (total / F.lit(7.0)).alias("score"))
    return rows.orderBy(*T.candidate_order()).limit(200).select("id", F.round("score", 3).alias("score"), "area")


_ENTITIES = ", sem AS (SELECT id, project, sha256('[' || to_json(project)::VARCHAR || ',' || to_json(kind)::VARCHAR || ',' || to_json(qualified_name)::VARCHAR || ',' || to_json(CASE WHEN kind IN ('Function', 'Class') THEN file_path || ':' || qualified_name ELSE file_path END)::VARCHAR || ']') AS semantic_id FROM g_nodes WHERE kind IN ('File', 'Function', 'Method', 'Class'))"


@R.graph("op168_entities", f"{_ENTITIES} SELECT id, semantic_id FROM sem")
def _(nodes, edges):
    return E.semantic_entities(nodes).select("id", "semantic_id")


@R.graph("op168_relations", f"{_ENTITIES}, r AS (SELECT e.project, s.semantic_id AS source, e.type, t.semantic_id AS target, count(*) AS occurrences FROM g_edges e JOIN sem s ON s.id = e.source_id JOIN sem t ON t.id = e.target_id WHERE e.type IN ('CALLS', 'IMPORTS', 'TESTS', 'CONFIGURES', 'EMITS', 'LISTENS_ON') GROUP BY ALL) SELECT sha256('[' || to_json(project)::VARCHAR || ',' || to_json(source)::VARCHAR || ',' || to_json(type)::VARCHAR || ',' || to_json(target)::VARCHAR || ']') AS relation_id, source, type, target, occurrences FROM r")
def _(nodes, edges):
    return E.semantic_relations(nodes, edges).drop("project")


@R.table("op162_snippets_with_names", "WITH n AS (SELECT doc_id AS id, 's' || (doc_id % 13) AS name, text, doc_id // 2 AS up FROM documents WHERE doc_id % 3 > 0), c AS (SELECT DISTINCT a.id, b.name FROM n a JOIN n b ON b.up = a.id), d AS (SELECT DISTINCT a.id, b.name FROM n a JOIN n b ON b.id = a.up) SELECT id, array_to_string(list_slice(string_split(text, chr(10)), 1, least(4, len(string_split(text, chr(10))))), chr(10)) AS snippet, coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM c WHERE c.id = n.id), '') AS callers, coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM d WHERE d.id = n.id), '') AS callees FROM n")
def _(read):
    c = F.col
    docs = read("documents").where("doc_id % 3 > 0")
    path = c("doc_id").cast("string")
    nodes = docs.select(c("doc_id").alias("id"), F.concat(F.lit("s"), (c("doc_id") % 13).cast("string")).alias("name"), path.alias("file_path"), F.lit(2).alias("start_line"), F.lit(3).alias("end_line"))
    edges = docs.select(c("doc_id").alias("source_id"), F.floor(c("doc_id") / 2).alias("target_id"), F.lit("CALLS").alias("type"))
    found = T.snippets(nodes, edges, docs.select(path.alias("file_path"), c("text").alias("content")), nodes, 1)
    return found.select("id", "snippet", F.array_join("callers", ",").alias("callers"), F.array_join("callees", ",").alias("callees"))


@R.graph("op160_edge_context", f"SELECT * FROM (SELECT id, type, 'direct' AS role FROM g_edges WHERE source_id = {PART + 40} AND target_id = {PART + 20}) UNION ALL SELECT * FROM (SELECT id, type, 'out' AS role FROM g_edges WHERE source_id = {PART + 40} AND target_id <> {PART + 20} ORDER BY id, type LIMIT 10) UNION ALL SELECT * FROM (SELECT id, type, 'in' AS role FROM g_edges WHERE target_id = {PART + 20} AND source_id <> {PART + 40} ORDER BY id, type LIMIT 10)")
def _(nodes, edges):
    return T.edge_context(edges, PART + 40, PART + 20)


def _term(w: str) -> str:
    score = f"CASE WHEN contains(lower(name), '{w}') THEN 8 ELSE 0 END + CASE WHEN contains(lower(qualified_name), '{w}') THEN 4 ELSE 0 END + CASE WHEN contains(lower(file_path), '{w}') THEN 3 ELSE 0 END"
    boost = "CASE WHEN kind IN ('Function', 'Method') THEN 10 WHEN kind = 'Route' THEN 8 WHEN kind IN ('Class', 'Interface') THEN 5 WHEN kind IN ('Type', 'Enum') THEN 3 ELSE 0 END"
    return f"SELECT * FROM (SELECT g.id, {score} + {boost} + CASE WHEN file_path LIKE 'asia/%' THEN 30 ELSE 0 END AS score FROM g_nodes g LEFT JOIN deg USING (id) WHERE {score} > 0 ORDER BY score DESC, coalesce(n, 0) DESC, name, g.id LIMIT 3)"


@R.graph("op164_pack_terms", f"{_DEG} SELECT id, max(score) AS score FROM ({' UNION ALL '.join(_term(w) for w in ('supplier', 'india', 'orders'))}) GROUP BY id")
def _(nodes, edges):
    return T.pack_terms(nodes, edges, "the supplier of india orders", area="asia")


@R.graph("op152_change_severity", ", own AS (SELECT id, file_path FROM g_nodes WHERE file_path LIKE 'parts/brand#3%'), c AS (SELECT own.file_path, count(DISTINCT e.source_id) AS callers FROM g_edges e JOIN own ON own.id = e.target_id JOIN g_nodes s ON s.id = e.source_id WHERE type = 'CALLS' AND s.file_path <> own.file_path GROUP BY 1), r AS (SELECT file_path, count(*) AS symbols, coalesce(max(callers), 0) AS callers FROM own LEFT JOIN c USING (file_path) GROUP BY file_path) SELECT *, CASE WHEN callers >= 20 THEN 'critical' WHEN callers >= 10 THEN 'high' WHEN callers >= 3 THEN 'medium' ELSE 'low' END AS severity FROM r")
def _(nodes, edges):
    return T.change_severity(nodes, edges, nodes.where(F.col("file_path").startswith("parts/brand#3")))


_CHANGED = f""", {_HOT}, own AS (SELECT id, qualified_name, file_path FROM g_nodes WHERE file_path LIKE 'parts/brand#3%' OR file_path LIKE 'asia/%'), x AS (SELECT own.id, count(DISTINCT CASE WHEN e.type = 'CALLS' THEN s.name END) AS callers, count(*) AS sure FROM g_edges e JOIN own ON own.id = e.target_id JOIN g_nodes s ON s.id = e.source_id WHERE e.type IN ('CALLS', 'IMPORTS') GROUP BY own.id),
y AS (SELECT own.id, coalesce(callers, 0) AS callers, qualified_name IN (SELECT qualified_name FROM hot) AS is_hot, sure FROM own LEFT JOIN x USING (id)), sym AS (SELECT id, callers, is_hot, CASE WHEN is_hot OR callers >= 20 THEN 'critical' WHEN callers >= 10 THEN 'high' WHEN callers >= 3 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN sure > 0 THEN 'confirmed' ELSE 'nominal' END AS tier FROM y)"""


def _changed(nodes, edges):
    changed = nodes.where(F.col("file_path").startswith("parts/brand#3") | F.col("file_path").startswith("asia/"))
    return T.changed_symbols(nodes, edges, changed, T.hotspots(nodes, edges))


@R.graph("op152_changed_symbols", f"{_CHANGED} SELECT * FROM sym")
def _(nodes, edges):
    return _changed(nodes, edges)


@R.graph("op152_change_risk", f"{_CHANGED} SELECT count(*) AS symbols, count(*) FILTER (tier = 'confirmed') AS confirmed, count(*) FILTER (tier = 'probable') AS probable, count(*) FILTER (tier = 'nominal') AS nominal, CASE WHEN bool_or(severity = 'critical') THEN 'critical' WHEN bool_or(is_hot OR severity = 'high') THEN 'high' ELSE 'low' END AS risk FROM sym")
def _(nodes, edges):
    return T.change_risk(_changed(nodes, edges))


@R.table("op152_change_buckets", "SELECT CASE p_partkey % 6 WHEN 0 THEN 'unstaged' WHEN 1 THEN 'renamed' WHEN 2 THEN 'untracked' WHEN 3 THEN 'deleted' ELSE 'tracked' END AS bucket, CASE WHEN p_partkey % 6 = 1 THEN 'new/' ELSE '' END || 'f' || p_partkey AS path FROM part UNION ALL SELECT 'unstaged', 'f' || p_partkey FROM part WHERE p_partkey % 6 = 5")
def _(read):
    key, name = F.col("p_partkey") % 6, F.concat(F.lit("f"), F.col("p_partkey").cast("string"))
    line = F.when(key == 0, F.concat(F.lit(" M "), name)).when(key == 1, F.concat(F.lit("R  "), name, F.lit(" -> new/"), name)).when(key == 2, F.concat(F.lit("?? "), name)).when(key == 3, F.concat(F.lit(" D "), name)).when(key == 4, F.concat(F.lit("A  "), name)).otherwise(F.concat(F.lit("MM "), name))
    return T.change_buckets(M.merged_status(M.status_lines(read("part").select(line.alias("value")))))


@R.table("op13_allowed_rows", "SELECT id, project FROM nodes WHERE project IN (SELECT project FROM graph_snapshots WHERE status = 'failed')")
def _(read):
    return T.allowed_rows(read("nodes").select("id", "project"), read("graph_snapshots").where("status = 'failed'"))


@R.table("op48_member_calls", "WITH a AS (SELECT 'alias_' || p_brand AS alias, min(p_brand) AS target FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) = 1), m AS (SELECT p_brand AS owner, p_name AS name, min(p_partkey) AS id FROM part GROUP BY ALL HAVING count(*) = 1), c AS (SELECT l_orderkey * 10 + l_linenumber AS call_id, p_brand AS owner, p_name AS name FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT call_id, id FROM c JOIN m USING (owner, name)")
def _(read):
    c = F.col
    part = read("part")
    calls = read("lineitem").join(part, c("l_partkey") == c("p_partkey")).select((c("l_orderkey") * 10 + c("l_linenumber")).alias("call_id"), F.when(c("l_linenumber") % 2 == 0, F.concat(F.lit("alias_"), "p_brand")).otherwise(c("p_brand")).alias("owner"), c("p_name").alias("name"), F.lit("ts").alias("lang"))
    members = part.select(c("p_partkey").alias("id"), c("p_brand").alias("owner"), c("p_name").alias("name"), F.lit("ts").alias("lang"))
    return T.member_calls(calls, members, part.select(F.concat(F.lit("alias_"), "p_brand").alias("alias"), c("p_brand").alias("target")))


@R.graph("op46_unique_same_file", ", c AS (SELECT e.id AS call_id, s.file_path AS file, s.qualified_name AS owner, t.name FROM g_edges e JOIN g_nodes s ON s.id = source_id JOIN g_nodes t ON t.id = target_id WHERE e.type = 'REGISTRY_DISPATCH'), one AS (SELECT file_path AS file, name, min(id) AS target_id FROM g_nodes WHERE kind IN ('Function', 'Method') GROUP BY ALL HAVING count(*) = 1) SELECT call_id, target_id FROM c JOIN one USING (file, name) WHERE call_id % 5 > 0")
def _(nodes, edges):
    ends = edges.where("type = 'REGISTRY_DISPATCH'").select(F.col("id").alias("call_id"), "source_id", "target_id").join(nodes.select(F.col("id").alias("source_id"), F.col("file_path").alias("file"), F.col("qualified_name").alias("owner")), "source_id").join(nodes.select(F.col("id").alias("target_id"), "name"), "target_id").drop("target_id")
    return T.unique_same_file(ends, nodes, ends.where("call_id % 5 = 0"))


@R.table("op47_implementations", "WITH d AS (SELECT id AS decl_id, name, snapshot_id AS lang FROM nodes WHERE kind = 'Function' AND name IS NOT NULL AND snapshot_id IS NOT NULL), s AS (SELECT * FROM d QUALIFY count(*) OVER (PARTITION BY name, lang) = 1), i AS (SELECT decl_id + 1000000000 AS id, name, lang FROM d WHERE decl_id % 4 > 0 UNION ALL SELECT decl_id + 2000000000, name, lang FROM d WHERE decl_id % 10 = 0), f AS (SELECT name, lang, min(id) AS id FROM i GROUP BY ALL HAVING count(*) = 1) SELECT decl_id, id FROM s JOIN f USING (name, lang) WHERE decl_id % 6 > 0")
def _(read):
    c = F.col
    declared = read("nodes").where("kind = 'Function' and name is not null and snapshot_id is not null").select(c("id").alias("decl_id"), "name", c("snapshot_id").alias("lang"))
    made = lambda test, by: declared.where(test).select((c("decl_id") + by).alias("id"), "name", "lang")
    return T.implementations(declared, made("decl_id % 4 > 0", 1_000_000_000).unionByName(made("decl_id % 10 = 0", 2_000_000_000)), declared.where("decl_id % 6 = 0"))


@R.graph("op44_suffix_either_way", ", a AS (SELECT DISTINCT 'repo/' || file_path AS a FROM g_nodes WHERE kind = 'Class' UNION SELECT DISTINCT regexp_replace(file_path, '^[^/]*/', '') FROM g_nodes WHERE kind = 'Class'), b AS (SELECT DISTINCT file_path AS b FROM g_nodes WHERE kind = 'Class') SELECT a, b FROM a, b WHERE a = b OR ends_with(a, '/' || b) OR ends_with(b, '/' || a)")
def _(nodes, edges):
    paths = nodes.where("kind = 'Class'").select("file_path").distinct()
    a = paths.select(F.concat(F.lit("repo/"), "file_path").alias("a")).unionByName(paths.select(F.regexp_replace("file_path", "^[^/]*/", "").alias("a")))
    return T.suffix_either_way(a, paths.select(F.col("file_path").alias("b")))


@R.graph("op170_digest", f"{_DEG} SELECT 'total' AS part, 'nodes' AS name, count(*) AS n FROM g_nodes UNION ALL SELECT 'total', 'edges', count(*) FROM g_edges UNION ALL SELECT * FROM (SELECT 'type', type, count(*) AS n FROM g_edges GROUP BY type ORDER BY n DESC, type LIMIT 16) UNION ALL SELECT * FROM (SELECT 'node', qualified_name, coalesce(n, 0) AS n FROM g_nodes LEFT JOIN deg USING (id) ORDER BY n DESC, qualified_name LIMIT 20) UNION ALL SELECT * FROM (SELECT 'file', file_path, count(*) AS n FROM g_nodes GROUP BY file_path ORDER BY n DESC, file_path LIMIT 18)")
def _(nodes, edges):
    return T.digest(nodes, edges)


@R.graph("op167_index_status", "SELECT project, count(*) AS nodes, count(DISTINCT file_path) AS files, (SELECT count(*) FROM g_edges) AS edges, 'ready' AS status FROM g_nodes GROUP BY project")
def _(nodes, edges):
    return T.index_status(nodes, edges)


@R.graph("op130_structure", ", f AS (SELECT DISTINCT file_path FROM g_nodes), p AS (SELECT DISTINCT array_to_string(list_slice(string_split(file_path, '/'), 1, i), '/') AS child, i = len(string_split(file_path, '/')) AS is_file FROM (SELECT file_path, unnest(range(1, len(string_split(file_path, '/')) + 1)) AS i FROM f)) SELECT regexp_replace(child, '/?[^/]*$', '') AS parent, child, CASE WHEN is_file THEN 'CONTAINS_FILE' ELSE 'CONTAINS_FOLDER' END AS type FROM p")
def _(nodes, edges):
    return R0.structure(nodes)[1]


@R.table("op49_module_identities", "WITH f AS (SELECT DISTINCT file_path AS path FROM nodes WHERE file_path IS NOT NULL), a AS (SELECT path, replace(regexp_replace(path, '[.][A-Za-z0-9]+$', ''), '/', '.') AS base, regexp_extract(path, '[.]([A-Za-z0-9]+)$', 1) AS ext FROM f), b AS (SELECT *, base || '~' || ext AS tagged, count(*) OVER (PARTITION BY base) AS n FROM a), c AS (SELECT *, count(*) OVER (PARTITION BY tagged) AS m FROM b) SELECT path, CASE WHEN n = 1 THEN base WHEN m = 1 THEN tagged ELSE tagged || '~' || substr(sha256(path), 1, 8) END AS identity FROM c")
def _(read):
    return R0.module_identities(read("nodes").where("file_path is not null").select(F.col("file_path").alias("path")))


@R.table("op45_nearest_declaration", "WITH h AS (SELECT u.id AS use_id, d.id AS decl_id, row_number() OVER (PARTITION BY u.id ORDER BY d.start_line DESC, d.id DESC) AS r FROM nodes u JOIN nodes d ON d.project = u.project AND d.file_path = u.file_path AND d.kind = u.kind AND d.start_line <= u.end_line AND u.end_line <= d.start_line + 300) SELECT use_id, decl_id FROM h WHERE r = 1")
def _(read):
    c = F.col
    named = [c("file_path").alias("file"), c("project").alias("owner"), c("kind").alias("name")]
    declared = read("nodes").select(c("id").alias("decl_id"), *named, "start_line", (c("start_line") + 300).alias("scope_end"))
    return R0.nearest_declaration(read("nodes").select(c("id").alias("use_id"), *named, c("end_line").alias("line")), declared)
