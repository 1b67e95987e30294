"""Queries of the pattern language and of guarded SQL."""

from __future__ import annotations

from loomgraph.operators.query_language import guarded_sql, run
from loomgraph.plans.lens import PROJECT
from loomgraph.plans.registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.graph("op24_conditions", "SELECT name, file_path, start_line FROM g_nodes WHERE kind = 'Function' AND name LIKE '%a%' AND start_line > 100 AND is_exported = 1 ORDER BY start_line DESC, name, file_path, start_line LIMIT 100")
def _(nodes, edges):
    return run("MATCH (f:Function) WHERE f.name CONTAINS 'a' AND f.start_line > 100 AND f.is_exported = true RETURN f.name, f.file_path, f.start_line ORDER BY f.start_line DESC", nodes, edges, PROJECT)


@R.graph("op25_json_properties", "SELECT qualified_name, properties->>'cyclomaticComplexity' AS cyclomaticComplexity FROM g_nodes WHERE (properties->>'cyclomaticComplexity')::DOUBLE >= 45 ORDER BY qualified_name, 2 LIMIT 200")
def _(nodes, edges):
    return run("MATCH (n) WHERE n.cyclomaticComplexity >= 45 RETURN n.qualified_name, n.cyclomaticComplexity ORDER BY n.qualified_name LIMIT 200", nodes, edges, PROJECT, 200)


@R.graph("op180_path_groups", "SELECT t.name AS callee, count(*) AS n, count(DISTINCT s.file_path) AS files FROM g_edges e JOIN g_nodes s ON s.id = source_id JOIN g_nodes t ON t.id = target_id WHERE e.type = 'CALLS' AND s.kind = 'Method' AND t.is_test <> 1 GROUP BY t.name ORDER BY n DESC, callee, n, files LIMIT 25 OFFSET 5")
def _(nodes, edges):
    return run("MATCH (a:Method)-[r:CALLS]->(b) WHERE b.is_test <> true RETURN b.name AS callee, count(*) AS n, count(DISTINCT a.file_path) AS files ORDER BY n DESC SKIP 5 LIMIT 25", nodes, edges, PROJECT)


@R.graph("op180_path_rows", "SELECT s.qualified_name AS a_qualified_name, e.type AS r_type, t.qualified_name AS b_qualified_name FROM g_edges e JOIN g_nodes s ON s.id = source_id JOIN g_nodes t ON t.id = target_id WHERE s.kind = 'Class' AND t.name <> 'MACHINERY' ORDER BY 1, 2, 3 LIMIT 300")
def _(nodes, edges):
    return run("MATCH (a:Class)-[r]->(b) WHERE b.name <> 'MACHINERY' RETURN a.qualified_name, r.type, b.qualified_name LIMIT 300", nodes, edges, PROJECT, 1000)


@R.graph("op181_guarded_sql", "SELECT kind, count(*) AS n FROM g_nodes n JOIN g_edges e ON e.target_id = n.id GROUP BY kind")
def _(nodes, edges):
    return guarded_sql("WITH hit AS (SELECT target_id FROM edges) SELECT kind, count(*) AS n FROM nodes n JOIN hit ON hit.target_id = n.id GROUP BY kind", nodes, edges, PROJECT)
