"""Queries of the aggregations over the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import graph_stats as G
from loomgraph.operators.search import degrees
from loomgraph.plans.registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

_NUM = "(properties->>'{}')::DOUBLE".format
_PROD = "file_path NOT LIKE 'tests/%' AND file_path NOT LIKE '%/tests/%'"
_ENDS = "g_edges e JOIN g_nodes s ON s.id = e.source_id JOIN g_nodes t ON t.id = e.target_id"


@R.graph("op50_kind_counts", "SELECT kind, count(*) AS n FROM g_nodes GROUP BY kind")
def _(nodes, edges):
    return G.counts(nodes, "kind")


@R.graph("op50_edge_type_counts", "SELECT type, count(*) AS n FROM g_edges GROUP BY type")
def _(nodes, edges):
    return G.counts(edges, "type")


@R.graph("op15_property_keys", "SELECT kind, key, count(*) AS n FROM (SELECT kind, unnest(json_keys(properties)) AS key FROM g_nodes) GROUP BY ALL")
def _(nodes, edges):
    return G.property_keys(nodes)


@R.graph("op15_patterns", f"SELECT s.kind AS source_kind, e.type, t.kind AS target_kind, count(*) AS n FROM {_ENDS} GROUP BY ALL ORDER BY n DESC, source_kind, type, target_kind LIMIT 30")
def _(nodes, edges):
    return G.patterns(edges, nodes)


@R.graph("op30_cross_file_edges", f"SELECT e.type, count(*) AS n, sum((s.file_path <> t.file_path)::INT)::BIGINT AS across FROM {_ENDS} GROUP BY e.type")
def _(nodes, edges):
    return G.endpoints(edges, nodes, ["file_path"]).groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("source_file_path") != F.col("target_file_path")).alias("across"))


@R.graph("op31_incident_counts", "SELECT id, sum((d = 'in' AND type = 'CALLS')::INT)::BIGINT AS in_calls, sum((d = 'out' AND type = 'CALLS')::INT)::BIGINT AS out_calls, sum((d = 'in' AND type = 'USAGE')::INT)::BIGINT AS in_usage, sum((d = 'out' AND type = 'USAGE')::INT)::BIGINT AS out_usage FROM (SELECT source_id AS id, 'out' AS d, type FROM g_edges UNION ALL SELECT target_id, 'in', type FROM g_edges) WHERE type IN ('CALLS', 'USAGE') GROUP BY id")
def _(nodes, edges):
    return G.incident_counts(edges, ["CALLS", "USAGE"])


_SIGNED = "CASE id % 4 WHEN 0 THEN 'f(x)' WHEN 1 THEN 'f(' || chr(10) || ')' WHEN 2 THEN '' END"


@R.graph("op32_unreferenced", f"""SELECT id, CASE WHEN id % 4 > 0 THEN 'low' WHEN is_exported = 0 AND kind <> 'Method' THEN 'high' ELSE 'medium' END AS confidence FROM (SELECT *, {_SIGNED} AS signature FROM g_nodes) n WHERE kind IN ('Function', 'Class', 'Method') AND is_test = 0 AND is_entry_point = 0 AND end_line - start_line >= 2 AND file_path NOT LIKE 'tests/%' AND (id % 4 = 0 OR length(name) > 2)
AND NOT EXISTS (SELECT 1 FROM g_edges e WHERE e.target_id = n.id AND e.type IN ('CALLS', 'USAGE', 'READS', 'TESTS', 'TESTS_FILE'))""", few_calls=True)
def _(nodes, edges):
    last = F.col("id") % 4
    signature = F.when(last == 0, "f(x)").when(last == 1, "f(\n)").when(last == 2, "")
    signed = nodes.withColumn("properties", F.to_json(F.struct(signature.alias("signature"))))
    return G.unreferenced(signed, edges, ("Function", "Class", "Method")).select("id", "confidence")


@R.graph("op33_without_callers", "SELECT id FROM g_nodes n WHERE kind = 'Function' AND NOT EXISTS (SELECT 1 FROM g_edges e WHERE e.target_id = n.id AND e.type = 'TESTS')")
def _(nodes, edges):
    return nodes.where("kind = 'Function'").join(edges.where("type = 'TESTS'").select(F.col("target_id").alias("id")), "id", "left_anti").select("id")


@R.graph("op34_with_usage", "SELECT id FROM g_nodes n WHERE EXISTS (SELECT 1 FROM g_edges e WHERE e.source_id = n.id AND e.type = 'USAGE')")
def _(nodes, edges):
    return nodes.join(edges.where("type = 'USAGE'").select(F.col("source_id").alias("id")), "id", "left_semi").select("id")


@R.graph("op39_files_with_nodes", "SELECT count(DISTINCT file_path) AS files FROM g_nodes WHERE file_path LIKE 'orders/%' OR file_path LIKE 'parts/%'")
def _(nodes, edges):
    return G.file_coverage(nodes, nodes.where("file_path like 'orders/%' or file_path like 'parts/%'").select("file_path"))


@R.graph("op40_edges_with_evidence", ", ev AS (SELECT id AS edge_id, round((id % 100) / 100.0, 2)::DOUBLE AS strength FROM g_edges WHERE type IN ('CALLS', 'IMPORTS') UNION ALL SELECT id, 0.5 FROM g_edges WHERE type = 'CALLS'), per AS (SELECT edge_id, count(*) AS evidence, max(strength) AS strength FROM ev GROUP BY 1) SELECT e.id, coalesce(evidence, 0) AS evidence, strength, CASE WHEN strength >= 0.98 THEN 'exact_ast' WHEN strength >= 0.85 THEN 'resolver' ELSE 'heuristic' END AS tier FROM g_edges e LEFT JOIN per ON e.id = edge_id")
def _(nodes, edges):
    some = edges.where("type in ('CALLS', 'IMPORTS')").select(F.col("id").alias("edge_id"), (F.col("id") % 100 / 100.0).alias("strength"))
    more = edges.where("type = 'CALLS'").select(F.col("id").alias("edge_id"), F.lit(0.5).alias("strength"))
    return G.evidence_by_edge(edges, some.unionByName(more)).select("id", "evidence", "strength", G.tier(F.col("strength")).alias("tier"))


@R.graph("op51_scoped_edge_counts", "SELECT e.type, count(*) AS n FROM g_edges e JOIN g_nodes s ON s.id = e.source_id WHERE s.file_path LIKE 'orders/1995/%' GROUP BY e.type")
def _(nodes, edges):
    inside = nodes.where(F.col("file_path").startswith("orders/1995/")).select(F.col("id").alias("source_id"))
    return G.counts(edges.join(inside, "source_id", "left_semi"), "type")


@R.graph("op52_degrees", "SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT source_id AS id, 0 AS i, 1 AS o FROM g_edges WHERE type IN ('CALLS', 'IMPORTS') UNION ALL SELECT target_id, 1, 0 FROM g_edges WHERE type IN ('CALLS', 'IMPORTS')) GROUP BY id")
def _(nodes, edges):
    return degrees(edges, ("CALLS", "IMPORTS"))


@R.graph("op53_type_pivot", "SELECT target_id AS id, sum((type = 'CALLS')::INT)::BIGINT AS calls, sum((type = 'TESTS')::INT)::BIGINT AS tests, sum((type = 'REGISTRY_DISPATCH')::INT)::BIGINT AS dispatches FROM g_edges WHERE type IN ('CALLS', 'TESTS', 'REGISTRY_DISPATCH') GROUP BY 1")
def _(nodes, edges):
    rows = edges.where("type in ('CALLS', 'TESTS', 'REGISTRY_DISPATCH')")
    return rows.groupBy(F.col("target_id").alias("id")).agg(*(F.count_if(F.col("type") == t).alias(a) for t, a in (("CALLS", "calls"), ("TESTS", "tests"), ("REGISTRY_DISPATCH", "dispatches"))))


@R.graph("op54_hotspots", f", fan AS (SELECT target_id AS id, count(*) AS fan_in, count(DISTINCT nullif(c.qualified_name, '')) AS distinct_callers FROM g_edges e LEFT JOIN g_nodes c ON c.id = e.source_id WHERE type = 'CALLS' GROUP BY 1) SELECT n.id, fan_in, distinct_callers, round(fan_in * 0.4 + distinct_callers * 0.6, 6)::DOUBLE AS score, coalesce(nullif({_NUM('cyclomaticComplexity')}, 0), {_NUM('complexity')}, 0) AS complexity FROM g_nodes n JOIN fan USING (id) WHERE kind IN ('Function', 'Method') AND is_test = 0 AND {_PROD} ORDER BY score DESC, qualified_name, id LIMIT 20")
def _(nodes, edges):
    return G.hotspots(nodes, edges).select("id", F.col("fan_in").cast("long").alias("fan_in"), "distinct_callers", "score", "complexity")


@R.graph("op55_large_components", f"SELECT id, {_NUM('lineCount')}::BIGINT AS line_count FROM g_nodes WHERE kind IN ('Class', 'Module') AND is_test = 0 AND {_PROD} AND {_NUM('lineCount')} >= 300 ORDER BY line_count DESC, qualified_name, id LIMIT 20")
def _(nodes, edges):
    return G.large_components(nodes).select("id", "line_count")


@R.graph("op56_project_stats", f"SELECT count(*) AS functions, round(avg({_NUM('cyclomaticComplexity')}), 2) AS avg_complexity, round(avg({_NUM('lineCount')}), 2) AS avg_lines, max({_NUM('cyclomaticComplexity')}) AS max_complexity FROM g_nodes WHERE kind IN ('Function', 'Method')")
def _(nodes, edges):
    return G.project_stats(nodes)


_DEG = ", deg AS (SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT source_id AS id, 0 AS i, 1 AS o FROM g_edges UNION ALL SELECT target_id, 1, 0 FROM g_edges) GROUP BY id)"


@R.graph("op57_degree_bands", f"{_DEG} SELECT sum((in_degree + out_degree >= 30)::INT)::BIGINT AS hotspots, sum((in_degree >= 10)::INT)::BIGINT AS risky, count(*) AS connected FROM deg")
def _(nodes, edges):
    return G.degree_bands(degrees(edges))


@R.graph("op58_extensions", "SELECT regexp_extract(file_path, '[.]([A-Za-z0-9]+)$', 1) AS extension, count(DISTINCT file_path) AS files FROM g_nodes GROUP BY 1")
def _(nodes, edges):
    return G.extensions(nodes)


@R.graph("op60_occurrences", "SELECT source_id, target_id, type, count(*) AS occurrences, min(line) AS first_line FROM g_edges GROUP BY ALL HAVING count(*) > 1")
def _(nodes, edges):
    return G.occurrences(edges).where("occurrences > 1")


@R.graph("op102_distinct_edges", "SELECT type, count(*) AS n FROM (SELECT DISTINCT project, source_id, target_id, type, line FROM (SELECT * FROM g_edges UNION ALL SELECT * FROM g_edges)) GROUP BY type")
def _(nodes, edges):
    return G.counts(G.distinct_edges(edges.unionByName(edges)), "type")


@R.graph("op61_coverage_rollup", ", f AS (SELECT file_path, count(*) AS total_calls, sum((e.type = 'REGISTRY_DISPATCH')::INT) AS unresolved_calls FROM g_edges e JOIN g_nodes s ON s.id = e.source_id WHERE e.type IN ('CALLS', 'REGISTRY_DISPATCH') GROUP BY 1) SELECT sum(total_calls)::BIGINT AS total, sum(unresolved_calls)::BIGINT AS unresolved, round((sum(total_calls) - sum(unresolved_calls)) / sum(total_calls)::DOUBLE, 4) AS rate FROM f")
def _(nodes, edges):
    calls = G.endpoints(edges.where("type in ('CALLS', 'REGISTRY_DISPATCH')"), nodes, ["file_path"])
    return G.coverage_rollup(calls.groupBy("source_file_path").agg(F.count("*").alias("total_calls"), F.count_if(F.col("type") == "REGISTRY_DISPATCH").alias("unresolved_calls")))


@R.graph("op61_merged_reasons", ", f AS (SELECT s.file_path, t.kind AS reason, count(*) AS k FROM g_edges e JOIN g_nodes s ON s.id = e.source_id JOIN g_nodes t ON t.id = e.target_id GROUP BY ALL) SELECT reason, sum(k)::BIGINT AS n FROM f GROUP BY reason")
def _(nodes, edges):
    per = G.endpoints(edges, nodes, ["file_path", "kind"]).groupBy("source_file_path", "target_kind").agg(F.count("*").alias("k"))
    maps = per.groupBy("source_file_path").agg(F.map_from_entries(F.collect_list(F.struct("target_kind", "k"))).alias("reasons"))
    return G.merged_reasons(maps)


@R.graph("op62_federated", ", l AS (SELECT qualified_name, file_path, id FROM g_nodes WHERE kind = 'Class' OR kind = 'Module'), s AS (SELECT qualified_name, file_path, -id AS id FROM g_nodes WHERE kind = 'Class' OR kind = 'Interface') SELECT coalesce(l.qualified_name, s.qualified_name) AS qualified_name, coalesce(l.id, s.id) AS id, CASE WHEN s.id IS NULL THEN 'local' WHEN l.id IS NULL THEN 'shared' ELSE 'mixed' END AS provenance, (l.id IS NOT NULL)::INT + (s.id IS NOT NULL)::INT AS providers FROM l FULL JOIN s ON l.qualified_name = s.qualified_name AND l.file_path = s.file_path")
def _(nodes, edges):
    local = nodes.where("kind in ('Class', 'Module')").select("qualified_name", "file_path", "id")
    shared = nodes.where("kind in ('Class', 'Interface')").select("qualified_name", "file_path", (-F.col("id")).alias("id"))
    return G.federated(local, shared, ["id"]).select("qualified_name", "id", "provenance", F.col("providers").cast("int").alias("providers"))


_REVIEW = f""", calls AS (SELECT target_id AS id, count(*) AS fan_in FROM g_edges WHERE type = 'CALLS' GROUP BY 1),
tested AS (SELECT DISTINCT file_path FROM g_nodes WHERE id IN (SELECT target_id FROM g_edges WHERE type IN ('TESTS', 'TESTS_FILE'))),
r AS (SELECT n.*, coalesce(fan_in, 0) AS fan_in, {_NUM('cyclomaticComplexity')} AS cc, n.file_path IN (SELECT file_path FROM tested) AS tested FROM g_nodes n LEFT JOIN calls USING (id) WHERE kind IN ('Function', 'Method', 'Class')),
issues AS (SELECT id, file_path, CASE WHEN cc > 100 THEN 'critical' WHEN cc > 50 THEN 'high' ELSE 'medium' END AS severity, 'complexity' AS category FROM r WHERE cc > 20
UNION ALL SELECT id, file_path, 'high', 'risk' FROM r WHERE fan_in >= 20
UNION ALL SELECT min(id), file_path, 'medium', 'test-coverage' FROM r WHERE is_test <> 1 AND NOT tested AND (cc > 10 OR fan_in > 5) GROUP BY file_path)"""


@R.graph("op156_review", f"{_REVIEW} SELECT * FROM issues")
def _(nodes, edges):
    return G.review_issues(nodes, edges)


@R.graph("op95_gravest", f"{_REVIEW} SELECT id, severity, category FROM issues ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, category, file_path, id LIMIT 25")
def _(nodes, edges):
    return G.by_severity(G.review_issues(nodes, edges), 25).select("id", "severity", "category")


@R.graph("op82_capped_neighbours", "SELECT source_id, target_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id, target_id, line) AS rank FROM g_edges WHERE type = 'CALLS') WHERE rank <= 2")
def _(nodes, edges):
    return G.capped_neighbours(edges.where("type = 'CALLS'"), 2).select("source_id", "target_id", "rank")


@R.graph("op83_rank_cutoffs", f"{_DEG}, ranked AS (SELECT in_degree + out_degree AS d, row_number() OVER (ORDER BY in_degree + out_degree DESC) - 1 AS i, count(*) OVER () AS n FROM deg) SELECT max(d) FILTER (i = floor(n * 0.15)) AS cut_15, max(d) FILTER (i = floor(n * 0.40)) AS cut_40 FROM ranked")
def _(nodes, edges):
    return G.rank_cutoffs(degrees(edges))


@R.graph("op121_file_tree", r""", files AS (SELECT DISTINCT file_path FROM g_nodes WHERE file_path <> ''), cut AS (SELECT array_to_string(list_slice(parts, 1, i), '/') AS path, i < len(parts) AS is_dir FROM (SELECT string_split(file_path, '/') AS parts, unnest(range(1, len(string_split(file_path, '/')) + 1)) AS i FROM files)), p AS (SELECT path, bool_or(is_dir) AS is_dir, regexp_replace(path, '/?[^/]*$', '') AS parent FROM cut GROUP BY path) SELECT path, parent, is_dir, (SELECT count(*) FROM p c WHERE c.parent = p.path) AS children FROM p""")
def _(nodes, edges):
    return G.file_tree(nodes)


@R.graph("op42_suffix_index", ", s AS (SELECT id, unnest(list_transform(range(1, len(string_split(qualified_name, '.')) + 1), lambda i: array_to_string(list_slice(string_split(qualified_name, '.'), i, len(string_split(qualified_name, '.'))), '.'))) AS suffix FROM g_nodes) SELECT suffix, count(*) AS n, min(id) AS first_id FROM s GROUP BY suffix")
def _(nodes, edges):
    return G.suffixes(nodes).groupBy("suffix").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@R.graph("op43_unique_suffix", """, paths AS (SELECT DISTINCT file_path AS path FROM g_nodes), wanted AS (SELECT DISTINCT 'lib/' || file_path AS wanted FROM g_nodes WHERE kind IN ('Class', 'Function') UNION SELECT 'x/' || regexp_replace(file_path, '^.*/', '') FROM g_nodes WHERE kind = 'Class'),
ps AS (SELECT path, array_to_string(list_slice(string_split(path, '/'), i, 99), '/') AS suffix FROM (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM paths)),
own AS (SELECT suffix, count(*) AS n, min(path) AS path FROM ps GROUP BY 1),
ws AS (SELECT wanted, len(string_split(wanted, '/')) - i + 1 AS depth, array_to_string(list_slice(string_split(wanted, '/'), i, 99), '/') AS suffix FROM (SELECT wanted, unnest(range(1, len(string_split(wanted, '/')) + 1)) AS i FROM wanted)),
best AS (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY depth DESC) AS r FROM ws JOIN own USING (suffix))
SELECT wanted, path, depth::INT AS depth FROM best WHERE r = 1 AND n = 1""")
def _(nodes, edges):
    wanted = nodes.where("kind in ('Class', 'Function')").select(F.concat(F.lit("lib/"), "file_path").alias("wanted")).unionByName(nodes.where("kind = 'Class'").select(F.concat(F.lit("x/"), F.regexp_replace("file_path", "^.*/", "")).alias("wanted")))
    return G.unique_longest_suffix(wanted, nodes.select(F.col("file_path").alias("path")))


@R.graph("op122_parents", "SELECT c.id, p.id AS parent_id FROM g_nodes c JOIN g_nodes p ON p.qualified_name = regexp_extract(c.qualified_name, '^(.*)\\.[^.]*$', 1)")
def _(nodes, edges):
    return G.parents(nodes)
