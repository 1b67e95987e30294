"""Queries of traversal, rules, invariants and impact."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import rules as U
from loomgraph.operators import traversal as V
from loomgraph.operators.graph_stats import rank_cutoffs
from loomgraph.operators.search import degrees
from loomgraph.plans.lens import CUSTOMER, ORDER, PART
from loomgraph.plans.registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def _reach(name: str, start: str, at: str, to: str, types: str, depth: int) -> str:
    kinds = ", ".join(f"'{t}'" for t in types.split())
    return f", {name}_all AS (SELECT {start}::BIGINT AS id, 0 AS hop UNION SELECT e.{to}, hop + 1 FROM {name}_all r JOIN g_edges e ON e.{at} = r.id WHERE e.type IN ({kinds}) AND hop < {depth}), {name} AS (SELECT id, min(hop) AS hop FROM {name}_all GROUP BY id)"


@R.graph("op110_bfs_outbound", _reach("b", str(ORDER + 7), "source_id", "target_id", "CALLS REGISTRY_DISPATCH", 4) + " SELECT id, hop FROM b", walks=True)
def _(nodes, edges, walk):
    return V.bfs(edges, nodes.where(F.col("id") == ORDER + 7), "outbound", ("CALLS", "REGISTRY_DISPATCH"), 4, walk=walk)


@R.graph("op110_bfs_both", f", w AS (SELECT source_id AS a, target_id AS b FROM g_edges WHERE type = 'IMPORTS' UNION SELECT target_id, source_id FROM g_edges WHERE type = 'IMPORTS'), b_all AS (SELECT {PART + 5}::BIGINT AS id, 0 AS hop UNION SELECT w.b, hop + 1 FROM b_all r JOIN w ON w.a = r.id WHERE hop < 2) SELECT id, min(hop) AS hop FROM b_all GROUP BY id", walks=True)
def _(nodes, edges, walk):
    return V.bfs(edges, nodes.where(F.col("id") == PART + 5), "both", ("IMPORTS",), 2, walk=walk)


@R.graph("op110_bfs_inbound", _reach("b", str(PART + 1), "target_id", "source_id", "CALLS", 3) + " SELECT id, hop FROM b", walks=True)
def _(nodes, edges, walk):
    return V.bfs(edges, nodes.where(F.col("id") == PART + 1), "inbound", ("CALLS",), 3, walk=walk)


@R.graph("op110_bfs_budget", _reach("b", str(PART + 1), "target_id", "source_id", "CALLS", 2) + " SELECT id, hop FROM b WHERE hop = 0 UNION ALL (SELECT id, hop FROM b WHERE hop > 0 ORDER BY hop, id LIMIT 200)", walks=True)
def _(nodes, edges, walk):
    return V.bfs(edges, nodes.where(F.col("id") == PART + 1), "inbound", ("CALLS",), 2, 200, walk)


_WALKED = _reach("b", str(PART + 11), "target_id", "source_id", "CALLS USAGE", 2) + ", k AS (SELECT source_id, target_id, type, count(*) AS occurrences, min(hop) AS hop FROM b JOIN g_edges e ON e.target_id = b.id WHERE hop < 2 AND type IN ('CALLS', 'USAGE') GROUP BY ALL), passed AS (SELECT k.source_id, k.target_id, k.type, s.name AS from_name, t.name AS to_name, occurrences, hop FROM k JOIN g_nodes s ON s.id = source_id JOIN g_nodes t ON t.id = target_id)"


def _passed(nodes, edges, walk):
    reached = V.bfs(edges, nodes.where(F.col("id") == PART + 11), "inbound", ("CALLS", "USAGE"), 2, walk=walk)
    return reached, V.walked(edges, nodes, reached, "inbound", ("CALLS", "USAGE"), 2, walk)


@R.graph("op110_walked_edges", f"{_WALKED} SELECT * FROM passed", walks=True)
def _(nodes, edges, walk):
    return _passed(nodes, edges, walk)[1]


@R.graph("op112_relations", f"{_WALKED} SELECT from_name, to_name, type, sum(occurrences)::BIGINT AS occurrences FROM passed GROUP BY ALL", walks=True)
def _(nodes, edges, walk):
    return V.relations(_passed(nodes, edges, walk)[1])


@R.graph("op112_trace_entries", f"{_WALKED}, ends AS (SELECT name, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM (SELECT from_name AS name, type FROM passed UNION SELECT to_name, type FROM passed) GROUP BY name) SELECT b.id, n.name, hop, coalesce(types, '') AS types, CASE WHEN contains(coalesce(types, ''), 'CALLS') THEN 'direct_call' ELSE 'reference' END AS kind FROM b JOIN g_nodes n USING (id) LEFT JOIN ends USING (name) WHERE hop > 0", walks=True)
def _(nodes, edges, walk):
    reached, passed = _passed(nodes, edges, walk)
    found = V.trace_entries(reached.where("hop > 0").withColumn("direction", F.lit("inbound")), nodes, passed)
    return found.select("id", "name", "hop", F.array_join("types", ",").alias("types"), "kind")


_KEEP = r"is_test = 0 AND NOT regexp_matches(file_path, '(^|/)(tests?|__tests__)/|[.](test|spec)[.]')"
_RISK = "CASE hop WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' ELSE 'LOW' END"


@R.graph("op111_trace", f", s AS (SELECT id FROM g_nodes WHERE id = {PART + 12})" + _reach("i", f"(SELECT id FROM s)", "target_id", "source_id", "CALLS HTTP_CALLS ASYNC_CALLS", 3) + _reach("o", "(SELECT id FROM s)", "source_id", "target_id", "CALLS HTTP_CALLS ASYNC_CALLS", 3) + f" SELECT n.id, 'inbound' AS direction, hop, {_RISK} AS risk FROM i JOIN g_nodes n USING (id) WHERE hop > 0 AND {_KEEP} UNION ALL SELECT n.id, 'outbound', hop, {_RISK} FROM o JOIN g_nodes n USING (id) WHERE hop > 0 AND {_KEEP}", walks=True)
def _(nodes, edges, walk):
    name = nodes.where(F.col("id") == PART + 12).select("qualified_name").first()[0]
    return V.trace(nodes, edges, name, walk=walk).select("id", "direction", "hop", "risk")


@R.graph("op119_impacted_symbols", _reach("b", str(PART + 3), "target_id", "source_id", "CALLS", 2) + " SELECT id, hop FROM b WHERE hop > 0 ORDER BY hop, id LIMIT 20", walks=True)
def _(nodes, edges, walk):
    found = V.bfs(edges, nodes.where(F.col("id") == PART + 3), "inbound", ("CALLS",), 2, walk=walk)
    return found.where("hop > 0").orderBy("hop", "id").limit(20)


@R.graph("op113_shortest_path", f""", p AS (SELECT {PART + 100}::BIGINT AS id, 0 AS hop, []::BIGINT[] AS via UNION ALL SELECT e.target_id, hop + 1, list_append(via, e.id) FROM p JOIN g_edges e ON e.source_id = p.id WHERE e.type = 'CALLS' AND hop < 3),
best AS (SELECT via FROM p WHERE id = {PART + 12} AND hop > 0 ORDER BY hop, via LIMIT 1), steps AS (SELECT unnest(via) AS edge, generate_subscripts(via, 1) AS hop FROM best)
SELECT hop::INT AS hop, edge, source_id, target_id FROM steps JOIN g_edges e ON e.id = edge""", walks=True)
def _(nodes, edges, walk):
    return V.shortest_path(edges, PART + 100, PART + 12, walk=walk)


@R.graph("op113_path_evidence", f""", p AS (SELECT {PART + 100}::BIGINT AS id, 0 AS hop, []::BIGINT[] AS via UNION ALL SELECT e.target_id, hop + 1, list_append(via, e.id) FROM p JOIN g_edges e ON e.source_id = p.id WHERE e.type = 'CALLS' AND hop < 3),
best AS (SELECT via FROM p WHERE id = {PART + 12} AND hop > 0 ORDER BY hop, via LIMIT 1), steps AS (SELECT unnest(via) AS edge, generate_subscripts(via, 1) AS hop FROM best),
per AS (SELECT id AS edge_id, CASE WHEN line % 3 = 0 THEN 0.98 WHEN line % 3 = 1 THEN 0.85 ELSE 0.6 END::DOUBLE AS strength FROM g_edges WHERE line % 7 <> 2)
SELECT hop::INT AS hop, edge, count(strength) AS evidence, max(strength) AS strength, CASE WHEN max(strength) >= 0.98 THEN 'exact_ast' WHEN max(strength) >= 0.85 THEN 'resolver' WHEN max(strength) IS NOT NULL THEN 'heuristic' END AS tier FROM steps LEFT JOIN per ON edge_id = edge GROUP BY ALL""")
def _(nodes, edges):
    strength = F.when(F.col("line") % 3 == 0, 0.98).when(F.col("line") % 3 == 1, 0.85).otherwise(0.6)
    evidence = edges.where("line % 7 <> 2").select(F.col("id").alias("edge_id"), strength.alias("strength"))
    return V.path_evidence(V.shortest_path(edges, PART + 100, PART + 12), evidence).select("hop", "edge", "evidence", "strength", "tier")


@R.graph("op114_neighbour_names", ", c AS (SELECT e.source_id, e.target_id, s.name AS sn, t.name AS tn FROM g_edges e JOIN g_nodes s ON s.id = e.source_id JOIN g_nodes t ON t.id = e.target_id WHERE type = 'CALLS'), i AS (SELECT target_id AS id, count(DISTINCT sn) AS callers FROM c GROUP BY 1), o AS (SELECT source_id AS id, count(DISTINCT tn) AS callees FROM c GROUP BY 1) SELECT id, coalesce(callers, 0) AS callers, coalesce(callees, 0) AS callees FROM i FULL JOIN o USING (id)")
def _(nodes, edges):
    return V.neighbour_names(nodes, edges)


_PARTS = ", own AS (SELECT id, id % 4 AS depth FROM g_nodes WHERE kind IN ('Function', 'Method')), calls AS (SELECT DISTINCT source_id, target_id FROM g_edges WHERE type = 'CALLS' AND source_id <> target_id)"


@R.graph("op116_transitive_depth", f"{_PARTS}, walk AS (SELECT id AS root, id AS pos, 0 AS hop FROM own UNION SELECT root, target_id, hop + 1 FROM walk JOIN calls ON source_id = pos WHERE hop < 10) SELECT root AS id, max(depth + hop)::BIGINT AS depth FROM walk JOIN own ON own.id = pos GROUP BY root")
def _(nodes, edges):
    own = nodes.where("kind in ('Function', 'Method')").select("id", (F.col("id") % 4).alias("depth"))
    return V.transitive_depth(own, edges)


@R.graph("op115_communities")
def _(nodes, edges):
    return V.communities(V.label_propagation(nodes, edges), nodes, edges)


@R.graph("op115_sequential_communities")
def _(nodes, edges):
    return V.communities(V.sequential_labels(nodes, edges), nodes, edges)


@R.graph("op120_deepest_chain", f", p AS (SELECT [{PART + 900}::BIGINT] AS chain UNION ALL SELECT list_append(chain, target_id) FROM p JOIN (SELECT DISTINCT source_id, target_id FROM g_edges WHERE type = 'CALLS') e ON e.source_id = list_last(chain) WHERE NOT list_contains(chain, target_id) AND len(chain) <= 10) SELECT array_to_string(chain, '>') AS chain FROM p ORDER BY len(p.chain) DESC, p.chain LIMIT 1")
def _(nodes, edges):
    found = V.deepest_chain(edges, PART + 900)
    return found.select(F.array_join(F.transform("chain", lambda c: c.cast("string")), ">").alias("chain"))


LAYERS = {"even": "parts/brand#?2/**", "parts": "parts/**", "america": "america/**/supplier_*.ts", "elsewhere": "*/*/supplier_*"}
_LAYER = "CASE WHEN regexp_matches({0}, '^parts/brand#[^/]2/.*$') THEN 'even' WHEN regexp_matches({0}, '^parts/.*$') THEN 'parts' WHEN regexp_matches({0}, '^america/.*supplier_[^/]*\\.ts$') THEN 'america' WHEN regexp_matches({0}, '^[^/]*/[^/]*/supplier_[^/]*$') THEN 'elsewhere' END".format


@R.graph("op27_layers", f"SELECT {_LAYER('file_path')} AS layer, count(*) AS n FROM g_nodes GROUP BY 1")
def _(nodes, edges):
    return nodes.groupBy(U.layer_of(F.col("file_path"), LAYERS).alias("layer")).agg(F.count("*").alias("n"))


@R.graph("op154_violations", f", r AS (SELECT e.id, source_id, target_id, {_LAYER('s.file_path')} AS source_layer, {_LAYER('t.file_path')} AS target_layer FROM g_edges e JOIN g_nodes s ON s.id = source_id JOIN g_nodes t ON t.id = target_id WHERE type = 'IMPORTS' AND t.kind IN ('Function', 'Method', 'Class', 'Interface')) SELECT * FROM r WHERE (source_layer = 'even' AND target_layer = 'america') OR (source_layer = 'parts' AND target_layer = 'elsewhere')")
def _(nodes, edges):
    return U.violations(nodes, edges, LAYERS, [("even", "america"), ("parts", "elsewhere")])


_CALLS = """, c AS (SELECT DISTINCT source_id, target_id FROM g_edges WHERE type = 'USAGE' AND target_id IN (SELECT id FROM g_nodes WHERE kind = 'Class' AND is_test = 0)),
solo AS (SELECT target_id, count(*) AS callers FROM c GROUP BY 1 HAVING count(*) >= 3), pairs AS (SELECT x.target_id AS a, y.target_id AS b, count(*) AS joint FROM c x JOIN c y ON x.source_id = y.source_id AND x.target_id < y.target_id GROUP BY ALL HAVING count(*) >= 3),
w AS (SELECT a AS from_id, b AS to_id, joint FROM pairs UNION ALL SELECT b, a, joint FROM pairs),
inv AS (SELECT from_id, to_id, solo.callers, joint, round(joint / solo.callers::DOUBLE, 3) AS confidence FROM w JOIN solo ON solo.target_id = from_id JOIN solo s2 ON s2.target_id = to_id WHERE round(joint / solo.callers::DOUBLE, 3) >= 0.03)"""


@R.graph("op59_invariants", f"{_CALLS} SELECT * FROM inv")
def _(nodes, edges):
    return U.invariants(nodes, edges, type="USAGE", kinds=("Class",), min_confidence=0.03)


@R.graph("op155_broken_invariants", f"{_CALLS}, scope AS (SELECT id FROM g_nodes WHERE file_path LIKE 'orders/%'), m AS (SELECT from_id, to_id, c.source_id AS id, row_number() OVER (PARTITION BY from_id, to_id ORDER BY c.source_id) AS r FROM inv JOIN c ON c.target_id = from_id JOIN scope ON scope.id = c.source_id WHERE confidence >= 0.05 AND NOT EXISTS (SELECT 1 FROM c d WHERE d.source_id = c.source_id AND d.target_id = to_id)) SELECT from_id, to_id, id FROM m WHERE r <= 10")
def _(nodes, edges):
    found = U.invariants(nodes, edges, type="USAGE", kinds=("Class",), min_confidence=0.05)
    return U.broken_invariants(found, edges, nodes.where(F.col("file_path").startswith("orders/")), type="USAGE")


@R.graph("op36_event_bridges", ", e AS (SELECT target_id AS channel, type, file_path, file_path LIKE 'asia/%' AS inside FROM g_edges JOIN g_nodes n ON n.id = source_id WHERE type IN ('EMITS', 'LISTENS_ON')) SELECT DISTINCT o.file_path FROM e o JOIN e i ON o.channel = i.channel AND o.type <> i.type WHERE i.inside AND NOT o.inside")
def _(nodes, edges):
    return U.event_bridges(nodes, edges, F.col("file_path").startswith("asia/"))


@R.graph("op41_boundary_edges", ", r AS (SELECT type, source_id, target_id, s.file_path LIKE 'parts/brand#1%' AS a, t.file_path LIKE 'parts/brand#1%' AS b FROM g_edges e JOIN g_nodes s ON s.id = source_id JOIN g_nodes t ON t.id = target_id WHERE type IN ('CALLS', 'IMPORTS', 'USAGE')) SELECT DISTINCT CASE WHEN a THEN 'outgoing' ELSE 'incoming' END AS direction, type, source_id, target_id FROM r WHERE a <> b")
def _(nodes, edges):
    return U.boundary_edges(nodes, edges, F.col("file_path").startswith("parts/brand#1"))


@R.graph("op117_downstream_files", "SELECT DISTINCT t.file_path FROM g_edges e JOIN g_nodes s ON s.id = source_id JOIN g_nodes t ON t.id = target_id WHERE type IN ('CALLS', 'IMPORTS', 'USAGE') AND s.file_path LIKE 'orders/1995/%' AND t.file_path NOT LIKE 'orders/1995/%'")
def _(nodes, edges):
    return U.downstream_files(nodes, edges, F.col("file_path").startswith("orders/1995/"))


@R.graph("op118_dependent_files", "SELECT DISTINCT s.file_path FROM g_edges e JOIN g_nodes s ON s.id = source_id JOIN g_nodes t ON t.id = target_id WHERE t.file_path = 'parts/brand#11/m1.ts' AND s.file_path <> t.file_path ORDER BY 1 LIMIT 200")
def _(nodes, edges):
    return U.dependent_files(nodes, edges, "parts/brand#11/m1.ts")


_IMPACT = """, changed AS (SELECT DISTINCT file_path FROM g_nodes WHERE file_path LIKE 'parts/brand#2%' UNION SELECT 'new/file.ts'), deleted AS (SELECT DISTINCT file_path FROM g_nodes WHERE file_path LIKE 'asia/%supplier_1.ts'),
own AS (SELECT * FROM g_nodes WHERE file_path IN (SELECT file_path FROM changed)), gone AS (SELECT * FROM g_nodes WHERE file_path IN (SELECT file_path FROM deleted)),
covering AS (SELECT own.file_path, s.qualified_name AS symbol FROM g_edges e JOIN own ON own.id = target_id JOIN g_nodes s ON s.id = source_id WHERE type IN ('TESTS', 'TESTS_FILE')),
found AS (SELECT DISTINCT 'covered_by' AS category, file_path, symbol FROM covering
UNION ALL SELECT DISTINCT 'untested', file_path, '' FROM own WHERE is_test = 0 AND file_path NOT IN (SELECT file_path FROM covering)
UNION ALL SELECT 'no_callers', file_path, qualified_name FROM own WHERE id NOT IN (SELECT target_id FROM g_edges WHERE type IN ('CALLS', 'USAGE'))
UNION ALL SELECT 'deleted_in_use', file_path, qualified_name FROM gone WHERE id IN (SELECT target_id FROM g_edges WHERE type IN ('CALLS', 'USAGE', 'IMPORTS') AND source_id NOT IN (SELECT id FROM gone))
UNION ALL SELECT 'not_indexed', file_path, '' FROM changed WHERE file_path NOT IN (SELECT file_path FROM g_nodes)
UNION ALL SELECT DISTINCT 'downstream', t.file_path, '' FROM g_edges e JOIN own ON own.id = source_id JOIN g_nodes t ON t.id = target_id WHERE type IN ('CALLS', 'IMPORTS', 'USAGE') AND t.file_path NOT IN (SELECT file_path FROM changed))"""


def _findings(nodes, edges):
    changed = nodes.where(F.col("file_path").startswith("parts/brand#2")).select("file_path").unionByName(nodes.limit(1).select(F.lit("new/file.ts").alias("file_path")))
    return U.impact_findings(nodes, edges, changed, nodes.where(F.col("file_path").like("asia/%supplier_1.ts")).select("file_path"))


@R.graph("op153_impact_findings", f"{_IMPACT} SELECT * FROM found")
def _(nodes, edges):
    return _findings(nodes, edges)


_ASSESSED = f"""{_IMPACT}{_CALLS}, emit AS (SELECT target_id AS channel, type, file_path, file_path IN (SELECT file_path FROM changed) AS inside FROM g_edges JOIN g_nodes n ON n.id = source_id WHERE type IN ('EMITS', 'LISTENS_ON')),
broken AS (SELECT from_id, to_id, c.source_id AS id, row_number() OVER (PARTITION BY from_id, to_id ORDER BY c.source_id) AS r FROM inv JOIN c ON c.target_id = from_id WHERE c.source_id IN (SELECT id FROM own) AND NOT EXISTS (SELECT 1 FROM c d WHERE d.source_id = c.source_id AND d.target_id = to_id)),
sided AS (SELECT s.file_path, s.qualified_name, {_LAYER('s.file_path')} AS a, {_LAYER('t.file_path')} AS b FROM g_edges e JOIN own s ON s.id = source_id JOIN g_nodes t ON t.id = target_id WHERE type = 'IMPORTS' AND t.kind IN ('Function', 'Method', 'Class', 'Interface')),
assessed AS (SELECT * FROM found UNION ALL SELECT DISTINCT 'async_dependent', o.file_path, '' FROM emit o JOIN emit i ON o.channel = i.channel AND o.type <> i.type WHERE i.inside AND NOT o.inside
UNION ALL SELECT DISTINCT ON (n.id) 'broken_invariant', file_path, qualified_name FROM broken JOIN g_nodes n USING (id) WHERE r <= 10
UNION ALL SELECT DISTINCT 'broken_rule', file_path, qualified_name FROM sided WHERE (a = 'even' AND b = 'america') OR (a = 'parts' AND b = 'elsewhere')),
sure AS (SELECT *, CASE WHEN category IN ('deleted_in_use', 'covered_by', 'broken_rule') THEN 'high' WHEN category IN ('no_callers', 'not_indexed') THEN 'low' ELSE 'medium' END AS confidence FROM assessed)"""


def _assessed(nodes, edges):
    changed = nodes.where(F.col("file_path").startswith("parts/brand#2") | F.col("file_path").like("europe/%supplier_2.ts")).select("file_path").unionByName(nodes.limit(1).select(F.lit("new/file.ts").alias("file_path")))
    deleted = nodes.where(F.col("file_path").like("asia/%supplier_1.ts")).select("file_path")
    return U.assessment(nodes, edges, changed, deleted, LAYERS, [("even", "america"), ("parts", "elsewhere")], type="USAGE", kinds=("Class",), min_confidence=0.03)


_ASSESSED = _ASSESSED.replace("WHERE file_path LIKE 'parts/brand#2%' UNION", "WHERE file_path LIKE 'parts/brand#2%' OR file_path LIKE 'europe/%supplier_2.ts' UNION")


@R.graph("op153_assessment", f"{_ASSESSED} SELECT * FROM sure")
def _(nodes, edges):
    return _assessed(nodes, edges)


@R.graph("op93_finding_order", f"{_ASSESSED} SELECT * FROM sure ORDER BY CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, category, file_path, symbol LIMIT 100 OFFSET 300")
def _(nodes, edges):
    return _assessed(nodes, edges).orderBy(*U.finding_order()).offset(300).limit(100)


@R.graph("op100_test_counts", ", f AS (SELECT DISTINCT file_path FROM g_nodes WHERE file_path LIKE 'parts/%' OR file_path LIKE 'asia/%'), own AS (SELECT * FROM g_nodes WHERE file_path IN (SELECT file_path FROM f)), r AS (SELECT t.file_path, 'file' AS level, count(*) AS n FROM g_edges e JOIN own t ON t.id = target_id JOIN g_nodes s ON s.id = source_id WHERE type = 'USAGE' AND t.kind = 'Class' AND s.is_test = 1 GROUP BY 1 UNION ALL SELECT t.file_path, 'symbol', count(*) FROM g_edges e JOIN own t ON t.id = target_id JOIN g_nodes s ON s.id = source_id WHERE type = 'TESTS' AND t.kind IN ('Function', 'Method') AND s.is_test = 1 GROUP BY 1) SELECT file_path, level, coalesce(n, 0) AS tests FROM (SELECT file_path, unnest(['file', 'symbol']) AS level FROM f) LEFT JOIN r USING (file_path, level)")
def _(nodes, edges):
    files = nodes.where(F.col("file_path").startswith("parts/") | F.col("file_path").startswith("asia/"))
    return U.test_counts(nodes, edges, files, file_types=("USAGE",), file_kinds=("Class",))


@R.graph("op81_fair_selection", f"""{_IMPACT}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY file_path, symbol) AS rank FROM found), n AS (SELECT greatest(5, floor(40 / count(DISTINCT category))) AS base FROM found)
SELECT category, file_path, symbol FROM r, n ORDER BY greatest(rank - base, 0), CASE WHEN rank > base THEN category END NULLS FIRST, file_path, symbol LIMIT 40""")
def _(nodes, edges):
    return U.fair_selection(_findings(nodes, edges), "category", [F.col("file_path").asc(), F.col("symbol").asc()], 40)


_DEG = ", deg AS (SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT source_id AS id, 0 AS i, 1 AS o FROM g_edges UNION ALL SELECT target_id, 1, 0 FROM g_edges) GROUP BY id), ranked AS (SELECT in_degree + out_degree AS d, row_number() OVER (ORDER BY in_degree + out_degree DESC) - 1 AS i, count(*) OVER () AS n FROM deg), cuts AS (SELECT max(d) FILTER (i = floor(n * 0.15)) AS cut_15, max(d) FILTER (i = floor(n * 0.40)) AS cut_40 FROM ranked)"
_ROLES = f"""{_DEG}, rows AS (SELECT n.id, coalesce(in_degree + out_degree, 0) AS degree, is_entry_point, kind, cut_15, cut_40 FROM g_nodes n LEFT JOIN deg USING (id), cuts),
placed AS (SELECT *, CASE WHEN is_entry_point = 1 OR kind = 'Route' THEN 'entry' WHEN degree >= greatest(cut_15, 2) THEN 'hotspot' WHEN degree >= greatest(cut_40, 1) THEN 'risk' ELSE 'value' END AS role FROM rows),
r AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY degree DESC, id) AS k FROM placed),
chosen AS (SELECT id, role, degree FROM r ORDER BY CASE WHEN role = 'entry' AND k <= 170 THEN 0 WHEN role = 'hotspot' AND k <= 45 THEN 1 WHEN role = 'risk' AND k <= 30 THEN 2 ELSE 3 END, degree DESC, id LIMIT 260)"""
_QUOTAS = [("entry", 170), ("hotspot", 45), ("risk", 30)]


@R.graph("op84_role_quotas", f"{_ROLES} SELECT * FROM chosen")
def _(nodes, edges):
    degree = degrees(edges)
    return U.role_quotas(degree, nodes, rank_cutoffs(degree), _QUOTAS, 260)


@R.graph("op104_induced_subgraph", f"{_ROLES} SELECT e.id, source_id, target_id, type FROM g_edges e WHERE source_id IN (SELECT id FROM chosen) AND target_id IN (SELECT id FROM chosen)")
def _(nodes, edges):
    degree = degrees(edges)
    return U.induced(edges, U.role_quotas(degree, nodes, rank_cutoffs(degree), _QUOTAS, 260)).select("id", "source_id", "target_id", "type")
