"""Queries of the search operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import search as S
from loomgraph.plans.registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

_DEGREES = ", deg AS (SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT source_id AS id, 0 AS i, 1 AS o FROM g_edges UNION ALL SELECT target_id, 1, 0 FROM g_edges) GROUP BY id), full_nodes AS (SELECT n.*, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree FROM g_nodes n LEFT JOIN deg USING (id))"
_BOOST = "CASE WHEN kind IN ('Function', 'Method') THEN 10 WHEN kind = 'Route' THEN 8 WHEN kind IN ('Class', 'Interface') THEN 5 WHEN kind IN ('Type', 'Enum') THEN 3 WHEN kind = 'Variable' THEN 1 ELSE 0 END"


@R.graph("op20_structured_search", f"{_DEGREES} SELECT id, name, in_degree, out_degree FROM full_nodes WHERE kind = 'Function' AND name ILIKE '%a%' AND file_path ILIKE '%parts/%m_.ts%' AND in_degree + out_degree >= 3 AND is_entry_point = 0 ORDER BY {_BOOST} DESC, name, id LIMIT 50 OFFSET 5")
def _(nodes, edges):
    found = S.structured_search(nodes, edges, kind="Function", name_regex=".*a.*", path_glob="parts/*m?.ts", min_degree=3, exclude_entry_points=True)
    return S.page(found, S.ORDERS["relevance"](), 50, 5).select("id", "name", "in_degree", "out_degree")


@R.graph("op20_search_by_relationship", f"{_DEGREES} SELECT id, kind, in_degree + out_degree AS degree FROM full_nodes WHERE kind NOT IN ('Folder', 'Module') AND (lower(name) LIKE '%supplier%' OR lower(qualified_name) LIKE '%supplier%' OR lower(name) LIKE '%machinery%' OR lower(qualified_name) LIKE '%machinery%') AND id IN (SELECT source_id FROM g_edges WHERE type = 'LISTENS_ON' UNION ALL SELECT target_id FROM g_edges WHERE type = 'LISTENS_ON')")
def _(nodes, edges):
    found = S.structured_search(nodes, edges, any_token=["supplier", "machinery"], relationship="LISTENS_ON")
    return found.select("id", "kind", (F.col("in_degree") + F.col("out_degree")).alias("degree"))


@R.graph("op20_search_by_degree", f"{_DEGREES} SELECT id, in_degree + out_degree AS degree FROM full_nodes WHERE kind NOT IN ('Folder', 'Module') AND qualified_name ILIKE 'parts.%' AND in_degree + out_degree <= 40 ORDER BY in_degree + out_degree DESC, name, id LIMIT 100")
def _(nodes, edges):
    found = S.structured_search(nodes, edges, qn_like="parts.%", max_degree=40)
    return S.page(found, S.ORDERS["degree"](), 100).select("id", (F.col("in_degree") + F.col("out_degree")).alias("degree"))


_LIKE = {"order_1\\d+": "order\\__%", "^order_12$": "order\\_12", "ORDER_.*7": "ORDER\\_%7", "a\\.b": "%a.b%"}


@R.graph("op21_regex_search", "SELECT kind, count(*) AS n FROM g_nodes WHERE name ILIKE 'ORDER\\_%7' ESCAPE '\\' GROUP BY kind")
def _(nodes, edges):
    return nodes.where(F.col("name").ilike(S.like_of_regex("ORDER_.*7"))).groupBy("kind").agg(F.count("*").alias("n"))


@R.graph("op22_scope_counts", "SELECT count(*) AS nodes, (SELECT count(*) FROM g_edges e JOIN g_nodes s ON s.id = e.source_id WHERE s.file_path LIKE 'parts/%') AS edges FROM g_nodes WHERE file_path LIKE 'parts/%'")
def _(nodes, edges):
    inside = nodes.where(S.in_scope("parts/"))
    counted = edges.join(inside.select(F.col("id").alias("source_id")), "source_id", "left_semi").agg(F.count("*").alias("edges"))
    return inside.agg(F.count("*").alias("nodes")).join(F.broadcast(counted))  # one row each


@R.graph("op23_line_overlap", "SELECT id, start_line, end_line FROM g_nodes WHERE file_path = 'orders/1995/03/o7.ts' AND start_line <= 500 AND end_line >= 100")
def _(nodes, edges):
    return nodes.where(S.overlaps("orders/1995/03/o7.ts", 100, 500)).select("id", "start_line", "end_line")


@R.graph("op90_text_rank", f"""{_DEGREES}, scored AS (SELECT *, (CASE WHEN lower(name) LIKE '%supplier%' THEN 8 ELSE 0 END + CASE WHEN lower(qualified_name) LIKE '%supplier%' THEN 4 ELSE 0 END + CASE WHEN lower(file_path) LIKE '%supplier%' THEN 3 ELSE 0 END
 + CASE WHEN lower(name) LIKE '%asia%' THEN 8 ELSE 0 END + CASE WHEN lower(qualified_name) LIKE '%asia%' THEN 4 ELSE 0 END + CASE WHEN lower(file_path) LIKE '%asia%' THEN 3 ELSE 0 END) AS hits FROM full_nodes)
SELECT id, hits + CASE WHEN kind IN ('Function', 'Method') THEN 10 WHEN kind = 'Route' THEN 8 WHEN kind IN ('Class', 'Interface') THEN 5 WHEN kind IN ('Type', 'Enum') THEN 3 ELSE 0 END AS score FROM scored WHERE hits > 0""")
def _(nodes, edges):
    return S.text_rank(nodes, edges, "where is the Supplier_in ASIA").select("id", "score")


def _fuzzy_points(w: str) -> str:
    grams = [w[i : i + 3] for i in range(len(w) - 2)]
    near = "(" + " + ".join(f"CASE WHEN contains(lower(name), '{g}') THEN 1.0::DOUBLE ELSE 0.0 END" for g in grams) + f") / {float(len(grams))}::DOUBLE"
    return f"CASE WHEN contains(lower(name), '{w}') THEN 2.0 + CASE WHEN lower(name) = '{w}' THEN 3.0 WHEN starts_with(lower(name), '{w}') THEN {1.0 if len(w) >= 4 else 0.4} ELSE 0.0 END WHEN contains(lower(qualified_name), '{w}') THEN 1.0 ELSE CASE WHEN {near} >= 0.4 THEN {near} * 1.5 ELSE 0.0 END END"


_FUZZY = ["orders", "1995", "customer"]
_COVER = " + ".join(f"(contains(lower(name), '{w}') OR contains(lower(qualified_name), '{w}'){f" OR contains(lower(name), '{w[:-1]}') OR contains(lower(qualified_name), '{w[:-1]}')" if w.endswith("s") else ""})::INT" for w in _FUZZY)


@R.graph("op91_fuzzy_rank", f"""{_DEGREES}, m AS (SELECT *, {" + ".join(_fuzzy_points(w) for w in _FUZZY)} AS matched, {_COVER} AS covered FROM full_nodes WHERE kind IN ('Function', 'Method', 'Class', 'Interface', 'Variable', 'Route'))
SELECT id, round((matched + covered * 16.0 + CASE kind WHEN 'Route' THEN 5 WHEN 'Function' THEN 3 WHEN 'Method' THEN 3 WHEN 'Class' THEN 2 ELSE 0 END + least(in_degree, 20) * 0.5 + least(coalesce((properties->>'cyclomaticComplexity')::DOUBLE, 0), 100) * 0.1 + CASE WHEN contains(qualified_name, '.') AND NOT contains(qualified_name, '..') THEN 1 ELSE 0 END)::DOUBLE, 2) AS score FROM m WHERE matched > 0""")
def _(nodes, edges):
    return S.fuzzy_rank(nodes, edges, "orders of 1995 customer").select("id", "score")


@R.graph("op92_code_match_rank", """, matches AS (SELECT file_path, start_line + 3 AS line FROM g_nodes WHERE kind = 'Class'),
hit AS (SELECT m.file_path, m.line, n.id, n.kind, row_number() OVER (PARTITION BY m.file_path, m.line ORDER BY n.end_line - n.start_line, n.id) AS r FROM (SELECT DISTINCT * FROM matches) m JOIN g_nodes n ON n.file_path = m.file_path AND m.line BETWEEN n.start_line AND n.end_line WHERE n.kind NOT IN ('File', 'Folder', 'Module')),
fan AS (SELECT target_id AS id, count(*) AS n FROM g_edges GROUP BY 1)
SELECT h.file_path, h.line, h.id, coalesce(n, 0) + CASE WHEN kind IN ('Function', 'Method') THEN 10 WHEN kind = 'Class' THEN 5 ELSE 0 END AS score FROM hit h LEFT JOIN fan USING (id) WHERE r = 1""")
def _(nodes, edges):
    matches = nodes.where("kind = 'Class'").select("file_path", (F.col("start_line") + 3).alias("line")).distinct()
    found = S.enclosing_symbols(matches, nodes).where("id is not null")
    fan = edges.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n"))
    return found.join(fan, "id", "left").select("file_path", "line", "id", S.code_score(F.coalesce("n", F.lit(0).cast("long"))).alias("score"))


@R.graph("op37_enclosing_symbol", """, matches AS (SELECT DISTINCT file_path, end_line + 1 AS line FROM g_nodes WHERE kind IN ('Function', 'Interface')),
hit AS (SELECT m.file_path, m.line, n.id, row_number() OVER (PARTITION BY m.file_path, m.line ORDER BY n.end_line - n.start_line, n.id) AS r FROM matches m JOIN g_nodes n ON n.file_path = m.file_path AND m.line BETWEEN n.start_line AND n.end_line WHERE n.kind NOT IN ('File', 'Folder', 'Module'))
SELECT m.file_path, m.line, h.id FROM matches m LEFT JOIN hit h ON h.file_path = m.file_path AND h.line = m.line AND h.r = 1""")
def _(nodes, edges):
    matches = nodes.where("kind in ('Function', 'Interface')").select("file_path", (F.col("end_line") + 1).alias("line")).distinct()
    return S.enclosing_symbols(matches, nodes).select("file_path", "line", "id")


@R.graph("op94_page_with_totals", f"{_DEGREES}, all_rows AS (SELECT * FROM full_nodes WHERE kind = 'Class'), one AS (SELECT id, name FROM all_rows ORDER BY name, id LIMIT 20 OFFSET 20) SELECT id, name, (SELECT count(*) FROM all_rows) AS total, (SELECT count(*) FROM all_rows) > 40 AS has_more FROM one")
def _(nodes, edges):
    found = S.structured_search(nodes, edges, kind="Class")
    total = found.agg(F.count("*").alias("total"))
    return S.page(found, S.ORDERS["name"](), 20, 20).select("id", "name").join(F.broadcast(total)).withColumn("has_more", F.col("total") > 40)


@R.graph("op96_entry_points", "SELECT id, file_path, start_line FROM g_nodes WHERE is_entry_point = 1 OR kind = 'Route' ORDER BY (kind = 'Route')::INT DESC, (file_path LIKE '%index.%')::INT DESC, file_path, start_line, id LIMIT 20")
def _(nodes, edges):
    order = [(F.col("kind") == "Route").desc(), F.col("file_path").contains("index.").desc(), F.col("file_path"), F.col("start_line"), F.col("id")]
    return nodes.where("is_entry_point = 1 or kind = 'Route'").orderBy(*order).limit(20).select("id", "file_path", "start_line")


@R.graph("op98_ambiguous", f"{_DEGREES}, top AS (SELECT in_degree AS score, row_number() OVER (ORDER BY in_degree DESC) AS r FROM full_nodes) SELECT coalesce(max(score) FILTER (r = 1) - max(score) FILTER (r = 2) <= greatest(1, max(score) FILTER (r = 1) * 0.05), false) AS ambiguous FROM top WHERE r <= 2")
def _(nodes, edges):
    return S.ambiguous(S.with_degrees(nodes, edges).select(F.col("in_degree").alias("score")), 0.05)
