"""Queries of usage events, evidence, manifests and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import texts as X
from loomgraph.operators import evidence as E
from loomgraph.operators import tools as T
from loomgraph.operators import usage as U
from loomgraph.plans.general_queries import AS_OF
from loomgraph.plans.registry import Registry
from loomgraph.sources import manifests as M

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

_TRIM = r"lower(regexp_replace({c}, '^\s+|\s+$', '', 'g'))"
_ARCHIVE = rf"""
WITH timed AS (SELECT * EXCLUDE (project, type), {_TRIM.format(c="project")} AS project, replace({_TRIM.format(c="type")}, '-', '_') AS type,
  CASE WHEN regexp_matches(trim(ts), '^\d{{4}}-\d{{2}}-\d{{2}}([T ]\d{{2}}:\d{{2}}(:\d{{2}}([.]\d{{1,9}})?)?( ?(Z|[+-]\d{{2}}:?\d{{2}}))?)?$') THEN
    try_cast(substr(trim(ts), 1, 10) || regexp_replace(substr(trim(ts), 11), ' ?(Z|[+-]\d{{2}}:?\d{{2}})$', '') AS timestamp)
    - to_minutes(coalesce(try_cast(regexp_extract(substr(trim(ts), 11), '([+-]\d{{2}}):?\d{{2}}$', 1) AS INT) * 60
      + try_cast(regexp_extract(substr(trim(ts), 11), '([+-])\d{{2}}:?(\d{{2}})$', 1) || regexp_extract(substr(trim(ts), 11), '[+-]\d{{2}}:?(\d{{2}})$', 1) AS INT), 0)) END AS moment,
  row_number() OVER (PARTITION BY event_id ORDER BY id) AS copy FROM events_archive),
ev AS (SELECT *, epoch_us(moment) AS us, string_split(type, '.')[1] AS tool, strftime(moment, '%Y-%m-%d') AS day, coalesce(llm_provider NOT IN ('heuristic', ''), false) AS llm FROM timed WHERE (event_id IS NULL OR copy = 1) AND moment IS NOT NULL)
"""
_COST = "round(coalesce(sum(estimated_llm_cost_usd) FILTER (NOT isnan(estimated_llm_cost_usd)), 0), 6)"


def _sum(c: str) -> str:
    return f"coalesce(sum({c}), 0)::BIGINT AS {c}"


@R.table("op195_idempotent_archive", f"{_ARCHIVE} SELECT project, count(*) AS n, count(event_id) AS keyed FROM ev GROUP BY project")
def _(read):
    return U.archive(read("events_archive")).groupBy("project").agg(F.count("*").alias("n"), F.count("event_id").alias("keyed"))


@R.table("op196_legacy_dedupe", "SELECT project, count(DISTINCT (coalesce(ts, ''), coalesce(type, ''), coalesce(query_hash, ''), coalesce(files_avoided, 0), coalesce(tokens_saved, 0))) AS n FROM events_archive WHERE event_id IS NULL GROUP BY project")
def _(read):
    return U.without_legacy_repeats(read("events_archive")).groupBy("project").agg(F.count("*").alias("n"))


@R.table("op63_daily_rollup", f"{_ARCHIVE} SELECT project, day, {_sum('tokens_saved')}, {_sum('files_avoided')}, coalesce(max(unique_files), 0) AS unique_files, sum(llm::INT)::BIGINT AS llm_events, coalesce(sum((llm AND top_changed = 1)::INT), 0)::BIGINT AS llm_top_changed, {_COST} AS llm_cost, count(*) AS events_count, count(DISTINCT nullif(session_id, '')) AS sessions_count, count(DISTINCT nullif(task_id, '')) AS tasks_count, coalesce(sum((deterministic_mode = 1)::INT), 0)::BIGINT AS deterministic_events FROM ev GROUP BY project, day")
def _(read):
    return U.daily_rollup(U.archive(read("events_archive")))


@R.table("op64_day_flush", f"{_ARCHIVE} SELECT project, day, {_sum('tokens_saved')}, count(DISTINCT files_json) AS distinct_files, count(*) AS events_count FROM ev WHERE day = '2026-06-29' GROUP BY project, day")
def _(read):
    return U.day_flush(U.archive(read("events_archive")), "2026-06-29")


_DAILY = "WITH d AS (SELECT *, substr(date, 1, 10) AS day, row_number() OVER (PARTITION BY project, substr(date, 1, 10) ORDER BY written_at DESC NULLS LAST, tokens_saved DESC NULLS LAST, events_count DESC NULLS LAST) AS r FROM daily_snapshots WHERE try_cast(substr(date, 1, 10) AS date) IS NOT NULL), latest AS (SELECT * FROM d WHERE r = 1)"


def _latest_days(read):
    rows = read("daily_snapshots").withColumn("day", F.substring("date", 1, 10)).where(F.col("day").try_cast("date").isNotNull())
    return U.first_rows(rows.withColumns({"w": -F.coalesce(F.unix_micros(F.col("written_at").cast("timestamp")), F.lit(-(2**62))), "t": -F.coalesce("tokens_saved", F.lit(-(2**62))), "e": -F.coalesce(F.col("events_count").cast("long"), F.lit(-(2**62)))}), ["project", "day"], ["w", "t", "e"])


@R.table("op65_history_totals", f"{_DAILY} SELECT project, {_sum('tokens_saved')}, {_sum('events_count')}, max(unique_files) AS unique_files, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM latest WHERE day >= '2026-04-01' GROUP BY project")
def _(read):
    rows = _latest_days(read).where("day >= '2026-04-01'")
    return rows.groupBy("project").agg(U.total("tokens_saved").alias("tokens_saved"), U.total("events_count").alias("events_count"), F.max("unique_files").alias("unique_files"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days"))


@R.table("op71_last_two_days", f"{_DAILY}, r2 AS (SELECT project, day, tokens_saved, events_count, row_number() OVER w AS r, tokens_saved - lead(tokens_saved) OVER w AS tokens_saved_delta, events_count - lead(events_count) OVER w AS events_count_delta FROM latest WINDOW w AS (PARTITION BY project ORDER BY day DESC)) SELECT project, day, tokens_saved, events_count, tokens_saved_delta, events_count_delta FROM r2 WHERE r = 1")
def _(read):
    return U.last_two(_latest_days(read), "project", "day", ["tokens_saved", "events_count"])


_CATEGORY = """CASE WHEN tool = 'tool_observation' AND tool_hint <> '' THEN CASE
  WHEN tool_hint IN ('investigate_symbol', 'get_edge_evidence') THEN 'smart_navigation' WHEN tool_hint IN ('pack_memory', 'get_graph_schema') THEN 'context_packing'
  WHEN tool_hint IN ('detect_changes', 'assess_impact', 'analyze_hotspots', 'find_dead_code', 'compare_runs') THEN 'impact_analysis'
  WHEN tool_hint IN ('index_repository', 'index_status', 'ingest_traces', 'watch_project', 'manage_adr', 'delete_project', 'auto_index') THEN 'project_operations' ELSE 'other' END
WHEN tool IN ('architecture_overview', 'llm_rerank', 'hook_augment') THEN tool WHEN tool IN ('search_graph', 'search_code', 'semantic_search') THEN 'direct_discovery'
WHEN tool IN ('trace_path', 'get_code_snippet', 'batch_get_code') THEN 'smart_navigation' WHEN tool = 'pack_context' THEN 'context_packing'
WHEN tool IN ('explain_symbol', 'smart_review', 'find_tests') THEN 'impact_analysis' ELSE 'other' END"""
_WINDOWS = {"24h": 1, "7d": 7, "30d": 30, "total": None}


@R.table("op66_look_back", f"{_ARCHIVE}, w AS (SELECT * FROM (VALUES ('24h', 1), ('7d', 7), ('30d', 30), ('total', 100000)) t(\"window\", days)) SELECT \"window\", {_CATEGORY} AS category, {_sum('tokens_saved')}, {_sum('files_avoided')}, count(*) AS events FROM ev JOIN w ON us <= epoch_us(TIMESTAMP '{AS_OF}') AND us >= epoch_us(TIMESTAMP '{AS_OF}') - days * 86400000000 GROUP BY ALL")
def _(read):
    return U.look_back(U.archive(read("events_archive")), AS_OF, _WINDOWS)


@R.table("op67_llm_breakdown", f"{_ARCHIVE} SELECT llm_provider, llm_model, count(*) AS calls, {_COST} AS cost, coalesce(sum(llm_latency_ms), 0)::BIGINT AS latency_ms FROM ev WHERE llm GROUP BY ALL")
def _(read):
    return U.llm_breakdown(U.archive(read("events_archive")))


@R.table("op68_savings_by_tool", f"{_ARCHIVE} SELECT coalesce(nullif(tool_hint, ''), tool) AS tool, count(*) AS events, {_sum('tokens_saved')}, {_sum('files_avoided')} FROM ev WHERE coalesce(tokens_saved, 0) > 0 OR coalesce(files_avoided, 0) > 0 GROUP BY 1")
def _(read):
    return U.savings_by_tool(U.archive(read("events_archive")))


@R.table("op68_savings_confidence", f"{_ARCHIVE}, s AS (SELECT *, coalesce(tokens_saved > 0, false) OR coalesce(files_avoided > 0, false) AS saves, row_number() OVER (PARTITION BY project ORDER BY (coalesce(tokens_saved > 0, false) OR coalesce(files_avoided > 0, false)) DESC, coalesce(tokens_saved, 0) DESC, id) AS r FROM ev) SELECT project, sum(saves::INT)::BIGINT AS saving, sum((NOT saves)::INT)::BIGINT AS operational, coalesce(max(confidence) FILTER (r = 1 AND saves), 'medium') AS confidence FROM s GROUP BY project")
def _(read):
    return U.savings_confidence(U.archive(read("events_archive")))


@R.table("op69_confidence_pivot", f"{_ARCHIVE} SELECT project, " + ", ".join(f"coalesce(sum(tokens_saved) FILTER (confidence = '{c}'), 0)::BIGINT AS tokens_{c}" for c in ("high", "medium", "low")) + " FROM ev GROUP BY project")
def _(read):
    return U.confidence_pivot(U.archive(read("events_archive")))


@R.table("op70_order_statistics", f"{_ARCHIVE}, v AS (SELECT tool, llm_latency_ms, row_number() OVER (PARTITION BY tool ORDER BY llm_latency_ms) - 1 AS i, count(*) OVER (PARTITION BY tool) AS n FROM ev WHERE llm_latency_ms IS NOT NULL) SELECT tool, max(n) AS n, max(llm_latency_ms) FILTER (i = floor(n / 2)) AS upper_median, max(llm_latency_ms) FILTER (i = ceil(n * 0.95) - 1) AS p95 FROM v GROUP BY tool")
def _(read):
    return U.order_statistics(U.archive(read("events_archive")), "tool", "llm_latency_ms")


@R.table("op74_nearest_rank", f"{_ARCHIVE} SELECT tool, quantile_disc(llm_latency_ms, 0.5) AS p50, quantile_disc(llm_latency_ms, 0.95) AS p95, max(llm_latency_ms) AS most FROM ev GROUP BY tool")
def _(read):
    return U.nearest_rank(U.archive(read("events_archive")), "tool", "llm_latency_ms")


@R.table("op72_complexity_trend", "WITH v AS (SELECT *, row_number() OVER (PARTITION BY project, qualified_name ORDER BY measured_at, complexity) AS a, row_number() OVER (PARTITION BY project, qualified_name ORDER BY measured_at DESC, complexity DESC) AS b, count(*) OVER (PARTITION BY project, qualified_name) AS n FROM hotspot_rows WHERE complexity IS NOT NULL AND measured_at IS NOT NULL), t AS (SELECT project, qualified_name, max(n) AS samples, max(complexity) FILTER (a = 1) AS first, max(complexity) FILTER (b = 1) AS last FROM v GROUP BY ALL) SELECT *, CASE WHEN samples < 2 THEN 'no_data' WHEN last - first > 5 THEN 'worsening' WHEN last - first < -5 THEN 'improving' ELSE 'stable' END AS trend FROM t")
def _(read):
    return U.trend(read("hotspot_rows"), ["project", "qualified_name"], "measured_at", "complexity")


@R.table("op73_win_rates", f"{_ARCHIVE}, g AS (SELECT project, count(*) AS n, sum((top_changed = 1)::INT)::BIGINT AS wins FROM ev WHERE llm AND top_changed IS NOT NULL AND project IS NOT NULL GROUP BY ROLLUP (project)) SELECT project, n, wins, CASE WHEN n > 0 THEN round((wins / n + 3.8416 / (2 * n) - 1.96 * sqrt((wins / n * (1 - wins / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 6) ELSE 0 END AS low, CASE WHEN n > 0 THEN round((wins / n + 3.8416 / (2 * n) + 1.96 * sqrt((wins / n * (1 - wins / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 6) ELSE 0 END AS high FROM (SELECT project, n::DOUBLE AS n, wins::DOUBLE AS wins FROM g)")
def _(read):
    found = U.win_rates(U.archive(read("events_archive")))
    return found.withColumns({"n": F.col("n").cast("double"), "wins": F.col("wins").cast("double")})


@R.table("op75_set_scores", "WITH e AS (SELECT DISTINCT qualified_name AS k FROM nodes), a AS (SELECT DISTINCT qualified_name AS k FROM semantic_entities WHERE qualified_name IS NOT NULL), c AS (SELECT count(*) FILTER (e.k IS NOT NULL AND a.k IS NOT NULL) AS tp, count(*) FILTER (e.k IS NULL) AS fp, count(*) FILTER (a.k IS NULL) AS fn FROM e FULL JOIN a ON e.k = a.k) SELECT tp, fp, fn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM c")
def _(read):
    key = lambda t: read(t).where("qualified_name is not null").select(F.col("qualified_name").alias("k"))
    return U.set_scores(key("nodes"), key("semantic_entities"), "k")


@R.table("op79_tool_counters", f"{_ARCHIVE} SELECT day, sum((tool = 'search_code')::INT)::BIGINT AS search_code, sum((tool = 'trace_path')::INT)::BIGINT AS trace_path, count(*) AS total FROM ev GROUP BY day")
def _(read):
    return U.tool_counters(U.archive(read("events_archive")), ["search_code", "trace_path"])


_FILES = f"{_ARCHIVE}, files AS (SELECT *, unnest(from_json(files_json, '[\"VARCHAR\"]')) AS file FROM ev WHERE json_valid(files_json) AND json_type(files_json) = 'ARRAY')"


@R.table("op86_first_seen_ratio", f"{_FILES}, f AS (SELECT DISTINCT id, project, session_id, us, file FROM files WHERE file IS NOT NULL AND session_id IS NOT NULL), m AS (SELECT *, (row_number() OVER (PARTITION BY project, session_id, file ORDER BY us, id) = 1)::INT AS fresh FROM f) SELECT id, count(*) AS files, sum(fresh)::BIGINT AS fresh, round(avg(fresh), 6) AS ratio FROM m GROUP BY id")
def _(read):
    return U.first_seen_ratio(U.archive(read("events_archive")))


@R.table("op88_churn", f"{_FILES} SELECT file, count(*) AS changes FROM files WHERE file IS NOT NULL GROUP BY file ORDER BY changes DESC, file LIMIT 20")
def _(read):
    return U.churn(U.archive(read("events_archive")))


@R.table("op202_activity", f"{_ARCHIVE}, m AS (SELECT project, id, us, coalesce(us - lag(us) OVER w >= 1800000000, true)::INT AS new FROM ev WINDOW w AS (PARTITION BY project ORDER BY us, id)), s AS (SELECT project, us, sum(new) OVER (PARTITION BY project ORDER BY us, id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM m) SELECT project, session, min(us) AS started, count(*) AS n FROM s GROUP BY project, session")
def _(read):
    return U.activity(U.archive(read("events_archive")))


@R.table("op200_settled", f"{_ARCHIVE} SELECT id, CASE WHEN EXISTS (SELECT 1 FROM ev r WHERE r.project = s.project AND r.tool = s.tool_hint AND r.us BETWEEN s.us AND s.us + 86400000000) THEN 'followed' WHEN us < epoch_us(TIMESTAMP '{AS_OF}') - 86400000000 THEN 'expired' ELSE 'pending' END AS state FROM ev s WHERE tool_hint IS NOT NULL")
def _(read):
    events = U.archive(read("events_archive"))
    asked = events.where("tool_hint is not null").select("id", "project", F.col("tool_hint").alias("tool"), "at")
    return U.settled(asked, events.select("project", "tool", "at"), AS_OF, 24 * 60)


@R.table("op85_last_samples", """WITH k AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY day DESC, t DESC) AS r FROM (SELECT project, substr(date, 1, 10) AS day, tokens_saved AS t FROM daily_snapshots WHERE tokens_saved IS NOT NULL AND date IS NOT NULL)), s AS (SELECT project, count(*) AS samples, arg_max(t, r) AS first, arg_min(t, r) AS last FROM k WHERE r <= 10 GROUP BY project)
SELECT *, CASE WHEN samples < 2 THEN 'no_data' WHEN last - first > 500 THEN 'worsening' WHEN last - first < -500 THEN 'improving' ELSE 'stable' END AS trend FROM s""")
def _(read):
    return U.trend(read("daily_snapshots").withColumn("day", F.substring("date", 1, 10)), ["project"], "day", "tokens_saved", 500, 10)


@R.table("op80_first_rows", "SELECT DISTINCT ON (project, qualified_name) project, qualified_name, hotspot_id FROM hotspot_rows ORDER BY project, qualified_name, hotspot_id")
def _(read):
    return U.first_rows(read("hotspot_rows"), ["project", "qualified_name"], ["hotspot_id"]).select("project", "qualified_name", "hotspot_id")


@R.table("op99_seeded_order", "SELECT hotspot_id, md5('7:' || hotspot_id) AS draw FROM hotspot_rows ORDER BY draw, hotspot_id LIMIT 50")
def _(read):
    return U.seeded_order(read("hotspot_rows"), "hotspot_id", 7).orderBy("draw", "hotspot_id").limit(50).select("hotspot_id", "draw")


@R.table("op77_evidence", """WITH ev AS (SELECT DISTINCT l_partkey AS relation, l_orderkey * 10 + l_linenumber AS evidence_id, l_returnflag AS kind, l_linestatus, l_discount, l_suppkey % 7 AS source, l_shipdate FROM lineitem),
one AS (SELECT *, row_number() OVER (PARTITION BY relation, evidence_id ORDER BY l_discount DESC, l_shipdate, kind, l_linestatus, source) AS r FROM ev),
s AS (SELECT relation, CASE l_linestatus WHEN 'O' THEN 'supports' ELSE 'contradicts' END AS polarity, source, kind,
  round(least(l_discount * CASE l_linestatus WHEN 'O' THEN 8 ELSE 1 END, CASE kind WHEN 'A' THEN 0.6 ELSE 1 END) * CASE kind WHEN 'R' THEN pow(0.5, greatest(0, epoch_us(TIMESTAMP '1998-01-01') - epoch_us(l_shipdate)) / 86400000000.0 / 1000) ELSE 1 END, 12)::DOUBLE AS s FROM one WHERE r = 1),
g AS (SELECT relation, polarity, source, max(s) AS s, max(CASE WHEN kind = 'N' THEN s ELSE 0 END) AS d FROM s GROUP BY ALL),
p AS (SELECT relation, round(1 - coalesce(product(1 - s) FILTER (polarity = 'supports'), 1), 12) AS support, round(1 - coalesce(product(1 - s) FILTER (polarity = 'contradicts'), 1), 12) AS contradiction, round(1 - coalesce(product(1 - d) FILTER (polarity = 'supports'), 1), 12) AS certain, count(*) AS groups FROM g GROUP BY relation),
c AS (SELECT *, round(support * (1 - contradiction), 12) AS confidence FROM p)
SELECT relation, round(support, 6) AS support, round(contradiction, 6) AS contradiction, round(confidence, 6) AS confidence, groups, CASE WHEN confidence >= 0.9 AND certain >= 0.9 THEN 'verified' WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' WHEN confidence >= 0.25 THEN 'low' ELSE 'speculative' END AS level FROM c""")
def _(read):
    c = F.col
    rows = read("lineitem").select(c("l_partkey").alias("relation"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("evidence_id"), c("l_returnflag").alias("kind"), "l_linestatus", "l_discount", (c("l_suppkey") % 7).alias("source"), c("l_shipdate").alias("observed_at"))
    one = U.first_rows(rows.withColumn("down", -c("l_discount")), ["relation", "evidence_id"], ["down", "observed_at", "kind", "l_linestatus", "source"])
    evidence = one.select("relation", "evidence_id", "kind", F.when(c("l_linestatus") == "O", "supports").otherwise("contradicts").alias("polarity"), (c("l_discount") * F.when(c("l_linestatus") == "O", 8).otherwise(1)).alias("strength"), "source", "observed_at")
    found = E.reconcile(evidence, "1998-01-01 00:00:00", {"A": 0.6}, {"R": 1000.0}, ("N",))
    return found.select("relation", *(F.round(x, 6).alias(x) for x in ("support", "contradiction", "confidence")), "groups", "level")


@R.table("op73_arm_savings", """WITH r AS (SELECT project, llm_latency_ms::DOUBLE AS base, (id % 200)::DOUBLE AS test FROM events_archive WHERE project IS NOT NULL AND llm_latency_ms IS NOT NULL), p AS (SELECT project, count(*) AS n, count(*) FILTER (test < base) AS wins, count(*) FILTER (test = base) AS ties, sum(base) AS b, sum(test) AS t FROM r GROUP BY project), q AS (SELECT *, CASE WHEN b <> 0 THEN (b - t) / b END AS ratio FROM p),
a AS (SELECT project, sum(n)::BIGINT AS n, sum(wins)::BIGINT AS wins, sum(ties)::BIGINT AS ties, sum(b) AS b, sum(t) AS t, avg(ratio) AS macro FROM q GROUP BY ROLLUP (project)), z AS (SELECT *, n - ties AS k, wins / nullif(n - ties, 0)::DOUBLE AS w FROM a)
SELECT project, n, wins, ties, n - wins - ties AS losses, round(CASE WHEN b <> 0 THEN (b - t) / b END, 6) AS micro, round(macro, 6) AS macro, CASE WHEN k > 0 THEN round((w + 3.8416 / (2 * k) - 1.96 * sqrt((w * (1 - w) + 3.8416 / (4 * k)) / k)) / (1 + 3.8416 / k), 6) ELSE 0 END AS low, CASE WHEN k > 0 THEN round((w + 3.8416 / (2 * k) + 1.96 * sqrt((w * (1 - w) + 3.8416 / (4 * k)) / k)) / (1 + 3.8416 / k), 6) ELSE 0 END AS high FROM z""")
def _(read):
    return U.arm_savings(read("events_archive").select("project", F.col("llm_latency_ms").cast("double").alias("base"), (F.col("id") % 200).cast("double").alias("test")))


@R.table("op168_semantic_ids", "SELECT id, sha256('[' || coalesce(to_json(project)::VARCHAR, 'null') || ',' || coalesce(to_json(entity_class)::VARCHAR, 'null') || ',' || coalesce(to_json(normalized_signature)::VARCHAR, 'null') || ',' || coalesce(to_json(structural_context)::VARCHAR, 'null') || ']') AS semantic FROM semantic_entities")
def _(read):
    return read("semantic_entities").select("id", E.content_id("project", "entity_class", "normalized_signature", "structural_context").alias("semantic"))


_MANIFESTS = "WITH stored AS (SELECT 'd/' || doc_id AS path, sha256(text) AS h FROM documents WHERE text IS NOT NULL AND doc_id % 10 <> 3), current AS (SELECT CASE WHEN doc_id % 10 = 1 THEN 'moved/' ELSE 'd/' END || doc_id AS path, sha256(CASE WHEN doc_id % 10 = 2 THEN text || '!' ELSE text END) AS h FROM documents WHERE text IS NOT NULL AND doc_id % 10 <> 0)"


def _manifests(read):
    rows, last = read("documents").where("text is not null"), F.col("doc_id") % 10
    name = F.col("doc_id").cast("string")
    stored = rows.where(last != 3).select(F.concat(F.lit("d/"), name).alias("path"), F.sha2("text", 256).alias("sha256"))
    current = rows.where(last != 0).select(F.concat(F.when(last == 1, "moved/").otherwise("d/"), name).alias("path"), F.sha2(F.when(last == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return stored, current


@R.table("op05_stale_files", f"{_MANIFESTS} SELECT path FROM current c WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.path = c.path AND s.h = c.h)")
def _(read):
    stored, current = _manifests(read)
    return M.stale_files(current, stored).select("path")


@R.table("op06_change_classes", f"""{_MANIFESTS}, b AS (SELECT coalesce(s.path, c.path) AS path, s.h AS old, c.h AS new FROM stored s FULL JOIN current c ON s.path = c.path),
g AS (SELECT old AS h, min(path) AS old_path FROM b WHERE new IS NULL GROUP BY 1 HAVING count(*) = 1), f AS (SELECT new AS h, min(path) AS path FROM b WHERE old IS NULL GROUP BY 1 HAVING count(*) = 1), r AS (SELECT path, old_path FROM g JOIN f USING (h))
SELECT path, 'modified' AS change, NULL AS old_path FROM b WHERE old <> new UNION ALL SELECT path, 'renamed', old_path FROM r UNION ALL SELECT path, 'deleted', NULL FROM b WHERE new IS NULL AND path NOT IN (SELECT old_path FROM r) UNION ALL SELECT path, 'added', NULL FROM b WHERE old IS NULL AND path NOT IN (SELECT path FROM r)""")
def _(read):
    return M.classify_changes(*_manifests(read))


@R.table("op166_drift", f"{_MANIFESTS} SELECT count(*) FILTER (s.path IS NULL OR c.path IS NULL OR s.h <> c.h) AS mismatches, count(*) AS n, 'drifted' AS status FROM stored s FULL JOIN current c ON s.path = c.path")
def _(read):
    stored, current = (m.select(F.col("path").alias("key"), F.col("sha256").alias("value")) for m in _manifests(read))
    return M.drift(stored, current)


@R.table("op02_languages", "SELECT CASE lower(regexp_extract(file_path, '[.]([A-Za-z0-9]+)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in M.LANGUAGES.items()) + " END AS language, count(*) AS n FROM nodes GROUP BY 1")
def _(read):
    return read("nodes").groupBy(M.language(F.col("file_path")).alias("language")).agg(F.count("*").alias("n"))


@R.table("op161_grep", "SELECT doc_id, line, content FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(content, '(raise|return).*[0-9]')")
def _(read):
    return X.grep(read("documents").where("text is not null"), "(raise|return).*[0-9]")


@R.table("op162_snippets", "SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS snippet FROM documents WHERE text IS NOT NULL AND len(string_split(text, chr(10))) >= 4")
def _(read):
    rows = read("documents").where("text is not null").where(F.size(F.split("text", "\n")) >= 4)
    return rows.select("doc_id", X.snippet(F.col("text"), F.lit(3), F.lit(3), 1).alias("snippet"))


_BASE = "regexp_extract(file_path, '[^/]*$')"
_FOLDERS = "starts_with({p}, 'tests/') OR starts_with({p}, 'test/') OR contains({p}, '/tests/') OR contains({p}, '/test/') OR contains({p}, '__tests__/') OR contains({p}, '.test.') OR contains({p}, '.spec.')"
_STEM = "regexp_extract(file_path, '^(.*)[.][^.]+$', 1)"


@R.table("op26_test_paths", f"SELECT sum((starts_with({_BASE}, 'test_') OR {_FOLDERS.format(p='file_path')} OR ends_with({_STEM}, '_test') OR ends_with({_STEM}, '_spec') OR ends_with({_STEM}, 'Test') OR ends_with({_STEM}, 'Spec'))::INT)::BIGINT AS resolver, sum(regexp_matches(file_path, '(^|/)(tests?|__tests__)/|[.](test|spec)[.]')::INT)::BIGINT AS trace, sum(({_FOLDERS.format(p='lower(file_path)')})::INT)::BIGINT AS impact FROM (SELECT file_path FROM nodes UNION ALL SELECT regexp_replace(file_path, '([.][a-z]+)$', s || '\\1') FROM nodes, (VALUES ('Test'), ('_spec'), ('.test'), ('Spec.x')) v(s))")
def _(read):
    paths = read("nodes").select("file_path")
    named = paths.withColumn("s", F.explode(F.array(*(F.lit(x) for x in ("Test", "_spec", ".test", "Spec.x"))))).select(F.regexp_replace("file_path", F.lit(r"([.][a-z]+)$"), F.concat("s", F.lit("$1"))).alias("file_path"))
    return paths.unionByName(named).agg(*(F.count_if(test).alias(name) for name, test in X.is_test_path(F.col("file_path")).items()))


_UNQUOTED = r"regexp_replace(regexp_replace(regexp_replace(text, chr(39) || '[^' || chr(39) || ']*' || chr(39), '', 'g'), '\"[^\"]*\"', '', 'g'), '`[^`]*`', '', 'g')"


@R.table("fn_cyclomatic", rf"SELECT doc_id, (1 + len(regexp_extract_all(text, '\b(if|for|while|do|catch|switch|case)\b')) + len(regexp_extract_all(text, '\bdefault\s*:')) + len(regexp_extract_all({_UNQUOTED}, '&&|[|][|]|[?][?]')))::INT AS paths FROM documents WHERE text IS NOT NULL")
def _(read):
    return read("documents").where("text is not null").select("doc_id", X.cyclomatic(F.col("text")).alias("paths"))


@R.table("fn_cognitive", rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, i, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line FROM l),
k AS (SELECT *, (len(regexp_extract_all(line, '\{{')) - len(regexp_extract_all(line, '\}}'))) AS d FROM t WHERE line <> '' AND NOT starts_with(line, '//') AND NOT starts_with(line, '*')),
s AS (SELECT *, sum(d) OVER w AS total FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)), m AS (SELECT *, total - least(0, min(total) OVER w) AS after FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY i)), b AS (SELECT *, coalesce(lag(after) OVER w, 0) AS depth FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT doc_id, sum((regexp_matches(line, '\b(if|for|while|do|catch|switch)\b')::INT + regexp_matches(line, '\?\s*[^:]+:')::INT) * (1 + depth) + regexp_matches(line, '&&|[|][|]|[?][?]')::INT * (0.5::DOUBLE + depth * 0.25)) AS n FROM b GROUP BY doc_id)
SELECT d.doc_id, floor(coalesce(n, 0)::DOUBLE * 10 + 0.5) / 10 AS score FROM documents d LEFT JOIN p USING (doc_id) WHERE text IS NOT NULL""")
def _(read):
    return read("documents").where("text is not null").select("doc_id", X.cognitive(F.col("text")).alias("score"))


@R.table("op89_tokens_of_files", """WITH f AS (SELECT id, unnest(from_json(files_json, '["VARCHAR"]')) AS file FROM events_archive WHERE json_valid(files_json)), s AS (SELECT DISTINCT file, length(file) * 100 AS size FROM f WHERE file IS NOT NULL AND length(file) % 3 > 0) SELECT id, floor(sum(coalesce(size, 3600)) / 4.0 + 0.5)::BIGINT AS tokens, count(*) AS files, CASE WHEN count(*) >= 12 THEN 'high' WHEN count(*) >= 4 THEN 'medium' ELSE 'low' END AS confidence FROM f LEFT JOIN s USING (file) WHERE file IS NOT NULL GROUP BY id""")
def _(read):
    files = U.event_files(read("events_archive")).select("id", "file")
    sizes = files.select("file").distinct().where(F.length("file") % 3 > 0).withColumn("size", F.length("file") * 100)
    return T.tokens_of_files(files, sizes)


@R.table("fn_redacted", r"SELECT id, substr(regexp_replace(regexp_replace(query, '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}', '[email]', 'g'), '\+?\b\d(?:[ .()-]{0,2}\d){8,14}\b', '[phone]', 'g'), 1, 180) AS query FROM events_archive WHERE query IS NOT NULL")
def _(read):
    return read("events_archive").where("query is not null").select("id", X.redacted(F.col("query")).alias("query"))
