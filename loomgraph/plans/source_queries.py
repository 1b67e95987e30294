"""Queries of sources, stores and streams (these run over whole tables, as in a first batch)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions.texts import normal_list
from loomgraph.operators import store as P
from loomgraph.operators import usage as U
from loomgraph.plans.registry import Registry
from loomgraph.session import text_written
from loomgraph.sources import manifests as M
from loomgraph.streaming import events as S

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.table("op08_usage_log", "SELECT ts, type, tokens_saved, session_id, event_id FROM events_archive WHERE project = 'atlas-gateway' AND id % 10 <> 3")
def _(read):
    rows = read("events_archive")
    line = F.to_json(F.struct("ts", "type", "project", "tokens_saved", "session_id", "event_id"))
    broken = F.substring(line, F.lit(1), F.length(line) - 1)
    path = text_written(rows.select(F.when(F.col("id") % 10 == 3, broken).otherwise(line).alias("value")), "log")
    return M.usage_log(rows.sparkSession, path, "atlas-gateway")[0].select("ts", "type", "tokens_saved", "session_id", "event_id")


def _index(read):
    c = F.col
    rows = read("events_archive")
    line = F.to_json(F.struct(c("ts").alias("timestamp"), "project", F.when(c("id") % 6 == 1, 0).otherwise(c("id") % 50).cast("int").alias("tasks"), (c("id") % 6 != 2).alias("valid"), c("estimated_llm_cost_usd").alias("cost")))
    path = text_written(rows.select(F.when(c("id") % 6 == 3, F.concat(F.lit("#"), line)).otherwise(line).alias("value")), "index")
    return M.benchmark_index(rows.sparkSession, path)


@R.table("op09_benchmark_index", "SELECT ts AS timestamp, project, (id % 50)::INT AS tasks FROM events_archive WHERE id % 6 NOT IN (1, 2, 3) AND id % 50 > 0")
def _(read):
    return _index(read)[0].select("timestamp", "project", "tasks")


@R.table("op09_rejects", "SELECT CASE WHEN id % 6 = 3 THEN 'malformed_json' WHEN id % 6 = 2 THEN 'invalid_flag' ELSE 'legacy_empty_tasks' END AS reason, count(*) AS n FROM events_archive WHERE id % 6 IN (1, 2, 3) OR id % 50 = 0 GROUP BY 1")
def _(read):
    return _index(read)[1]


@R.table("op10_package_dependencies", "SELECT 'pkg' || p_partkey || '/package.json' AS path, unnest([lower(replace(p_name, ' ', '-')), 'dev' || p_size]) AS name, unnest(['^' || p_size || '.0', '1.x']) AS version, unnest([false, true]) AS dev FROM part WHERE p_partkey % 7 <> 0")
def _(read):
    c = F.col
    own, key = F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))), c("p_partkey").cast("string")
    text = F.concat(F.lit('{"dependencies":{"'), own, F.lit('":"^'), c("p_size").cast("string"), F.lit('.0"},"devDependencies":{"dev'), c("p_size").cast("string"), F.lit('":"1.x"}}'))
    content = F.when(c("p_partkey") % 7 == 0, F.lit("{ cut off")).otherwise(text)
    return M.package_json(read("part").select(F.concat(F.lit("pkg"), key, F.lit("/package.json")).alias("path"), content.alias("content")))


@R.table("op10_requirements", "SELECT 'r' || p_partkey || '/requirements.txt' AS path, unnest(['lib' || p_size, 'bare_' || p_partkey, 'other']) AS name, unnest(['1.' || p_size, '', '2']) AS version FROM part")
def _(read):
    c = F.col
    size, key = c("p_size").cast("string"), c("p_partkey").cast("string")
    content = F.concat(F.lit("# head\n-r base.txt\nlib"), size, F.lit("==1."), size, F.lit("\r\n\nbare_"), key, F.lit("  # note\nother[extra]>=2 ; python_version>'3'"))
    return M.requirements(read("part").select(F.concat(F.lit("r"), key, F.lit("/requirements.txt")).alias("path"), content.alias("content")))


@R.table("op11_status_lines", "SELECT CASE WHEN p_partkey % 5 = 1 THEN 'new/' ELSE '' END || 'f' || p_partkey AS path, CASE WHEN p_partkey % 5 = 1 THEN 'f' || p_partkey END AS old_path, CASE p_partkey % 5 WHEN 0 THEN 'modified' WHEN 1 THEN 'renamed' WHEN 2 THEN 'untracked' WHEN 3 THEN 'deleted' ELSE 'added' END AS change, p_partkey % 5 IN (1, 4) AS staged FROM part")
def _(read):
    key, name = F.col("p_partkey") % 5, F.concat(F.lit("f"), F.col("p_partkey").cast("string"))
    line = F.when(key == 0, F.concat(F.lit(" M "), name)).when(key == 1, F.concat(F.lit("R  "), name, F.lit(" -> new/"), name)).when(key == 2, F.concat(F.lit("?? "), name)).when(key == 3, F.concat(F.lit(" D "), name)).otherwise(F.concat(F.lit("A  "), name))
    return M.status_lines(read("part").select(line.alias("value"))).select("path", "old_path", "change", "staged")


@R.table("op11_name_status", "SELECT CASE WHEN p_partkey % 4 = 1 THEN 'new/' ELSE '' END || 'f' || p_partkey AS path, CASE WHEN p_partkey % 4 = 1 THEN 'f' || p_partkey END AS old_path, CASE p_partkey % 4 WHEN 0 THEN 'modified' WHEN 1 THEN 'renamed' WHEN 2 THEN 'deleted' ELSE 'added' END AS change FROM part")
def _(read):
    key, name = F.col("p_partkey") % 4, F.concat(F.lit("f"), F.col("p_partkey").cast("string"))
    line = F.when(key == 0, F.concat(F.lit("M\t"), name)).when(key == 1, F.concat(F.lit("R087\t"), name, F.lit("\tnew/"), name)).when(key == 2, F.concat(F.lit("D\t"), name)).otherwise(F.concat(F.lit("A\t"), name))
    return M.name_status(read("part").select(line.alias("value")))


@R.table("op01_kept_paths", "WITH f AS (SELECT DISTINCT file_path AS path FROM nodes WHERE file_path IS NOT NULL AND NOT contains(file_path, chr(10))), g AS (SELECT * FROM f UNION ALL SELECT 'lib/' || path FROM f UNION ALL SELECT 'node_modules/' || path FROM f UNION ALL SELECT 'gen/out2/' || path FROM f UNION ALL SELECT '.hidden/' || path FROM f UNION ALL SELECT 'gen/' || path FROM f) SELECT path FROM g WHERE NOT starts_with(path, 'lib/') AND NOT starts_with(path, 'gen/out2/') AND len(list_filter(list_slice(string_split(path, '/'), 1, -2), lambda x: starts_with(x, '.') OR x IN ('node_modules', 'dist', 'build', 'out', 'obj', 'target', 'tmp', 'temp', 'tmp_build', 'vendor', 'vendored', 'backups', 'reports', 'logs', '__pycache__', 'venv', 'coverage'))) = 0 AND NOT ends_with(path, '.gitignore')")
def _(read):
    paths = read("nodes").where("file_path is not null and not contains(file_path, '\n')").select(F.col("file_path").alias("path")).distinct()
    put = lambda at: paths.select(F.concat(F.lit(at), "path").alias("path"))
    rows = paths.unionByName(put("lib/")).unionByName(put("node_modules/")).unionByName(put("gen/out2/")).unionByName(put(".hidden/")).unionByName(put("gen/")).withColumn("content", F.lit(None).cast("string"))
    more = paths.sparkSession.createDataFrame([("lib/.git/HEAD", None), ("gen/.gitignore", "# made\n/out2/\n*.tmp\n")], "path string, content string")
    return M.kept_paths(rows.unionByName(more)).where("path not like '%.gitignore'").select("path")


@R.table("op143_dependency_edges", "SELECT p_partkey AS source_id, unnest(['lib' || p_size, 'both']) AS dependency, 'DEPENDS_ON' AS type, unnest([p_partkey % 2 = 0, false]) AS dev FROM part WHERE p_partkey % 3 > 0")
def _(read):
    c = F.col
    path = F.concat(F.lit("p"), c("p_partkey").cast("string"), F.lit("/package.json"))
    names = F.array(F.struct(F.concat(F.lit("lib"), c("p_size").cast("string")).alias("name"), (c("p_partkey") % 2 == 0).alias("dev")), F.struct(F.lit("both").alias("name"), F.lit(True).alias("dev")), F.struct(F.lit("both").alias("name"), F.lit(False).alias("dev")))
    wanted = read("part").select(path.alias("path"), F.explode(names).alias("n")).select("path", "n.*")
    files = read("part").where("p_partkey % 3 > 0").select(c("p_partkey").alias("id"), F.lit("File").alias("kind"), path.alias("file_path"))
    return M.dependency_edges(wanted, files)


@R.table("op28_file_lists", "SELECT id, name, file_path AS file FROM (SELECT id, unnest(['', name || 'x', file_path]) AS file, name, file_path FROM nodes WHERE name IS NOT NULL AND file_path IS NOT NULL AND NOT contains(name, ',') AND NOT contains(file_path, ',')) WHERE file = file_path")
def _(read):
    rows = read("nodes").where("name is not null and file_path is not null and not contains(name, ',') and not contains(file_path, ',')")
    listed = rows.select("id", "name", "file_path", F.explode(normal_list(F.concat(F.lit(" , "), "name", F.lit("x,, "), "file_path", F.lit("  ,")))).alias("file"))
    return listed.where("file = file_path").select("id", "name", "file")


@R.table("op07_upsert_nodes", "WITH n AS (SELECT *, row_number() OVER (PARTITION BY project, qualified_name ORDER BY id) AS r, row_number() OVER (PARTITION BY project, qualified_name ORDER BY id DESC) AS last, count(*) OVER (PARTITION BY project, qualified_name) AS k FROM nodes WHERE project IS NOT NULL AND qualified_name IS NOT NULL), a AS (SELECT * FROM n WHERE r = 1 AND id % 3 > 0) SELECT coalesce(a.id, 0) AS id, n.project, n.qualified_name, CASE WHEN n.k = 1 AND a.id IS NOT NULL THEN a.file_path ELSE n.file_path END AS file_path FROM n LEFT JOIN a USING (project, qualified_name) WHERE n.last = 1")
def _(read):
    rows = read("nodes").where("project is not null and qualified_name is not null").select("id", "project", "qualified_name", "file_path")
    first = U.first_rows(rows, ["project", "qualified_name"], ["id"])
    stored = first.where("id % 3 > 0").select("id", "project", "qualified_name", "file_path")
    later = rows.join(stored.select("id"), "id", "left_anti")
    merged = P.upsert_nodes(stored, later.withColumnRenamed("id", "ord"), "ord")
    known = stored.select("project", "qualified_name", F.lit(1).alias("known"))
    return merged.join(known, ["project", "qualified_name"], "left").select(F.when(F.col("known") == 1, F.col("id")).otherwise(0).alias("id"), "project", "qualified_name", "file_path")


_BURSTS = "WITH e AS (SELECT user_id % 40 AS path, ts FROM events), s AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL 10 MINUTE, true)::INT AS new FROM e WINDOW w AS (PARTITION BY path ORDER BY ts)), k AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY ts) AS n FROM s)"


@R.table("op190_debounced", f"{_BURSTS} SELECT path, epoch_us(min(ts)) AS started, count(*) AS changes FROM k GROUP BY path, n")
def _(read):
    rows = read("events").select((F.col("user_id") % 40).alias("path"), F.col("ts").cast("timestamp").alias("at"))
    return S.debounced(rows, "10 minutes").select("path", F.unix_micros("started").alias("started"), "changes")


@R.table("op192_idle_pause", "WITH s AS (SELECT event_type AS project, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 30 MINUTE, true)::INT AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)), k AS (SELECT *, sum(new) OVER (PARTITION BY project ORDER BY ts) AS n FROM s) SELECT project, epoch_us(min(ts)) AS active_from, epoch_us(max(ts)) + 1800000000 AS paused_at, count(*) AS events FROM k GROUP BY project, n")
def _(read):
    rows = read("events").select(F.col("event_type").alias("project"), F.col("ts").cast("timestamp").alias("at"))
    return S.idle_pause(rows).select("project", F.unix_micros("active_from").alias("active_from"), F.unix_micros("paused_at").alias("paused_at"), "events")


_TUMBLED = "SELECT event_type AS project, epoch_us(date_trunc('{u}', ts)) AS started, sum(user_id)::BIGINT AS tokens_saved, count(*) AS events FROM events GROUP BY 1, 2".format


def _tumbled(read, width):
    rows = read("events").select(F.col("event_type").alias("project"), F.col("ts").cast("timestamp").alias("at"), F.col("user_id").alias("tokens_saved"))
    return S.daily(rows, width=width).select("project", F.unix_micros("started").alias("started"), "tokens_saved", "events")


@R.table("op198_daily_windows", _TUMBLED(u="day"))
def _(read):
    return _tumbled(read, "1 day")


@R.table("op199_hourly_windows", _TUMBLED(u="hour"))
def _(read):
    return _tumbled(read, "1 hour")


@R.graph("op194_traces", ", t AS (SELECT DISTINCT e.source_id, e.target_id, CASE e.id % 3 WHEN 0 THEN 'HTTP_CALLS' WHEN 1 THEN 'ASYNC_CALLS' ELSE 'CHANNEL' END AS type FROM g_edges e WHERE e.type = 'USAGE' AND e.id % 4 > 0) SELECT * FROM t WHERE source_id % 10 > 0")
def _(nodes, edges):
    c = F.col
    ends = edges.where("type = 'USAGE'").join(nodes.select(c("id").alias("source_id"), c("qualified_name").alias("from")), "source_id").join(nodes.select(c("id").alias("target_id"), c("qualified_name").alias("to")), "target_id")
    kind = F.when(c("id") % 3 == 0, "http_call").when(c("id") % 3 == 1, "async_call").otherwise("channel_message")
    traces = ends.select(F.when(c("id") % 4 == 0, "unknown_kind").otherwise(kind).alias("type"), "from", F.col("to"))
    known = ends.where("source_id % 10 = 0").select("source_id", "target_id", F.explode(F.array(*(F.lit(t) for t in ("HTTP_CALLS", "ASYNC_CALLS", "CHANNEL")))).alias("type"))
    return S.ingest_traces(traces, nodes, known)
