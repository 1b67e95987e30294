"""Queries of the general problems (1, 2, 3 and 5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.feature_table import feature_table, features_long
from loomgraph.operators.history import attribute_intervals, attribute_log, effective_writes, entity_history
from loomgraph.operators.rolling import bursts, rolling_totals
from loomgraph.operators.snapshot_diff import snapshot_changes
from loomgraph.operators.snapshots import ready_sequence

AS_OF = "2026-06-30 00:00:00"
#: A case of p1_found: a type once used, then given up.
LAPSED_BEFORE, LAPSED_EVENTS, LAPSED_TOKENS = "2026-05-01 00:00:00", 5, 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features_long(feature_table(table(spark, sf_dir, "events_archive"), AS_OF), AS_OF)
    return rows.select(F.col("entity").alias("project"), F.col("kind").alias("event_type"), F.col("n").alias("n_events"), F.col("total").alias("tokens_saved"), (F.col("age_us") / 1_000_000).cast("long").alias("age_s"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.functions.times import micros_of

    rows = features_long(feature_table(table(spark, sf_dir, "events_archive"), AS_OF), AS_OF)
    lapsed = (F.col("n") >= LAPSED_EVENTS) & (F.col("total") >= LAPSED_TOKENS) & (F.col("latest") < micros_of(LAPSED_BEFORE))
    return rows.where(lapsed).select(F.col("entity").alias("project"), F.col("kind").alias("event_type"))


def p2_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entity_history(table(spark, sf_dir, "semantic_entities"), table(spark, sf_dir, "graph_snapshots"))
    return rows.select("project", "semantic_id", "entity_class", "name", "qualified_name", "normalized_signature", "structural_context", "properties_json", F.col("start_snapshot").alias("first_seen_snapshot"), "end_snapshot", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("valid_from", "valid_to")))


def p2_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = effective_writes(table(spark, sf_dir, "semantic_entities"), ready_sequence(table(spark, sf_dir, "graph_snapshots")))
    return attribute_intervals(attribute_log(writes)).select("project", "semantic_id", "attribute", "value", "start_snapshot", "end_snapshot")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entity_history(table(spark, sf_dir, "semantic_entities"), table(spark, sf_dir, "graph_snapshots"))
    return rows.select("project", "semantic_id", "start_snapshot", F.coalesce("end_snapshot", F.lit("")).alias("end_snapshot"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "graph_snapshots")).select("project", "snapshot_id", "qualified_name", "change")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bursts(rolling_totals(table(spark, sf_dir, "daily_snapshots")))
    return rows.select(F.col("entity").alias("project"), F.date_format("day", "yyyy-MM-dd").alias("day"), "measure")


def p5_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rolling_totals(table(spark, sf_dir, "daily_snapshots"))
    out = [F.col("entity").alias("project"), F.date_format("day", "yyyy-MM-dd").alias("day")]
    for p in (7, 30):
        out += [F.col(f"tokens_saved_{p}d").cast("long").alias(f"tokens_{p}d"), F.round(F.col(f"tokens_saved_{p}d").cast("double") / p, 6).alias(f"tokens_avg_{p}d")]
        out += [(F.col(f"llm_cost_{p}d") * 10000).cast("long").alias(f"cost_e4_{p}d"), F.round(F.col(f"llm_cost_{p}d").cast("double") / p, 6).alias(f"cost_avg_{p}d")]
    return rows.select(*out)


QUERIES = {f.__name__: f for f in (p1_found, p1_features, p2_found, p2_history, p2_attributes, p3_found, p5_found, p5_rolling)}

_TRIM = r"lower(regexp_replace({c}, '^\s+|\s+$', '', 'g'))"
_EVENTS = rf"""
WITH parsed AS (
  SELECT id, event_id, {_TRIM.format(c="project")} AS project, replace({_TRIM.format(c="type")}, '-', '_') AS event_type,
         coalesce(tokens_saved, 0) AS tokens,
         CASE WHEN regexp_matches(trim(ts), '^\d{{4}}-\d{{2}}-\d{{2}}([T ]\d{{2}}:\d{{2}}(:\d{{2}}([.]\d{{1,9}})?)?( ?(Z|[+-]\d{{2}}:?\d{{2}}))?)?$') THEN
           try_cast(substr(trim(ts), 1, 10) || regexp_replace(substr(trim(ts), 11), ' ?(Z|[+-]\d{{2}}:?\d{{2}})$', '') AS timestamp)
           - to_minutes(coalesce(try_cast(regexp_extract(substr(trim(ts), 11), '([+-]\d{{2}}):?\d{{2}}$', 1) AS INT) * 60
                                 + try_cast(regexp_extract(substr(trim(ts), 11), '([+-])\d{{2}}:?(\d{{2}})$', 1) || regexp_extract(substr(trim(ts), 11), '[+-]\d{{2}}:?(\d{{2}})$', 1) AS INT), 0)) END AS moment
  FROM events_archive),
ranked AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY id) AS r FROM parsed),
features AS (
  SELECT project, event_type, count(*) AS n_events, sum(tokens)::BIGINT AS tokens_saved, max(moment) AS last_at
  FROM ranked WHERE (event_id IS NULL OR r = 1) AND moment <= TIMESTAMP '{AS_OF}' AND project IS NOT NULL AND event_type IS NOT NULL
  GROUP BY ALL)
"""


def _json(col: str) -> str:
    return f"coalesce((SELECT string_agg(fullkey || ':' || type || ':' || coalesce(atom::VARCHAR, ''), '|' ORDER BY fullkey) FROM json_tree(CASE WHEN json_valid({col}) THEN {col} END)), 'text:' || {col})"


def _spelled(v: str) -> str:
    return f"CASE json_type({v}) WHEN 'VARCHAR' THEN to_json({v}->>'$')::VARCHAR WHEN 'DOUBLE' THEN CASE WHEN {v}::DOUBLE = floor({v}::DOUBLE) THEN {v}::DOUBLE::HUGEINT::VARCHAR ELSE {v}::DOUBLE::VARCHAR END WHEN 'NULL' THEN 'null' ELSE {v}::VARCHAR END"


def _canonical(col: str) -> str:
    """The canonical spelling of JSON objects of plain values and lists of them, as
    `json_text.canonical` writes it."""
    items = f"string_agg(to_json(key)::VARCHAR || ':' || CASE WHEN json_type(value) = 'ARRAY' THEN '[' || array_to_string([{_spelled('x')} FOR x IN value::JSON[]], ',') || ']' ELSE {_spelled('value')} END, ',' ORDER BY key)"
    return f"CASE WHEN {col} IS NULL THEN NULL WHEN NOT json_valid({col}) THEN chr(0) || {col} WHEN json_type({col}) = 'OBJECT' THEN '{{' || coalesce((SELECT {items} FROM json_each({col})), '') || '}}' ELSE json({col})::VARCHAR END"


_SEQUENCE = """
WITH status AS (SELECT *, row_number() OVER (PARTITION BY project, snapshot_id ORDER BY id DESC) AS r FROM graph_snapshots WHERE project IS NOT NULL AND snapshot_id IS NOT NULL),
seq AS (
  SELECT project, snapshot_id, valid_from, row_number() OVER w AS seq, lead(snapshot_id) OVER w AS next_id, lag(snapshot_id) OVER w AS previous_id
  FROM status WHERE r = 1 AND status = 'ready' WINDOW w AS (PARTITION BY project ORDER BY valid_from NULLS FIRST, id))
"""
_ATTRIBUTES = ("entity_class", "name", "qualified_name", "normalized_signature", "structural_context", "props")
_WRITES = f"""{_SEQUENCE},
ranked AS (
  SELECT e.project, semantic_id, seq.seq, seq.snapshot_id, seq.valid_from AS moment, e.valid_to IS NOT NULL AS closing,
         entity_class, name, qualified_name, normalized_signature, structural_context, properties_json,
         row_number() OVER (PARTITION BY e.project, semantic_id, seq.seq ORDER BY updated_at DESC NULLS LAST, e.id DESC) AS r
  FROM semantic_entities e JOIN seq ON e.project = seq.project AND e.last_seen_snapshot = seq.snapshot_id WHERE semantic_id IS NOT NULL),
writes AS (SELECT *, {_json("properties_json")} AS props, {_canonical("properties_json")} AS spelled FROM ranked WHERE r = 1),
marked AS (
  SELECT *, coalesce(lag(closing) OVER w, true) AS shut,
         {", ".join(f"{a} IS DISTINCT FROM lag({a}) OVER w AS d_{a}" for a in _ATTRIBUTES)}
  FROM writes WINDOW w AS (PARTITION BY project, semantic_id ORDER BY seq))
"""
_VERSIONS = f"""{_WRITES},
bounds AS (SELECT * FROM marked WHERE CASE WHEN closing THEN NOT shut ELSE shut OR {" OR ".join(f"d_{a}" for a in _ATTRIBUTES)} END),
versions AS (
  SELECT *, lead(snapshot_id) OVER w AS end_snapshot, lead(moment) OVER w AS valid_to
  FROM bounds WINDOW w AS (PARTITION BY project, semantic_id ORDER BY seq))
"""
_LOGGED = " UNION ALL ".join(f"SELECT project, semantic_id, seq, snapshot_id, '{a}' AS attribute, {a} AS value, closing FROM marked WHERE CASE WHEN closing THEN NOT shut ELSE shut OR d_{a} END" for a in _ATTRIBUTES[:-1])
_LOGGED += " UNION ALL SELECT project, semantic_id, seq, snapshot_id, 'properties_json', spelled, closing FROM marked WHERE CASE WHEN closing THEN NOT shut ELSE shut OR d_props END"
_ROLLING = """
WITH parsed AS (SELECT project, try_cast(substr(date, 1, 10) AS date) AS day, written_at, coalesce(tokens_saved, 0)::BIGINT AS tokens, coalesce(round(llm_cost * 10000), 0)::BIGINT AS cost FROM daily_snapshots WHERE regexp_matches(substr(date, 1, 10), '^\\d{4}-\\d{2}-\\d{2}$') AND project IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY project, day ORDER BY written_at DESC NULLS LAST, tokens DESC, cost DESC) AS r FROM parsed WHERE day IS NOT NULL),
counted AS (SELECT project, day, tokens, cost FROM ranked WHERE r = 1),
calendar AS (SELECT project, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM counted GROUP BY project),
dense AS (SELECT project, day, coalesce(tokens, 0) AS tokens, coalesce(cost, 0) AS cost FROM calendar LEFT JOIN counted USING (project, day)),
rolled AS (
  SELECT project, strftime(day, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY project ORDER BY day) AS n,
         sum(tokens) OVER s AS t7, sum(tokens) OVER l AS t30, sum(cost) OVER s AS c7, sum(cost) OVER l AS c30
  FROM dense WINDOW s AS (PARTITION BY project ORDER BY day ROWS 6 PRECEDING), l AS (PARTITION BY project ORDER BY day ROWS 29 PRECEDING))
"""

ORACLES = {
    "p1_found": f"{_EVENTS} SELECT project, event_type FROM features WHERE n_events >= {LAPSED_EVENTS} AND tokens_saved >= {LAPSED_TOKENS} AND last_at < TIMESTAMP '{LAPSED_BEFORE}'",
    "p1_features": f"{_EVENTS} SELECT project, event_type, n_events, tokens_saved, CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_at)) / 1000000) AS BIGINT) AS age_s FROM features",
    "p2_found": f"{_VERSIONS} SELECT project, semantic_id, snapshot_id AS start_snapshot, coalesce(end_snapshot, '') AS end_snapshot FROM versions WHERE NOT closing",
    "p2_history": f"{_VERSIONS} SELECT project, semantic_id, entity_class, name, qualified_name, normalized_signature, structural_context, spelled AS properties_json, snapshot_id AS first_seen_snapshot, end_snapshot, strftime(moment, '%Y-%m-%d %H:%M:%S.%f') AS valid_from, strftime(valid_to, '%Y-%m-%d %H:%M:%S.%f') AS valid_to FROM versions WHERE NOT closing",
    "p2_attributes": f"{_WRITES}, logged AS ({_LOGGED}), ended AS (SELECT *, lead(snapshot_id) OVER (PARTITION BY project, semantic_id, attribute ORDER BY seq) AS end_snapshot FROM logged) SELECT project, semantic_id, attribute, value, snapshot_id AS start_snapshot, end_snapshot FROM ended WHERE NOT closing",
    "p3_found": f"""{_SEQUENCE},
ranked AS (SELECT n.*, seq.seq, seq.next_id, seq.previous_id, row_number() OVER (PARTITION BY n.project, n.snapshot_id, qualified_name ORDER BY n.id DESC NULLS LAST) AS r FROM nodes n JOIN seq ON n.project = seq.project AND n.snapshot_id = seq.snapshot_id WHERE qualified_name IS NOT NULL),
present AS (SELECT *, {_json("coalesce(properties, '{}')")} AS props FROM ranked WHERE r = 1)
SELECT b.project, b.snapshot_id, b.qualified_name, CASE WHEN a.id IS NULL THEN 'added' ELSE 'changed' END AS change
FROM present b LEFT JOIN present a ON a.project = b.project AND a.qualified_name = b.qualified_name AND a.seq = b.seq - 1
WHERE b.seq > 1 AND (a.id IS NULL OR (a.kind, a.name, a.file_path, a.is_exported, a.is_test, a.is_entry_point, a.props) IS DISTINCT FROM (b.kind, b.name, b.file_path, b.is_exported, b.is_test, b.is_entry_point, b.props))
UNION ALL
SELECT a.project, a.next_id, a.qualified_name, 'removed' FROM present a
WHERE a.next_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM present b WHERE b.project = a.project AND b.qualified_name = a.qualified_name AND b.seq = a.seq + 1)""",
    "p5_found": f"{_ROLLING} SELECT project, day, 'tokens_saved' AS measure FROM rolled WHERE n >= 30 AND t7 * 30 > t30 * 14 UNION ALL SELECT project, day, 'llm_cost' FROM rolled WHERE n >= 30 AND c7 * 30 > c30 * 14",
    "p5_rolling": f"{_ROLLING} SELECT project, day, t7::BIGINT AS tokens_7d, round(t7 / 7.0::DOUBLE, 6) AS tokens_avg_7d, c7::BIGINT AS cost_e4_7d, round((c7 / 10000::DOUBLE) / 7, 6) AS cost_avg_7d, t30::BIGINT AS tokens_30d, round(t30 / 30.0::DOUBLE, 6) AS tokens_avg_30d, c30::BIGINT AS cost_e4_30d, round((c30 / 10000::DOUBLE) / 30, 6) AS cost_avg_30d FROM rolled",
}
