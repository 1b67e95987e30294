"""Queries of problems 4 and 6 to 8 and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.bpe import encode_corpus
from loomgraph.llm.mixing import mix_sized, short_sources, sized_documents
from loomgraph.llm.shared_spans import LENGTH, shared_share, shared_spans
from loomgraph.llm.top_n import worst_functions
from loomgraph.session import exists, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worst_functions(_table(spark, sf_dir, "hotspot_rows")).select("hotspot_id")


def p4_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = worst_functions(_table(spark, sf_dir, "hotspot_rows"))
    return rows.select("project", "path", "position", "hotspot_id", "qualified_name", "complexity", "fan_in")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return short_sources(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mixture_targets"))


_SIZED: dict[tuple[str, str], DataFrame] = {}


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token sizes of the documents, written once per application and input: the selection
    and its reports read one encoding. p7_found encodes by itself."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SIZED or not all(exists(spark, f) for f in _SIZED[key].inputFiles()[:1]):
        _SIZED[key] = written(sized_documents(_table(spark, sf_dir, "documents")), "sized")
    return _SIZED[key]


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sized(_sized(spark, sf_dir), _table(spark, sf_dir, "mixture_targets"))[0].select("mix_name", "doc_id", "source", "tokens", "copies")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sized(_sized(spark, sf_dir), _table(spark, sf_dir, "mixture_targets"))[1]


def p7_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sized(_sized(spark, sf_dir), _table(spark, sf_dir, "mixture_targets"))[2]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(_table(spark, sf_dir, "documents"))


def p8_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_share(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p4_found, p4_ranked, p6_ids, p7_found, p7_selection, p7_shares, p7_margins, p8_found, p8_share)}

_PATH = r"regexp_replace(replace(file_path, '\', '/'), '^\./', '')"
_WORST = f"""
WITH rows AS (SELECT *, {_PATH} AS path FROM hotspot_rows),
latest AS (SELECT *, row_number() OVER (PARTITION BY project, path, qualified_name ORDER BY measured_at DESC NULLS LAST, hotspot_id DESC) AS r FROM rows WHERE path <> ''),
placed AS (SELECT *, row_number() OVER (PARTITION BY project, path ORDER BY complexity DESC NULLS LAST, fan_in DESC NULLS LAST, qualified_name NULLS FIRST) AS position FROM latest WHERE r = 1)
"""
_SPANS = f"""
WITH windows AS (SELECT doc_id, i, md5(substr(text, i + 1, {LENGTH})) AS h FROM (SELECT doc_id, text, unnest(range(length(text) - {LENGTH - 1})) AS i FROM documents WHERE length(text) >= {LENGTH})),
repeated AS (SELECT h FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)),
starts AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH}, true) AS new FROM windows SEMI JOIN repeated USING (h)),
numbered AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS stretch FROM starts),
spans AS (SELECT doc_id, min(i)::BIGINT AS start_at, (max(i) + {LENGTH})::BIGINT AS end_at FROM numbered GROUP BY doc_id, stretch)
"""

ORACLES = {
    "p4_found": f"{_WORST} SELECT hotspot_id FROM placed WHERE position <= 5",
    "p4_ranked": f"{_WORST} SELECT project, path, position, hotspot_id, qualified_name, complexity, fan_in FROM placed WHERE position <= 5",
    "p8_found": f"{_SPANS} SELECT doc_id, start_at, end_at FROM spans",
    "p8_share": f"""{_SPANS}, total AS (SELECT doc_id, count(*) AS stretches, sum(end_at - start_at)::BIGINT AS shared FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(length(text), 0)::BIGINT AS chars, coalesce(stretches, 0)::BIGINT AS stretches, coalesce(shared, 0)::BIGINT AS shared,
       CASE WHEN length(text) > 0 THEN round(coalesce(shared, 0) / length(text)::DOUBLE, 6) ELSE 0 END AS share
FROM documents d LEFT JOIN total USING (doc_id)""",
}
