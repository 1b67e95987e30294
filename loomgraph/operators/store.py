"""Merging new rows into stored nodes, edges and findings, as whole-table plans.

Ids are kept for keys already stored; new keys get ids after the greatest stored one. Numbers
are given per partition from the counts of the partitions before it, so no task sees all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import written

NODE_KEY = ["project", "qualified_name"]
EDGE_KEY = ["project", "source_id", "target_id", "type", "properties"]


def last_writes(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows with one key the one with the greatest `order`."""
    newest = Window.partitionBy(*key).orderBy(F.col(order).desc_nulls_last())
    return rows.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def numbered(rows: DataFrame, after: DataFrame, name: str = "id") -> DataFrame:
    """Rows with consecutive ids that follow the greatest id of `after` (a frame with id)."""
    kept = written(rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "numbered")
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", "_first", before.alias("_before"))  # a row per partition
    top = after.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    placed = kept.join(F.broadcast(offsets), "_part").join(F.broadcast(top))
    return placed.withColumn(name, F.col("_top") + F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_part", "_at", "_first", "_before", "_top", "_n")


def upsert_nodes(stored: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Stored nodes with the incoming ones (no id) merged by project and qualified name: the last
    write of a key wins and keeps the stored id."""
    columns = [c for c in stored.columns if c != "id"]
    fresh = last_writes(incoming, NODE_KEY, order).select(*columns)
    known = fresh.join(stored.select("id", *NODE_KEY), NODE_KEY).select("id", *columns)
    new = numbered(fresh.join(stored.select(*NODE_KEY), NODE_KEY, "left_anti"), stored).select("id", *columns)
    kept = stored.join(fresh.select(*NODE_KEY), NODE_KEY, "left_anti").select("id", *columns)
    return kept.unionByName(known).unionByName(new)


def upsert_edges(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored edges and the incoming ones that aren't there; edges that differ in a property are
    different edges. Properties must be canonical JSON."""
    columns = [c for c in stored.columns if c != "id"]
    fresh = incoming.select(*columns).dropDuplicates(EDGE_KEY)
    same = [fresh[c].eqNullSafe(stored[c]) for c in EDGE_KEY]
    new = fresh.join(stored, (fresh["source_id"] == stored["source_id"]) & (fresh["target_id"] == stored["target_id"]) & same[0] & same[3] & same[4], "left_anti")
    return stored.select("id", *columns).unionByName(numbered(new, stored).select("id", *columns))


def delete_files(nodes: DataFrame, edges: DataFrame, evidence: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, evidence) without the nodes of the files (file_path) and all that hangs on
    them."""
    kept = nodes.join(files.select("file_path").distinct(), "file_path", "left_anti").select(*nodes.columns)
    gone = nodes.join(files.select("file_path").distinct(), "file_path", "left_semi").select("id")
    left = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti").select(*edges.columns)
    return kept, left, evidence.join(left.select(F.col("id").alias("edge_id")), "edge_id", "left_semi").select(*evidence.columns)


def compare_runs(runs: DataFrame) -> DataFrame:
    """Per project the last run against the one before it: differences, the change of the average
    complexity to two places (half up), and whether the two are comparable (same mode)."""
    last = Window.partitionBy("project").orderBy(F.col("run_at").desc(), F.col("id").desc())
    before = lambda c: F.lead(c).over(last)
    rows = runs.select("project", "run_at", "mode", "total_nodes", "total_edges", "avg_complexity", F.row_number().over(last).alias("_rank"), before("total_nodes").alias("n"), before("total_edges").alias("e"), before("avg_complexity").alias("a"), before("mode").alias("m"))
    change = F.floor((F.col("avg_complexity") - F.col("a")) * 100 + 0.5) / 100
    return rows.where("_rank = 1").select("project", "run_at", (F.col("total_nodes") - F.col("n")).alias("nodes_delta"), (F.col("total_edges") - F.col("e")).alias("edges_delta"), change.alias("complexity_delta"), F.coalesce(F.col("mode") == F.col("m"), F.lit(False)).alias("comparable"))
