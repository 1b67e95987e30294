"""The N first items of every group under one total order (problem 4).

Method: one global range-partitioned sort on group, score and identifier; the counts of each
group per partition are prefix-summed into exact positions, and positions up to N are kept.

A group that holds a third of all rows spans many range partitions: each keeps at most N of
it while streaming, so no task sees a whole group. What is kept is written to the shared
folder once, for a range sort isn't repeated identically. In a range sort only the last run of
a partition can continue, and only as the first run of later ones, so the prefix sums need
those two runs of each partition (the proven size of the broadcast side), not all groups.

Defined cases: nulls of a score sort last, null group columns are groups of their own, ties
go to the identifier, ascending by code point. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.session import written


def run_starts(batch: pa.RecordBatch, group: list[str]) -> np.ndarray:
    """Where runs of equal group columns (null equals null) begin in a sorted batch that has rows."""
    same = np.ones(batch.num_rows - 1, bool)
    for g in group:
        a, b = batch.column(g).slice(1), batch.column(g).slice(0, batch.num_rows - 1)
        equal = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False).astype(bool)
        both_null = pc.and_(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False).astype(bool)
        same &= equal | both_null
    return np.flatnonzero(np.concatenate([[True], ~same]))


def running_sums(batches: Iterator[pa.RecordBatch], group: list[str], of) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, sum of `of(batch)` so far in the row's run, whether the run is the partition's
    first) of the sorted batches of a partition."""
    tail, total, first_run = None, 0, True
    for batch in batches:
        if not batch.num_rows:
            continue
        start = run_starts(batch, group)
        lengths = np.diff([*start, batch.num_rows])
        sums = np.cumsum(of(batch))
        before = np.where(start > 0, sums[start - 1], 0)
        sums = sums - np.repeat(before, lengths)
        head = tuple(batch.column(g)[0].as_py() for g in group)
        if tail == head:
            sums[: lengths[0]] += total
        elif tail is not None:
            first_run = False
        in_first = np.zeros(batch.num_rows, bool)
        in_first[: lengths[0]] = first_run
        if len(start) > 1:
            first_run = False
        tail, total = tuple(batch.column(g)[batch.num_rows - 1].as_py() for g in group), int(sums[-1])
        yield batch, sums, in_first


def _local_positions(group: list[str], n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = 0
        for batch, position, in_first in running_sums(batches, group, lambda b: np.ones(b.num_rows, np.int64)):
            keep = pa.array(np.flatnonzero(position <= n))
            kept = batch.take(keep)
            number = pa.array(np.arange(rows, rows + len(keep)))
            rows += len(keep)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(position).take(keep), pa.array(in_first).take(keep), number], names=[*kept.schema.names, "_local", "_first", "_row"])

    return run


def offsets(kept: DataFrame, group: list[str], local: str = "_local") -> DataFrame:
    """(_part, _before): what the partitions before it add to the `local` running sums of a
    partition's first run. Of each partition one row with its first and last run enters the
    prefix sums; `_row` numbers a partition's rows."""
    of_run = F.struct(*group, F.col(local).alias("_sum"))
    ends = kept.groupBy("_part").agg(F.min_by(of_run, "_row").alias("_head"), F.max_by(of_run, "_row").alias("_tail"))
    head, tail = (ends.select("_part", F.lit(k).alias("_end"), *(F.col(f"{side}.{g}").alias(g) for g in group), total.alias("_sum")) for k, side, total in ((0, "_head", F.lit(0).cast("long")), (1, "_tail", F.col("_tail._sum"))))
    earlier = Window.partitionBy(*group).orderBy("_part", "_end").rowsBetween(Window.unboundedPreceding, -1)
    summed = head.unionByName(tail).select("_part", "_end", F.sum("_sum").over(earlier).alias("_before"))
    return summed.where("_end = 0 and _before > 0").select("_part", "_before")


def top_n(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The rows at positions 1 to `n` of each group, with their `position`. `order` must be
    total within a group (end it with an identifier). `rows` has no columns named _local,
    _first, _row, _part or position."""
    spark = rows.sparkSession
    width = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(g) for g in group]
    schema = T.StructType([*rows.schema.fields, T.StructField("_local", T.LongType()), T.StructField("_first", T.BooleanType()), T.StructField("_row", T.LongType())])
    ranged = rows.repartitionByRange(width, *keys, *order).sortWithinPartitions(*keys, *order)
    kept = written(ranged.mapInArrow(_local_positions(group, n), schema).withColumn("_part", F.spark_partition_id()), "top-n")
    placed = kept.join(F.broadcast(offsets(kept, group)), "_part", "left")
    position = F.col("_local") + F.when(F.col("_first"), F.coalesce("_before", F.lit(0))).otherwise(0)
    return placed.withColumn("position", position).where(F.col("position") <= n).drop("_local", "_first", "_row", "_part", "_before")


def latest_measurements(rows: DataFrame) -> DataFrame:
    """Hotspot rows with `path` (``/`` for a backslash, no leading ``./``), of each (project,
    path, qualified_name) the newest measured_at (null oldest), then the largest hotspot_id.
    Rows with a null or empty path are left out; null names are one name."""
    path = F.regexp_replace(F.replace("file_path", F.lit("\\"), F.lit("/")), r"^\./", "")
    placed = rows.select("project", path.alias("path"), "qualified_name", "measured_at", "hotspot_id", "complexity", "fan_in").where("path <> ''")
    newest = placed.groupBy("project", "path", "qualified_name").agg(F.max(F.struct("measured_at", "hotspot_id", "complexity", "fan_in")).alias("r"))
    return newest.select("project", "path", "qualified_name", "r.hotspot_id", "r.complexity", "r.fan_in")


def worst_functions(rows: DataFrame, n: int = 5) -> DataFrame:
    """The `n` worst functions of each file by complexity, then fan_in, then name."""
    order = [F.col("complexity").desc_nulls_last(), F.col("fan_in").desc_nulls_last(), F.col("qualified_name").asc_nulls_first()]
    return top_n(latest_measurements(rows), ["project", "path"], order, n)
