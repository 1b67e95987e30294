"""The sequence of ready snapshots of each project, shared by problems 2 and 3."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.json_text import canonical_all


def ready_sequence(snapshots: DataFrame) -> DataFrame:
    """(project, snapshot_id, seq, valid_from, next_id): a snapshot has the status and
    valid_from of its row with the largest id; `seq` numbers the ready ones of a project from
    1 by valid_from (nulls first), then id; `next_id` is the following snapshot, null at the
    last. Rows with a null project or snapshot_id name no snapshot and are left out."""
    key = ["project", "snapshot_id"]
    rows = snapshots.select(*key, "id", "status", "valid_from").where("project is not null and snapshot_id is not null")
    latest = rows.groupBy(*key).agg(F.max(F.struct("id", "status", "valid_from")).alias("r"))
    ready = latest.where("r.status = 'ready'").select(*key, "r.valid_from", F.col("r.id").alias("id"))
    order = Window.partitionBy("project").orderBy(F.col("valid_from").asc_nulls_first(), "id")
    return ready.select(*key, F.row_number().over(order).alias("seq"), "valid_from", F.lead("snapshot_id").over(order).alias("next_id"))


def differs(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it; the first has none before it."""
    return pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False).astype(bool)


def flat(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks)


def last_of_runs(keys: tuple[str, ...], json_columns: tuple[str, ...] = ()) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows sorted by the keys (never null): the last row of each run of
    equal keys in the task, so that repeats are dropped before a shuffle. The last row of a
    batch waits for the next batch. JSON columns of the rows kept get their canonical texts."""

    def spelled(batch: pa.RecordBatch) -> pa.RecordBatch:
        for c in json_columns:
            texts = pa.array(canonical_all(batch.column(c).to_pylist()), batch.schema.field(c).type)
            batch = batch.set_column(batch.schema.get_field_index(c), c, texts)
        return batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks()
            last = np.logical_or.reduce([differs(flat(table[k])) for k in keys])
            yield from map(spelled, table.take(pa.array(np.flatnonzero(last))).combine_chunks().to_batches())
            held = table.slice(table.num_rows - 1).combine_chunks().to_batches()[0]
        if held is not None:
            yield spelled(held)

    return run
