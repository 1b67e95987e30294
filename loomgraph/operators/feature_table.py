"""One wide row of features per entity, from events (problem 1).

Method: events are bucketed and sorted by entity and type, runs of equal (entity, type)
are streamed into counters, and the wide rows leave the same task, without another
shuffle. Each task first streams its own sorted events into partial counters, so an
entity that holds a third of all events sends at most one row per task and type.

Defined cases: entity and type are compared trimmed and in lower case, in the type also
with ``_`` for ``-``; rows with a null entity or type don't count. Rows with one event id
are one event, that of the smallest ``id`` (null ids last); a row without event id is an
event. Events whose time isn't a time or lies after the as-of time don't count. Null
totals are 0. An empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.times import micros_of, micros_of_text, tidy_name

RUN_SCHEMA = "entity string, kind string, n long, total long, latest long"
WIDE_SCHEMA = "entity string, features map<string, struct<n: long, total: long, latest: long>>"
_COLUMNS = ["n", "total", "latest"]


def distinct_events(events: DataFrame, *, entity: str, kind: str, ts: str, total: str, event_id: str, order: str) -> DataFrame:
    """(entity, kind, n, total, latest) with n = 1 for each distinct event; time not yet judged."""
    rows = events.select(
        tidy_name(F.col(entity)).alias("entity"),
        F.replace(tidy_name(F.col(kind)), F.lit("-"), F.lit("_")).alias("kind"),
        F.lit(1).cast("long").alias("n"),
        F.coalesce(F.col(total).cast("long"), F.lit(0)).alias("total"),
        micros_of_text(F.col(ts)).alias("latest"),
        F.col(event_id).alias("event_id"),
        F.col(order).alias("ord"),
    )
    # rows without an event id need no shuffle; the rank's group limit drops most copies of a hot id before it
    first = Window.partitionBy("event_id").orderBy(F.col("ord").asc_nulls_last())
    known = rows.where("event_id is not null").withColumn("rank", F.row_number().over(first)).where("rank = 1")
    return known.select("entity", "kind", *_COLUMNS).unionByName(rows.where("event_id is null").select("entity", "kind", *_COLUMNS))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, np.ndarray]]:
    """Merged runs of sorted batches: entities, kinds and [n, total, latest] per run. The last
    run of a batch is held back, for the next batch may continue it."""
    held: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        entity, kind = batch.column("entity"), batch.column("kind")
        values = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in _COLUMNS]
        same = [pc.equal(keys.slice(1), keys.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False) for keys in (entity, kind)]
        new = np.concatenate([[True], ~(same[0].astype(bool) & same[1].astype(bool))])
        start = np.flatnonzero(new)
        entities, kinds = entity.take(pa.array(start)).to_pylist(), kind.take(pa.array(start)).to_pylist()
        merged = np.stack([np.add.reduceat(values[0], start), np.add.reduceat(values[1], start), np.maximum.reduceat(values[2], start)])
        if held:
            if (held[0], held[1]) == (entities[0], kinds[0]):
                merged[:2, 0] += held[2][:2]
                merged[2, 0] = max(merged[2, 0], held[2][2])
            else:
                yield [held[0]], [held[1]], held[2].reshape(3, 1)
        held = (entities[-1], kinds[-1], merged[:, -1].copy())
        if len(start) > 1:
            yield entities[:-1], kinds[:-1], merged[:, :-1]
    if held:
        yield [held[0]], [held[1]], held[2].reshape(3, 1)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for entities, kinds, merged in _runs(batches):
        yield pa.RecordBatch.from_arrays([pa.array(entities, pa.string()), pa.array(kinds, pa.string()), *(pa.array(m) for m in merged)], names=["entity", "kind", *_COLUMNS])


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("entity", pa.string()), ("features", pa.map_(pa.string(), pa.struct([(c, pa.int64()) for c in _COLUMNS])))])
    entity, features, out = None, [], []
    for entities, kinds, merged in _runs(batches):
        for e, k, n, total, latest in zip(entities, kinds, *merged.tolist()):
            if e != entity and features:
                out.append({"entity": entity, "features": features})
                features = []
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
            entity = e
            features.append((k, {"n": n, "total": total, "latest": latest}))
    if features:
        out.append({"entity": entity, "features": features})
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def feature_table(
    events: DataFrame, as_of: str, *, entity: str = "project", kind: str = "type", ts: str = "ts", total: str = "tokens_saved", event_id: str = "event_id", order: str = "id"
) -> DataFrame:
    """(entity, features): one row per entity; `features` maps each event type to the number
    of distinct events `n`, their `total` and the `latest` time in microseconds."""
    counted = distinct_events(events, entity=entity, kind=kind, ts=ts, total=total, event_id=event_id, order=order).where((F.col("latest") <= micros_of(as_of)) & F.col("entity").isNotNull() & F.col("kind").isNotNull())
    partial = counted.sortWithinPartitions("entity", "kind").mapInArrow(_partial, RUN_SCHEMA)
    return partial.repartition("entity").sortWithinPartitions("entity", "kind").mapInArrow(_wide, WIDE_SCHEMA)


def feature_columns(wide: DataFrame, kinds: list[str]) -> DataFrame:
    """The wide row as flat columns ``<kind>__n``, ``__total``, ``__latest`` for the given types."""
    cell = {k: F.col("features")[k] for k in kinds}
    return wide.select("entity", *(F.coalesce(cell[k][c], F.lit(0)).alias(f"{k}__{c}") if c != "latest" else cell[k][c].alias(f"{k}__{c}") for k in kinds for c in _COLUMNS))


def features_long(wide: DataFrame, as_of: str) -> DataFrame:
    """(entity, kind, n, total, latest, age_us) of each feature of the wide rows."""
    rows = wide.select("entity", F.explode("features").alias("kind", "v"))
    return rows.select("entity", "kind", "v.n", "v.total", "v.latest", (F.lit(micros_of(as_of)) - F.col("v.latest")).alias("age_us"))
