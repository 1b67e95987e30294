"""Full history of changing entity attributes, from periodic writes (problem 2).

Method: an event-sourced change log per attribute, from which each attribute gets its own
intervals; the versions of an entity come from splitting at the union of all attributes'
boundaries and coalescing equal neighbours.

Rows are shuffled once, by entity: repeated writes of a snapshot are dropped within each task
before that, so an entity that holds a third of all rows sends at most one row per task and
snapshot; log, intervals, split and coalescing run in that partitioning. An entity then has at
most one write per snapshot of its project.

Defined cases: writes with a null project, entity or snapshot, or of a snapshot outside the
sequence, don't count. Of several writes of an entity in one snapshot the newest updated_at
(null oldest), then the largest id, counts. Null equals null; the JSON attribute is compared
as a value, invalid JSON as plain text. Closing writes of an entity that isn't open, empty
tables and further columns do nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from loomgraph.operators.snapshots import last_of_runs, ready_sequence
from loomgraph.session import bounded_join

ATTRIBUTES = ("entity_class", "name", "qualified_name", "normalized_signature", "structural_context", "properties_json")
ENTITY = ["project", "semantic_id"]


def _in_entity() -> WindowSpec:
    return Window.partitionBy(*ENTITY).orderBy("seq")


def effective_writes(writes: DataFrame, sequence: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES, json_attributes: tuple[str, ...] = ("properties_json",)) -> DataFrame:
    """(project, semantic_id, seq, snapshot, at, closing, attributes) of the writes that count."""
    rows = writes.where("semantic_id is not null").select(*ENTITY, F.col("last_seen_snapshot").alias("snapshot_id"), "id", "updated_at", F.col("valid_to").isNotNull().alias("closing"), *attributes)
    placed = bounded_join(rows, sequence.select("project", "snapshot_id", "seq", F.col("valid_from").alias("at")), ["project", "snapshot_id"])
    key = (*ENTITY, "seq")
    once = last_of_runs(key, tuple(a for a in attributes if a in json_attributes))
    in_task = placed.sortWithinPartitions(*key, F.col("updated_at").asc_nulls_first(), F.col("id").asc_nulls_first()).mapInArrow(once, placed.schema)
    newest = Window.partitionBy(*key).orderBy(F.col("updated_at").desc_nulls_last(), F.col("id").desc_nulls_last())
    # Python goes before the shuffle: after it, what it returns would be shuffled again
    kept = in_task.repartition(*ENTITY).withColumn("rank", F.row_number().over(newest)).where("rank = 1")
    return kept.select(*key, F.col("snapshot_id").alias("snapshot"), "at", "closing", *attributes)


def attribute_log(writes: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """(project, semantic_id, seq, snapshot, at, attribute, opens, closes, value): a row where
    an attribute begins an interval (`value`, wrapped so that null is a value) or, `closes`,
    where its last interval ends."""
    before = F.lag("closing").over(_in_entity())
    opens = ~F.col("closing") & F.coalesce(before, F.lit(True))
    closes = F.col("closing") & ~F.coalesce(before, F.lit(True))
    marked = writes.select("*", opens.alias("opens"), closes.alias("closes"), *(F.lag(a).over(_in_entity()).alias(f"_{a}") for a in attributes))

    def event(a: str) -> Column:
        begins = F.col("opens") | (~F.col("closing") & ~F.col(a).eqNullSafe(F.col(f"_{a}")))
        return F.when(begins | F.col("closes"), F.struct(F.lit(a).alias("attribute"), F.when(begins, F.struct(F.col(a).alias("v"))).alias("value")))

    events = F.filter(F.array(*(event(a) for a in attributes)), lambda e: e.isNotNull())
    return marked.select(*ENTITY, "seq", "snapshot", "at", "opens", "closes", F.explode(events).alias("e")).select(*ENTITY, "seq", "snapshot", "at", "e.attribute", "opens", "closes", "e.value")


def attribute_intervals(log: DataFrame) -> DataFrame:
    """Each attribute's own intervals: value, start and end (null while it holds) as snapshot,
    time and number in the sequence."""
    own = Window.partitionBy(*ENTITY, "attribute").orderBy("seq")
    rows = log.select("*", *(F.lead(c).over(own).alias(f"end_{c}") for c in ("snapshot", "at", "seq")))
    return rows.where("value is not null").select(*ENTITY, "attribute", F.col("value.v").alias("value"), *(F.col(c).alias(f"start_{c}") for c in ("snapshot", "at", "seq")), "end_snapshot", "end_at", "end_seq")


def combine(intervals: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """Versions: the intervals of all attributes split at the union of their boundaries, each
    piece with the value every attribute has in it, equal neighbours coalesced. A piece in which
    no attribute holds is no version and ends the one before it."""
    ends = F.array(*(F.struct(F.col(f"{end}_seq").alias("seq"), F.col(f"{end}_snapshot").alias("snapshot"), F.col(f"{end}_at").alias("at"), F.lit(end == "start").alias("starts")) for end in ("start", "end")))
    marks = intervals.select(*ENTITY, "attribute", "value", F.explode(ends).alias("e")).where("e.seq is not null").select(*ENTITY, "attribute", "value", "e.*")
    # at a boundary an attribute has a new value (held in a struct), or ends (an empty struct), or goes on (null)
    value = lambda a: F.max(F.when(F.col("attribute") == a, F.struct(F.when(F.col("starts"), F.struct(F.col("value").alias("v"))).alias("held")))).alias(a)
    at_boundary = marks.groupBy(*ENTITY, "seq").agg(F.first("snapshot").alias("snapshot"), F.first("at").alias("at"), *(value(a) for a in attributes))
    so_far = _in_entity().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    split = at_boundary.select(*ENTITY, "seq", "snapshot", "at", *(F.last(a, ignorenulls=True).over(so_far)["held"].alias(a) for a in attributes))
    same = F.lit(True)
    for a in attributes:
        same = same & F.col(a).eqNullSafe(F.lag(a).over(_in_entity()))
    pieces = split.select("*", (same & F.lag("seq").over(_in_entity()).isNotNull()).alias("same")).where("not same")
    ended = pieces.select("*", F.lead("snapshot").over(_in_entity()).alias("end_snapshot"), F.lead("at").over(_in_entity()).alias("end_at"))
    holds = F.coalesce(*(F.when(F.col(a).isNotNull(), F.lit(True)) for a in attributes), F.lit(False))
    return ended.where(holds).select(*ENTITY, *(F.col(f"{a}.v").alias(a) for a in attributes), F.col("snapshot").alias("start_snapshot"), "end_snapshot", F.col("at").alias("valid_from"), F.col("end_at").alias("valid_to"))


def entity_history(entities: DataFrame, snapshots: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """(project, semantic_id, attributes, start_snapshot, end_snapshot, valid_from, valid_to):
    every version of every entity; the end is null while the version is open."""
    log = attribute_log(effective_writes(entities, ready_sequence(snapshots), attributes), attributes)
    return combine(attribute_intervals(log), attributes)
