"""Records added, removed or changed between consecutive full snapshots (problem 3).

Method: keys are mapped to ordinals that stay the same through all snapshots; for each
snapshot a compressed bitmap holds the ordinals present and column vectors, aligned to the
ordinals, hold fingerprints of the compared columns. AND-NOT of consecutive bitmaps gives
additions and removals; among the ordinals of their AND the vectors expose the changes.

Keys are spread over BUCKETS by hash, whatever the number of tasks, and numbered within their
bucket. Ordinals persist: `key_ordinals` gives them as a table to keep, in which the next
delivery's new keys follow the known ones, and `snapshot_changes` takes that table. Without
one, keys are numbered in their order while they are streamed, as `key_ordinals` would.

Repeated rows of a key are dropped within each task first, so a key that holds a third of all
rows sends at most one row per task and snapshot. Rows are then shuffled once, by bucket, with
64-bit fingerprints in place of the compared columns; each task streams its sorted keys in
blocks, so memory doesn't grow with a project. A project that holds a third of all rows is
spread over all buckets by its keys.

Defined cases: the sequence is that of `ready_sequence`; a snapshot without rows is an empty
graph; rows of other snapshots and rows with a null project, snapshot or qualified_name don't
count. Of rows with one key the largest id (null least) counts. Null compares as null,
``properties`` as a JSON value with null as ``{}`` and invalid JSON as plain text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.bitmaps import Bitmap
from loomgraph.functions.json_text import canonical_json
from loomgraph.operators.snapshots import differs, flat, last_of_runs, ready_sequence
from loomgraph.session import bounded_join

COMPARED = ("kind", "name", "file_path", "is_exported", "is_test", "is_entry_point", "properties")
OUT = "project string, snapshot_id string, qualified_name string, change string, columns string"
#: Buckets of keys: many more than tasks. Ordinals hold only together with this number.
BUCKETS = 1 << 14
#: Rows gathered before a block is diffed; a block ends between keys.
BLOCK_ROWS = 100_000


def placed_nodes(nodes: DataFrame, sequence: DataFrame, compared: tuple[str, ...] = COMPARED) -> DataFrame:
    """Node rows of snapshots in the sequence, with a fingerprint for each compared column."""
    rows = nodes.where("qualified_name is not null").select("project", "snapshot_id", "qualified_name", "id", *compared)
    placed = bounded_join(rows, sequence.select("project", "snapshot_id", "seq", "next_id"), ["project", "snapshot_id"])
    prints = [F.xxhash64(F.lit(i), canonical_json(F.col(c), "{}") if c == "properties" else F.col(c)).alias(f"f{i}") for i, c in enumerate(compared)]
    return placed.select("project", "qualified_name", "seq", F.coalesce("id", F.lit(-(2**62))).alias("id"), "snapshot_id", "next_id", *prints)


def _bucket() -> Column:
    return F.pmod(F.xxhash64("project", "qualified_name"), F.lit(BUCKETS)).cast("int").alias("bucket")


def key_ordinals(nodes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(project, qualified_name, bucket, ordinal) of all keys of `known`, an earlier such table,
    and of `nodes`: known keys keep their ordinals, new ones follow in order of the key."""
    key = ["project", "qualified_name"]
    keys = nodes.where("project is not null and qualified_name is not null").select(*key).distinct()
    in_bucket = Window.partitionBy("bucket").orderBy(*key)
    if known is None:
        return keys.select(*key, _bucket()).withColumn("ordinal", (F.row_number().over(in_bucket) - 1).cast("long"))
    used = known.groupBy("bucket").agg((F.max("ordinal") + 1).alias("used"))
    new = keys.join(known.select(*key), key, "left_anti").select(*key, _bucket()).join(used, "bucket", "left")
    return known.select(*key, "bucket", "ordinal").unionByName(new.select(*key, "bucket", (F.coalesce("used", F.lit(0)) + F.row_number().over(in_bucket) - 1).cast("long").alias("ordinal")))


def _diff_block(block: pa.Table, compared: tuple[str, ...]) -> pa.Table:
    """What differs in a block of whole keys of one bucket, sorted by ordinal, seq and id."""
    project, name = flat(block["project"]), flat(block["qualified_name"])
    seq = block["seq"].to_numpy().astype(np.int64)
    ordinal = block["ordinal"].to_numpy()
    last = np.concatenate([(np.diff(ordinal) != 0) | (np.diff(seq) != 0), [True]])  # sorted by id: the largest counts
    at = np.flatnonzero(last)
    prints = np.stack([block[f"f{i}"].to_numpy() for i in range(len(compared))])[:, at]
    ordinal, seq = ordinal[at], seq[at]
    first = int(ordinal[0])
    keys = int(ordinal[-1]) + 1 - first
    order = np.argsort(seq, kind="stable")
    numbers, starts = np.unique(seq[order], return_index=True)
    rows_of = {int(n): order[a:b] for n, a, b in zip(numbers, starts, [*starts[1:], len(order)])}
    none = np.empty(0, np.int64)
    place = {}  # of a snapshot: ordinal -> row, the column vectors' alignment
    out: list[tuple[np.ndarray, str, bool]] = []
    columns: list[np.ndarray] = []
    for n in sorted({m for s in rows_of for m in (s, s + 1)}):
        now_rows, old_rows = rows_of.get(n, none), rows_of.get(n - 1, none)
        now, old = Bitmap.of(ordinal[now_rows]), Bitmap.of(ordinal[old_rows])
        for m, rows in ((n, now_rows), (n - 1, old_rows)):
            if m not in place:
                place[m] = np.full(keys, -1, np.int64)
                place[m][ordinal[rows] - first] = rows
        place.pop(n - 2, None)
        if n > 1:
            out.append((place[n][now.and_not(old).ordinals() - first], "added", False))
        out.append((place[n - 1][old.and_not(now).ordinals() - first], "removed", True))
        both = (now & old).ordinals() - first
        a, b = place[n][both], place[n - 1][both]
        differ = prints[:, a] != prints[:, b]
        hit = differ.any(axis=0)
        out.append((a[hit], "changed", False))
        columns.append(differ[:, hit])
    batches = []
    mask = iter(columns)
    for rows, change, next_snapshot in out:
        took = pa.array(at[rows])
        which = next(mask) if change == "changed" else None
        names = [""] * len(rows) if which is None else [",".join(c for c, d in zip(compared, flags) if d) for flags in which.T]
        batches.append(pa.table({"project": project.take(took), "snapshot_id": flat(block["next_id" if next_snapshot else "snapshot_id"]).take(took), "qualified_name": name.take(took), "change": pa.array([change] * len(rows), pa.string()), "columns": pa.array(names, pa.string())}))
    found = pa.concat_tables(batches)
    found = found.filter(pc.is_valid(found["snapshot_id"]))  # the last snapshot of a project has no next
    return found.combine_chunks()


def _numbered(table: pa.Table, last: tuple | None) -> pa.Table:
    """A table sorted by bucket and key with ordinals, counted on from `last`: (bucket, project,
    name, ordinal) of the row before it."""
    bucket, project, name = (flat(table[c]) for c in ("bucket", "project", "qualified_name"))
    numbers = bucket.to_numpy()
    turn = np.concatenate([[last is None or last[0] != numbers[0]], np.diff(numbers) != 0])
    new = np.concatenate([[bool(turn[0]) or last[1:3] != (project[0].as_py(), name[0].as_py())], differs(project) | differs(name)]) | turn
    count = np.cumsum(new)
    start = np.flatnonzero(turn)
    before = np.zeros(len(new), np.int64)
    if len(start):
        before[start[0] :] = np.repeat(count[start], np.diff([*start, len(new)]))
    head = int(start[0]) if len(start) else len(new)
    ordinal = count - before
    ordinal[:head] = count[:head] + (last[3] if last else 0)
    return table.append_column("ordinal", pa.array(ordinal))


def _diff(compared: tuple[str, ...], numbered: bool):
    """Blocks of whole keys; a new bucket begins a new block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if not numbered:
                table = _numbered(table, last)
                end = {c: table[c][-1].as_py() for c in ("bucket", "project", "qualified_name", "ordinal")}
                last = tuple(end.values())
            held += table.combine_chunks().to_batches()
            rows += batch.num_rows
            if rows < BLOCK_ROWS:
                continue
            table = pa.Table.from_batches(held)
            new = np.flatnonzero(differs(flat(table["bucket"])) | differs(flat(table["ordinal"])))
            if not len(new):
                continue  # one key fills the block; it has at most a row per write of a snapshot
            cut = int(new[-1]) + 1
            yield from _diff_buckets(table.slice(0, cut), compared)
            rest = table.slice(cut).combine_chunks()
            held, rows = rest.to_batches(), rest.num_rows
        if rows:
            yield from _diff_buckets(pa.Table.from_batches(held), compared)

    return run


def _diff_buckets(table: pa.Table, compared: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Diffs the buckets of a block at once: the ordinals of each are moved as a whole behind
    those of the one before it, as far as the block has them."""
    bucket, ordinal = table["bucket"].to_numpy(), table["ordinal"].to_numpy()
    start = np.flatnonzero(np.concatenate([[True], np.diff(bucket) != 0]))
    end = np.append(start[1:], len(bucket))
    low, high = ordinal[start], ordinal[end - 1]
    begin = np.cumsum(high + 1 - low) - (high + 1 - low)
    moved = ordinal + np.repeat(begin + low[0] - low, end - start)
    yield from _diff_block(table.set_column(table.column_names.index("ordinal"), "ordinal", pa.array(moved)), compared).to_batches()


def snapshot_changes(nodes: DataFrame, snapshots: DataFrame, compared: tuple[str, ...] = COMPARED, ordinals: DataFrame | None = None) -> DataFrame:
    """(project, snapshot_id, qualified_name, change, columns): what differs in each snapshot
    from the one before it; `columns` names the changed columns. `ordinals` is a table of
    `key_ordinals` that has all keys."""
    placed = placed_nodes(nodes, ready_sequence(snapshots), compared)
    key = ["project", "qualified_name"]
    once = placed.sortWithinPartitions(*key, "seq", "id").mapInArrow(last_of_runs((*key, "seq")), placed.schema)
    if ordinals is None:
        by_key = once.select("*", _bucket()).repartition("bucket").sortWithinPartitions("bucket", *key, "seq", "id")
    else:
        by_key = once.join(ordinals.select(*key, "bucket", "ordinal"), key).repartition("bucket").sortWithinPartitions("bucket", "ordinal", "seq", "id")
    return by_key.mapInArrow(_diff(compared, ordinals is not None), OUT)
