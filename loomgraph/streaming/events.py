"""Structured Streaming forms of the event operators. The batch rebuild stays the source of
truth; each of these gives the same rows once its watermark has passed."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomgraph.session import exists


def once(events: DataFrame, watermark: str = "1 hour", key: str = "event_id", at: str = "at") -> DataFrame:
    """Events each once by key; a repeat is recognised within the watermark."""
    return events.withWatermark(at, watermark).dropDuplicatesWithinWatermark([key])


def debounced(changes: DataFrame, gap: str = "500 milliseconds", watermark: str = "1 second") -> DataFrame:
    """(path, started, changes): bursts of changes of one path, closed by a quiet gap."""
    rows = changes.withWatermark("at", watermark).groupBy(F.session_window("at", gap).alias("w"), "path").agg(F.count("*").alias("changes"))
    return rows.select("path", F.col("w.start").alias("started"), "changes")


def daily(events: DataFrame, watermark: str = "1 day", width: str = "1 day") -> DataFrame:
    """(project, started, tokens_saved, events): tumbling totals; "1 hour" counts by hour."""
    rows = events.withWatermark("at", watermark).groupBy(F.window("at", width).alias("w"), "project").agg(F.sum("tokens_saved").alias("tokens_saved"), F.count("*").alias("events"))
    return rows.select("project", F.col("w.start").alias("started"), "tokens_saved", "events")


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """(project, started, events): activity until a gap."""
    rows = events.withWatermark("at", watermark).groupBy(F.session_window("at", gap).alias("w"), "project").agg(F.count("*").alias("events"))
    return rows.select("project", F.col("w.start").alias("started"), "events")


def settled(suggestions: DataFrame, reads: DataFrame, within: str = "2 minutes", watermark: str = "5 minutes") -> DataFrame:
    """Stream-stream left join: suggestions (id, project, tool, at) with the read that follows in
    time, null once none can come."""
    left = suggestions.withWatermark("at", watermark)
    right = reads.select(F.col("project").alias("r_project"), F.col("tool").alias("r_tool"), F.col("at").alias("read_at")).withWatermark("read_at", watermark)
    test = (F.col("project") == F.col("r_project")) & (F.col("tool") == F.col("r_tool")) & (F.col("read_at") >= F.col("at")) & (F.col("read_at") <= F.col("at") + F.expr(f"INTERVAL {within}"))
    return left.join(right, test, "leftOuter").select("id", "project", "tool", "at", "read_at")


def first_seen(events: DataFrame, idle_ms: int = 1_800_000) -> DataFrame:
    """(project, session_id, event_id, files, fresh): per event how many of its files are new to
    the session. A session's files are kept until it has been idle."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = set(state.get[0]) if state.exists else set()
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        out = []
        for event, files in zip(rows["event_id"], rows["files"]):
            mine = {f for f in (files if files is not None else []) if f is not None}
            out.append((*key, event, len(mine), len(mine - seen)))
            seen |= mine
        state.update((sorted(seen),))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["project", "session_id", "event_id", "files", "fresh"])

    schema = "project string, session_id string, event_id string, files long, fresh long"
    return events.groupBy("project", "session_id").applyInPandasWithState(update, schema, "files array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def ingest_traces(traces: DataFrame, nodes: DataFrame, known: DataFrame) -> DataFrame:
    """(source_id, target_id, type) of new edges in a batch of traces (type, from, to): incomplete
    rows, unknown ends and edges already known are left out."""
    kind = F.coalesce(*(F.when(F.col("type") == a, b) for a, b in (("http_call", "HTTP_CALLS"), ("async_call", "ASYNC_CALLS"), ("channel_message", "CHANNEL"))))
    rows = traces.select(kind.alias("kind"), F.col("from"), F.col("to")).where("kind is not null and `from` <> '' and `to` <> ''").distinct()
    named = nodes.groupBy("qualified_name").agg(F.min("id").alias("id"))
    ends = rows.join(named.select(F.col("qualified_name").alias("from"), F.col("id").alias("source_id")), "from").join(named.select(F.col("qualified_name").alias("to"), F.col("id").alias("target_id")), "to")
    return ends.select("source_id", "target_id", F.col("kind").alias("type")).distinct().join(known.select("source_id", "target_id", "type"), ["source_id", "target_id", "type"], "left_anti")


def replace_files(path: str, extract: Callable[[DataFrame], DataFrame], key: str = "file_path") -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that keeps a table of rows per file: the files of a batch replace
    their old rows. Each batch writes version N and then names it in CURRENT, so a repeated
    batch ends in the same state and a reader never sees half of one."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = current_version(spark, path)
        if last is not None and last >= number:
            return
        fresh = extract(batch)
        if last is not None:
            old = spark.read.parquet(f"{path}/v{last}")
            fresh = old.join(batch.select(F.col("path").alias(key)).distinct(), key, "left_anti").select(*fresh.columns).unionByName(fresh)
        fresh.write.mode("overwrite").parquet(f"{path}/v{number}")
        _name(spark, f"{path}/CURRENT", str(number))

    return write


def _name(spark, pointer: str, text: str) -> None:
    """Puts a text into a file that readers see whole: it is written beside it and renamed."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at, beside = jvm.org.apache.hadoop.fs.Path(pointer), jvm.org.apache.hadoop.fs.Path(f"{pointer}.new")
    out = at.getFileSystem(conf).create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf).rename(beside, at, overwrite)


def replace_parts(path: str, extract: Callable[[DataFrame], DataFrame], key: str = "file_path", parts: int = 256) -> Callable[[DataFrame, int], None]:
    """`replace_files` for large tables: rows lie in `parts` by a hash of their file, and a batch
    writes only the parts that its files fall into. CURRENT holds, for each part, the batch that
    wrote it last; `read_parts` reads these."""
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = _parts(spark, path)
        if now["batch"] >= number:
            return
        files = batch.select(F.col("path").alias(key)).distinct()
        touched = sorted(r["part"] for r in files.select(part).distinct().collect())  # at most `parts` numbers
        fresh = extract(batch)
        old = _read(spark, path, {k: now["parts"][str(k)] for k in touched if str(k) in now["parts"]})
        rows = fresh if old is None else old.join(files, key, "left_anti").select(*fresh.columns).unionByName(fresh)
        rows.select("*", part).repartition("part").write.partitionBy("part").mode("overwrite").parquet(f"{path}/b{number}")
        held = {str(k): number for k in touched if exists(spark, f"{path}/b{number}/part={k}")}
        kept = {k: b for k, b in now["parts"].items() if int(k) not in touched}
        _name(spark, f"{path}/CURRENT", json.dumps({"batch": number, "parts": kept | held}))

    return write


def _parts(spark, path: str) -> dict:
    if not exists(spark, f"{path}/CURRENT"):
        return {"batch": -1, "parts": {}}
    return json.loads(spark.read.text(f"{path}/CURRENT").first()[0])


def _read(spark, path: str, parts: dict) -> DataFrame | None:
    return spark.read.parquet(*(f"{path}/b{b}/part={k}" for k, b in parts.items())) if parts else None


def read_parts(spark, path: str) -> DataFrame | None:
    """The table that `replace_parts` keeps, None while it has no rows."""
    return _read(spark, path, _parts(spark, path)["parts"])


def idle_pause(events: DataFrame, idle: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """(project, active_from, paused_at, events): spells in which a project is watched. A spell
    pauses `idle` after its last event, and the next event resumes the watch."""
    rows = events.withWatermark("at", watermark).groupBy(F.session_window("at", idle).alias("w"), "project").agg(F.count("*").alias("events"))
    return rows.select("project", F.col("w.start").alias("active_from"), F.col("w.end").alias("paused_at"), "events")


def current_version(spark, path: str) -> int | None:
    if not exists(spark, f"{path}/CURRENT"):
        return None
    return int(spark.read.text(f"{path}/CURRENT").first()[0])
