"""Usage events: idempotent archive, rollups, look-back windows, attribution, sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.times import micros_of, micros_of_text, tidy_name

DAY_US = 86_400_000_000
# The category of each type of event, and of an observation by the tool it hints
# at; any other is 'other'.
CATEGORY_OF_TYPE = {
    "architecture_overview": "architecture_overview",
    "search_graph": "direct_discovery",
    "search_code": "direct_discovery",
    "semantic_search": "direct_discovery",
    "trace_path": "smart_navigation",
    "get_code_snippet": "smart_navigation",
    "batch_get_code": "smart_navigation",
    "pack_context": "context_packing",
    "explain_symbol": "impact_analysis",
    "smart_review": "impact_analysis",
    "find_tests": "impact_analysis",
    "llm_rerank": "llm_rerank",
    "hook_augment": "hook_augment",
    "tool_observation": "other",
}
CATEGORY_OF_HINT = {
    "investigate_symbol": "smart_navigation",
    "get_edge_evidence": "smart_navigation",
    "detect_changes": "impact_analysis",
    "assess_impact": "impact_analysis",
    "analyze_hotspots": "impact_analysis",
    "find_dead_code": "impact_analysis",
    "pack_memory": "context_packing",
    "get_graph_schema": "context_packing",
    "compare_runs": "impact_analysis",
    "index_repository": "project_operations",
    "index_status": "project_operations",
    "ingest_traces": "project_operations",
    "watch_project": "project_operations",
    "manage_adr": "project_operations",
    "delete_project": "project_operations",
    "auto_index": "project_operations",
}


def archive(events: DataFrame) -> DataFrame:
    """Events that happened, each once: names tidied, `at` in microseconds, of one event_id the
    row with the smallest id; events without a time are left out."""
    first = Window.partitionBy("event_id").orderBy(F.col("id").asc_nulls_last())
    known = events.where("event_id is not null").withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")
    rows = known.unionByName(events.where("event_id is null"))
    kind = F.replace(tidy_name(F.col("type")), F.lit("-"), F.lit("_"))
    out = rows.withColumns({"project": tidy_name(F.col("project")), "type": kind, "at": micros_of_text(F.col("ts"))}).where("at is not null")
    return out.withColumns({"tool": F.split_part("type", F.lit("."), F.lit(1)), "day": F.date_from_unix_date(F.floor(F.col("at") / DAY_US).cast("int")).cast("string")})


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the code points, as eight hex digits."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))
    hashed = F.aggregate(points, F.lit(2166136261).cast("long"), lambda h, p: (h.bitwiseXOR(p.cast("long")) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))
    return F.lpad(F.lower(F.hex(hashed)), 8, "0")


def _identity(project: str = "project", ts: str = "ts", kind: str = "type") -> list[Column]:
    """The six values that tell events without an event_id apart."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    return [F.coalesce(project, F.lit("")), F.coalesce(ts, F.lit("")), F.coalesce(kind, F.lit("")), F.coalesce("query_hash", F.lit("")), zero("files_avoided"), zero("tokens_saved")]


def legacy_key(project: str = "project", ts: str = "ts", kind: str = "type") -> Column:
    """A short label of an event that has no event_id. It has 32 bits, so many events share
    labels: events are told apart by the values themselves."""
    return F.concat(F.lit("legacy:"), fnv1a(F.concat_ws("|", *_identity(project, ts, kind))))


def without_legacy_repeats(events: DataFrame) -> DataFrame:
    """Events without event_id, each once by all six values of its identity (smallest id), with
    their `legacy_key`."""
    rows = events.where("event_id is null").withColumn("legacy_key", legacy_key())
    first = Window.partitionBy(*_identity()).orderBy("id")
    return rows.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def _llm() -> Column:
    return F.coalesce((F.col("llm_provider") != "heuristic") & (F.col("llm_provider") != ""), F.lit(False))


def total(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def cost(c: str = "estimated_llm_cost_usd") -> Column:
    return F.round(F.coalesce(F.sum(F.when(~F.isnan(c), F.col(c))), F.lit(0.0)), 6)


def daily_rollup(events: DataFrame) -> DataFrame:
    """One row per project and day; `unique_files` is the greatest of a single event."""
    return events.groupBy("project", "day").agg(
        total("tokens_saved").alias("tokens_saved"), total("files_avoided").alias("files_avoided"), F.coalesce(F.max("unique_files"), F.lit(0)).alias("unique_files"),
        F.count_if(_llm()).alias("llm_events"), F.count_if(_llm() & (F.col("top_changed") == 1)).alias("llm_top_changed"), cost().alias("llm_cost"),
        F.count("*").alias("events_count"), F.countDistinct(F.nullif("session_id", F.lit(""))).alias("sessions_count"), F.countDistinct(F.nullif("task_id", F.lit(""))).alias("tasks_count"), F.count_if(F.col("deterministic_mode") == 1).alias("deterministic_events"),
    )


def day_flush(events: DataFrame, day: str) -> DataFrame:
    """The rollup of one day as it is flushed: `distinct_files` counts distinct file lists."""
    return events.where(F.col("day") == day).groupBy("project", "day").agg(total("tokens_saved").alias("tokens_saved"), F.countDistinct("files_json").alias("distinct_files"), F.count("*").alias("events_count"))


def category(kind: Column, hint: Column) -> Column:
    """The one category of an event of a type; observations that hint at a tool take the tool's."""
    table = lambda names, key: F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), key)
    observed = F.coalesce((kind == "tool_observation") & (hint != ""), F.lit(False))
    return F.coalesce(F.when(observed, table(CATEGORY_OF_HINT, hint)).otherwise(table(CATEGORY_OF_TYPE, kind)), F.lit("other"))


def look_back(events: DataFrame, now: str, days: dict[str, int | None]) -> DataFrame:
    """(window, category, ...): every event in each window that holds it (both ends count), in
    exactly one category, so that categories add up to the window's total."""
    end = micros_of(now)
    inside = F.filter(F.array(*(F.when(F.lit(True) if n is None else F.col("at") >= end - n * DAY_US, F.lit(name)) for name, n in days.items())), lambda w: w.isNotNull())
    rows = events.where(F.col("at") <= end).select(F.explode(inside).alias("window"), category(F.col("tool"), F.col("tool_hint")).alias("category"), "tokens_saved", "files_avoided")
    found = rows.groupBy("window", "category").agg(total("tokens_saved").alias("tokens_saved"), total("files_avoided").alias("files_avoided"), F.count("*").alias("events"))
    return found.where("events > 0 or tokens_saved > 0")


def llm_breakdown(events: DataFrame) -> DataFrame:
    return events.where(_llm()).groupBy("llm_provider", "llm_model").agg(F.count("*").alias("calls"), cost().alias("cost"), total("llm_latency_ms").alias("latency_ms"))


def savings_by_tool(events: DataFrame) -> DataFrame:
    """(tool, ...) of the events that saved something; the hint names the tool where there is one."""
    saved = events.where("coalesce(tokens_saved, 0) > 0 or coalesce(files_avoided, 0) > 0")
    return saved.groupBy(F.coalesce(F.nullif("tool_hint", F.lit("")), "tool").alias("tool")).agg(F.count("*").alias("events"), total("tokens_saved").alias("tokens_saved"), total("files_avoided").alias("files_avoided"))


def savings_confidence(events: DataFrame) -> DataFrame:
    """Per project: saving and other events and the confidence of the largest saver."""
    saves = F.coalesce(F.col("tokens_saved") > 0, F.lit(False)) | F.coalesce(F.col("files_avoided") > 0, F.lit(False))
    rank = F.struct(F.coalesce("tokens_saved", F.lit(0)), -F.col("id"))
    return events.groupBy("project").agg(F.count_if(saves).alias("saving"), F.count_if(~saves).alias("operational"), F.coalesce(F.max_by("confidence", F.when(saves, rank)), F.lit("medium")).alias("confidence"))


def confidence_pivot(events: DataFrame, levels: tuple[str, ...] = ("high", "medium", "low")) -> DataFrame:
    """Per project the tokens saved at each confidence."""
    return events.groupBy("project").agg(*(F.coalesce(F.sum(F.when(F.col("confidence") == c, F.col("tokens_saved"))), F.lit(0)).cast("long").alias(f"tokens_{c}") for c in levels))


def _histogram(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value, k, to, n): how often each value occurs in a group, how many values don't
    exceed it, and how many there are. No group's values are collected."""
    histogram = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("k"))
    up = Window.partitionBy(by).orderBy(value)
    return histogram.withColumns({"to": F.sum("k").over(up), "n": F.sum("k").over(Window.partitionBy(by))})


def order_statistics(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, upper_median, p95): the values at floor(n/2) and ceil(0.95 n) - 1 in ascending
    order."""
    placed = _histogram(rows, by, value)
    at = lambda i: F.min(F.when(F.col("to") > i, F.col(value)))
    return placed.groupBy(by).agg(F.max("n").alias("n"), at(F.floor(F.col("n") / 2)).alias("upper_median"), at(F.ceil(F.col("n") * 0.95) - 1).alias("p95"))


def nearest_rank(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, p50, p95, most) by nearest rank: the least values that at least the share of a group's
    values don't exceed, from a histogram."""
    placed = _histogram(rows, by, value)
    at = lambda p: F.min(F.when(F.col("to") >= F.ceil(F.col("n") * p), F.col(value)))
    found = placed.groupBy(by).agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.max(value).alias("most"))
    return rows.select(by).distinct().join(found.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def last_two(rows: DataFrame, by: str, order: str, measures: list[str]) -> DataFrame:
    """The last row of each group with the differences from the one before it, null where there
    is none."""
    w = Window.partitionBy(by).orderBy(F.col(order).desc())
    ranked = rows.select(by, order, *measures, F.row_number().over(w).alias("rank"), *((F.col(m) - F.lead(m).over(w)).alias(f"{m}_delta") for m in measures))
    return ranked.where("rank = 1").drop("rank")


def trend(rows: DataFrame, by: list[str], order: str, value: str, step: int = 5, last: int | None = None) -> DataFrame:
    """(by, samples, first, last, trend): improving or worsening by more than `step`, stable, or
    no_data for a single sample. With `last`, over so many of the newest samples only."""
    if last is not None:
        newest = Window.partitionBy(*by).orderBy(F.col(order).desc(), F.col(value).desc())
        known = rows.where(F.col(value).isNotNull() & F.col(order).isNotNull())
        rows = known.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= last).drop("_rank")
    found = rows.where(F.col(value).isNotNull() & F.col(order).isNotNull()).groupBy(*by).agg(F.count("*").alias("samples"), F.min(F.struct(order, value))[value].alias("first"), F.max(F.struct(order, value))[value].alias("last"))
    move = F.col("last") - F.col("first")
    return found.withColumn("trend", F.when(F.col("samples") < 2, "no_data").when(move > step, "worsening").when(move < -step, "improving").otherwise("stable"))


def wilson(wins: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, 0 and 0 for n = 0."""
    p, zz = wins / n, z * z
    middle, spread, scale = p + zz / (n * 2), z * F.sqrt((p * (1 - p) + zz / (n * 4)) / n), 1 + zz / n
    return tuple(F.when(n > 0, F.round((middle + sign * spread) / scale, 6)).otherwise(0.0) for sign in (-1, 1))


def win_rates(events: DataFrame) -> DataFrame:
    """Per project and overall (null project): reranks that changed the top, of all reranks."""
    rows = events.where(_llm() & F.col("top_changed").isNotNull() & F.col("project").isNotNull())
    found = rows.rollup("project").agg(F.count("*").alias("n"), F.count_if(F.col("top_changed") == 1).alias("wins"))
    low, high = wilson(F.col("wins").cast("double"), F.col("n").cast("double"))
    return found.select("project", "n", "wins", low.alias("low"), high.alias("high"))


def arm_savings(runs: DataFrame) -> DataFrame:
    """(project, n, wins, ties, losses, micro, macro, low, high) of runs (project, base, test) of two
    arms, and over all (null project): what the test arm saves as a ratio of sums (micro) and as
    the mean of the projects' ratios (macro), and the interval of its wins among decided runs.
    Runs without either value don't count; a base of 0 has no ratio."""
    c = F.col
    rows = runs.where("project is not null and base is not null and test is not null and not isnan(base) and not isnan(test)")
    per = rows.groupBy("project").agg(F.count("*").alias("n"), F.count_if(c("test") < c("base")).alias("wins"), F.count_if(c("test") == c("base")).alias("ties"), F.sum("base").alias("b"), F.sum("test").alias("t"))
    per = per.withColumn("ratio", F.try_divide(c("b") - c("t"), c("b")))
    found = per.rollup("project").agg(*(F.sum(x).alias(x) for x in ("n", "wins", "ties", "b", "t")), F.avg("ratio").alias("macro"))
    low, high = wilson(c("wins").cast("double"), (c("n") - c("ties")).cast("double"))
    return found.where("n is not null").select("project", "n", "wins", "ties", (c("n") - c("wins") - c("ties")).alias("losses"), F.round(F.try_divide(c("b") - c("t"), c("b")), 6).alias("micro"), F.round("macro", 6).alias("macro"), low.alias("low"), high.alias("high"))


def set_scores(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """One row of precision, recall and f1 of two sets; empty against empty is perfect."""
    both = expected.select(key, F.lit(1).alias("e")).distinct().join(actual.select(key, F.lit(1).alias("a")).distinct(), key, "full")
    counted = both.agg(F.count_if(F.col("e").isNotNull() & F.col("a").isNotNull()).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("a").isNull()).alias("fn"))
    rate = lambda miss: F.when(F.col("tp") + F.col(miss) > 0, F.col("tp") / (F.col("tp") + F.col(miss))).otherwise(1.0)
    f1 = F.when(F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(1.0)
    return counted.select("tp", "fp", "fn", F.round(rate("fp"), 6).alias("precision"), F.round(rate("fn"), 6).alias("recall"), F.round(f1, 6).alias("f1"))


def tool_counters(events: DataFrame, tools: list[str]) -> DataFrame:
    """Per day a counter for each tool and the total."""
    return events.groupBy("day").agg(*(F.count_if(F.col("tool") == t).alias(t) for t in tools), F.count("*").alias("total"))


def event_files(events: DataFrame) -> DataFrame:
    """Events with one row per listed file."""
    return events.select("*", F.explode(F.from_json("files_json", "array<string>")).alias("file")).where("file is not null")


def first_seen_ratio(events: DataFrame) -> DataFrame:
    """(id, files, fresh, ratio): the share of an event's distinct files not seen earlier in its
    project and session."""
    files = event_files(events.where("session_id is not null")).select("id", "project", "session_id", "at", "file").distinct()
    first = Window.partitionBy("project", "session_id", "file").orderBy("at", "id")
    marked = files.withColumn("fresh", (F.row_number().over(first) == 1).cast("int"))
    return marked.groupBy("id").agg(F.count("*").alias("files"), F.sum("fresh").alias("fresh"), F.round(F.avg("fresh"), 6).alias("ratio"))


def churn(events: DataFrame, limit: int = 20) -> DataFrame:
    """The files most often listed."""
    return event_files(events).groupBy("file").agg(F.count("*").alias("changes")).orderBy(F.col("changes").desc(), "file").limit(limit)


def activity(events: DataFrame, gap_minutes: int = 30, slice_hours: int = 24) -> DataFrame:
    """(project, session, started, n): runs of a project's events with less than the gap between
    neighbours. Runs are found within slices of time, so a busy project is spread over tasks;
    what crosses a slice's edge is joined over one row per run and slice, of which a gap of half
    an hour leaves at most 48 to a day."""
    gap, width = gap_minutes * 60_000_000, slice_hours * 3_600_000_000
    sliced = events.select("project", "at", F.floor(F.col("at") / width).alias("slice"))
    inside = Window.partitionBy("project", "slice").orderBy("at")
    starts = sliced.withColumn("new", F.coalesce(F.col("at") - F.lag("at").over(inside) >= gap, F.lit(False)).cast("int"))
    parts = starts.withColumn("part", F.sum("new").over(inside)).groupBy("project", "slice", "part").agg(F.min("at").alias("started"), F.max("at").alias("ended"), F.count("*").alias("n"))
    over = Window.partitionBy("project").orderBy("started")
    joined = parts.withColumn("new", F.coalesce(F.col("started") - F.lag("ended").over(over) >= gap, F.lit(True)).cast("int"))
    return joined.withColumn("session", F.sum("new").over(over)).groupBy("project", "session").agg(F.min("started").alias("started"), F.sum("n").alias("n"))


def settled(suggestions: DataFrame, reads: DataFrame, now: str, minutes: int = 2) -> DataFrame:
    """(id, state): a suggestion (id, project, tool, at) is followed by a read (project, tool, at)
    within the minutes, expired, or pending at `now`. The interval is tested within project
    and tool, in slices of the interval's length, so a busy project is spread by time."""
    width = minutes * 60_000_000
    left = suggestions.select("id", "project", "tool", "at", F.explode(F.array(F.floor(F.col("at") / width), F.floor(F.col("at") / width) + 1)).alias("slice"))
    right = reads.select("project", "tool", F.col("at").alias("read_at"), F.floor(F.col("at") / width).alias("slice"))
    hit = left.join(right, ["project", "tool", "slice"]).where((F.col("read_at") >= F.col("at")) & (F.col("read_at") - F.col("at") <= width)).select("id").distinct()
    state = F.when(F.col("hit"), "followed").when(F.col("at") < micros_of(now) - width, "expired").otherwise("pending")
    return suggestions.join(hit.withColumn("hit", F.lit(True)), "id", "left").select("id", state.alias("state"))


def first_rows(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rank = 1").drop("_rank")


def seeded_order(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows with a position in an order that depends on the seed only."""
    return rows.withColumn("draw", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
