"""Totals over trailing periods for every entity and calendar day (problem 5).

Method: rows are reduced to one per entity and day, made dense by crossing each entity with
its own calendar (first to last day, never entities with entities), and summed by window over
a fixed number of preceding rows.

Defined cases: the day is the first ten characters of the date text; rows without a valid day
or entity are left out. Of several rows of a day the newest written_at counts (null oldest;
equal times by the largest values). Null measures and missing days are 0. llm_cost is an
exact decimal of four places. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Exact types of the measures; sums keep them.
MEASURES = {"tokens_saved": "decimal(20,0)", "llm_cost": "decimal(20,4)"}


def daily(rows: DataFrame, measures: dict[str, str] = MEASURES, entity: str = "project", since: str | None = None, until: str | None = None) -> DataFrame:
    """(entity, day, measures): the row that counts for each entity and day, of the days from
    `since` to `until` where these are given."""
    text = F.substring("date", 1, 10)
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))
    values = [F.coalesce(F.col(m).try_cast(t), F.lit(0).cast(t)).alias(m) for m, t in measures.items()]
    placed = rows.select(F.col(entity).alias("entity"), day.alias("day"), "written_at", *values).where("day is not null and entity is not null")
    for bound, test in ((since, F.col("day") >= F.lit(since).cast("date")), (until, F.col("day") <= F.lit(until).cast("date"))):
        placed = placed.where(test) if bound else placed
    newest = placed.groupBy("entity", "day").agg(F.max(F.struct("written_at", *measures)).alias("r"))
    return newest.select("entity", "day", *(F.col(f"r.{m}").alias(m) for m in measures))


def rolling_totals(rows: DataFrame, periods: tuple[int, ...] = (7, 30), measures: dict[str, str] = MEASURES, entity: str = "project", since: str | None = None, until: str | None = None) -> DataFrame:
    """(entity, day, day_number, <measure>_<period>d ...): sums over the `period` days ending
    each day, for all days from the entity's first (day_number 1) to its last. One stray date far off makes a row for
    every day between; `since` and `until` leave such dates out."""
    counted = daily(rows, measures, entity, since, until)
    calendar = counted.groupBy("entity").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("entity", F.explode(F.sequence("a", "b")).alias("day"))
    dense = calendar.join(counted, ["entity", "day"], "left").fillna(0, list(measures))
    by_day = Window.partitionBy("entity").orderBy("day")
    sums = [F.sum(m).over(by_day.rowsBetween(1 - p, 0)).cast(t).alias(f"{m}_{p}d") for m, t in measures.items() for p in periods]
    return dense.select("entity", "day", F.row_number().over(by_day).alias("day_number"), *measures, *sums)


def bursts(totals: DataFrame, short: int = 7, long: int = 30, factor: int = 2, measures: dict[str, str] = MEASURES) -> DataFrame:
    """(entity, day, measure) where the average over the short period exceeds `factor` times
    that over the long one, for days with a whole long period. Compared without division."""
    hit = F.filter(
        F.array(*(F.when(F.col(f"{m}_{short}d") * F.lit(long) > F.col(f"{m}_{long}d") * F.lit(factor * short), F.lit(m)) for m in measures)),
        lambda m: m.isNotNull(),
    )
    return totals.where(F.col("day_number") >= long).select("entity", "day", F.explode(hit).alias("measure"))
