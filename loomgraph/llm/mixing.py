"""Mixing sources to target weights (problem 7).

Method: iterative proportional fitting. Token sizes are summed into cells of source, language
and topic; for each mixture the cells' weights are raked until the source margins equal the
wanted shares of the total, while the margins of language and topic stay those of the
mixture's documents. The cap is part of the raking: no cell's weight passes its size times
max_repeats, and what a cell can't take goes to the cells of its margin that still can. A
source whose cells all end at the cap and still weigh less than wanted is short. Documents are
then sampled with the calibrated number of copies.

Sampling is systematic: the documents of a mixture's source are put into blocks of about
BLOCK_DOCS by size, longest first, with bounds from exact counts of the sizes. Each block is
walked in that order, and a document gets the further copy where this brings the tokens taken
so far nearer to the calibrated tokens so far. Short documents come last and settle what long
ones leave over, so what is taken of a source lies within half a document's tokens of what is
wanted in each block, and mostly within those of its shortest documents. The bounds depend on
the documents only, not on the cluster, and so do the documents drawn.

Only cell sums are raked: their number is bounded by the mixture's sources times primary
language tags times TOPICS, however many documents there are. A source that holds a third of
all documents is summed before any shuffle and spread over blocks by size when sampled; documents
of one size that are more than a block are spread by hash.

Defined cases: sources are compared trimmed and in lower case; several targets of a mixture
for one source count as one with the sum of weights and the greatest max_repeats. Null or
negative weights are 0, a null max_repeats is 1. Targets without mixture or source, and
documents without source, are left out. Null and empty texts have 0 tokens. A source without
documents reaches 0. A mixture whose weights sum to 0 has shares of 0. Where the cap makes
margins of language or topic impossible, they come as near as the sources allow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.times import tidy_name
from loomgraph.llm.bpe import count_tokens
from loomgraph.llm.top_n import run_starts
from loomgraph.session import bounded_join, written

TOPICS, SWEEPS, TOLERANCE = 64, 200, 1e-10
CELL = ["source", "lang", "topic"]
#: Fractions of a copy are kept as integers of this unit; documents of a block.
ONE, BLOCK_DOCS = 1 << 24, 1 << 22
_BLOCK = ["mix_name", "source", "block", "sub"]


def targets_of(mixtures: DataFrame) -> DataFrame:
    """(mix_name, source, weight, share, max_repeats) with one row per source of a mixture."""
    rows = mixtures.select("mix_name", tidy_name(F.col("source")).alias("source"), F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"), F.greatest(F.coalesce(F.col("max_repeats").cast("long"), F.lit(1)), F.lit(0)).alias("max_repeats"))
    return rows.where("mix_name is not null and source is not null").groupBy("mix_name", "source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))


def sized_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, tokens): `lang` is the primary tag ('und' where there is
    none of two or three letters), `topic` the directory of the file path, hashed to TOPICS."""
    tag = F.regexp_extract(F.lower(F.trim(F.coalesce("lang", F.lit("")))), r"^([a-z]{2,3})([-_].*)?$", 1)
    folder = F.regexp_extract(F.coalesce("file_path", F.lit("")), r"^(.*)/[^/]*$", 1)
    rows = docs.select("doc_id", tidy_name(F.col("source")).alias("source"), F.when(tag == "", "und").otherwise(tag).alias("lang"), F.pmod(F.xxhash64(folder), F.lit(TOPICS)).cast("int").alias("topic"), "text")
    return count_tokens(rows.where("source is not null"), path=path)


def _bounded(weight: np.ndarray, by: np.ndarray, to: np.ndarray, most: np.ndarray) -> np.ndarray:
    """`weight` scaled so that its sums by `by` are `to`, each at most `most`: what is cut off is
    spread over the cells of the same sum that have room."""
    now = np.bincount(by, weight, len(to))
    weight = np.minimum(weight * np.divide(to, now, out=np.zeros(len(to)), where=now > 0)[by], most)
    for _ in range(len(weight)):
        lost = to - np.bincount(by, weight, len(to))
        room = np.bincount(by, np.where(weight < most, weight, 0.0), len(to))
        if not ((lost > TOLERANCE * to) & (room > 0)).any():
            break
        more = 1 + np.divide(np.maximum(lost, 0.0), room, out=np.zeros(len(to)), where=room > 0)
        weight = np.where(weight < most, np.minimum(weight * more[by], most), weight)
    return weight


def rake(size: np.ndarray, source: np.ndarray, wanted: np.ndarray, margins: list[np.ndarray], cap: np.ndarray | None = None) -> np.ndarray:
    """Weights of the cells, at most `cap` (of each source) times their size, whose sums by
    `source` are `wanted`, or all that the cap allows, and by each of `margins` in proportion
    to those of `size`. Source comes last in a sweep, so its margins are exact."""
    most = np.full(len(size), np.inf) if cap is None else cap[source] * size
    have = np.bincount(source, size, len(wanted))
    goal = np.where(have > 0, wanted, 0.0)
    if cap is not None:
        goal = np.minimum(goal, cap * have)
    if not goal.sum():
        return np.zeros(len(size))
    kept = [np.bincount(m, size) / size.sum() * goal.sum() for m in margins]
    weight = np.minimum(size.astype(float), most)
    for _ in range(SWEEPS):
        before = weight
        for m, to in zip(margins, kept):
            weight = _bounded(weight, m, to, most)
        weight = _bounded(weight, source, goal, most)
        if np.abs(weight - before).max() <= TOLERANCE * goal.sum():
            break
    return weight


def fill(size: np.ndarray, weight: np.ndarray, cap: float, wanted: float) -> np.ndarray:
    """Copies of the cells of one source, in proportion to weight / size but at most `cap`,
    that make up `wanted`, or all that `cap` allows."""
    most = cap * size
    if wanted >= most.sum():
        return np.where(size > 0, cap, 0.0)
    ratio = np.divide(weight, size, out=np.zeros(len(size)), where=size > 0)
    low, high = 0.0, 1.0
    while (np.minimum(high * ratio, cap) * size).sum() < wanted and high < 2.0**200:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if (np.minimum(middle * ratio, cap) * size).sum() < wanted else (low, middle)
    return np.minimum(high * ratio, cap)


def _calibrated(cells: pd.DataFrame) -> pd.DataFrame:
    size = cells["tokens"].to_numpy(float)
    source, names = pd.factorize(cells["source"])
    weight = cells.groupby(source)["weight"].first().to_numpy(float)
    cap = cells.groupby(source)["max_repeats"].first().to_numpy(float)
    have = np.bincount(source, size, len(names))
    share = weight / weight.sum() if weight.sum() else np.zeros(len(names))
    wanted = share * have.sum()
    margins = [pd.factorize(cells[c].fillna(-1 if c == "topic" else ""))[0] for c in ("lang", "topic")]
    raked = rake(size, source, wanted, margins, cap)
    copies = np.zeros(len(size))
    for s in range(len(names)):  # what the raking leaves to rounding is settled within the source
        at = source == s
        copies[at] = fill(size[at], raked[at], cap[s], wanted[s])
    filled = np.bincount(source, copies * size, len(names))
    room = np.bincount(source, (copies < cap[source]) & (size > 0), len(names)) > 0
    short = ~room & (filled < wanted) & (have * cap < wanted)  # the last is free of rounding
    return pd.DataFrame({"mix_name": cells["mix_name"], "source": cells["source"], "lang": cells["lang"], "topic": cells["topic"], "tokens": cells["tokens"], "copies": copies, "share": share[source], "wanted": wanted[source], "max_repeats": cap[source], "short": short[source]})


CALIBRATED = "mix_name string, source string, lang string, topic int, tokens long, copies double, share double, wanted double, max_repeats double, short boolean"


def calibrate(sized: DataFrame, mixtures: DataFrame) -> DataFrame:
    """One row per mixture and cell with the calibrated `copies`, the source's `share` and
    `wanted` tokens, and whether the source is `short`: all its repeats make up less."""
    cells = sized.groupBy(*CELL).agg(F.sum("tokens").alias("tokens"))
    joined = targets_of(mixtures).join(cells, "source", "left").select("mix_name", "source", "lang", "topic", F.coalesce("tokens", F.lit(0)).alias("tokens"), "weight", "max_repeats")
    return joined.groupBy("mix_name").applyInPandas(_calibrated, CALIBRATED)


def short_sources(docs: DataFrame, mixtures: DataFrame, path: str | None = None) -> DataFrame:
    """(mix_name, source) of the sources that can't reach their share."""
    return calibrate(sized_documents(docs, path), mixtures).where("short").select("mix_name", "source").distinct()


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group, tail, left = _BLOCK, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        new = set(run_starts(batch, group)[1:].tolist())
        if tail != tuple(batch.column(g)[0].as_py() for g in group):
            left = 0
        further = []
        for i, (tokens, part) in enumerate(zip(batch.column("tokens").to_pylist(), batch.column("part").to_pylist())):
            if i in new:
                left = 0
            left += tokens * part
            taken = 2 * left >= tokens * ONE if tokens else 2 * part >= ONE
            left -= taken * tokens * ONE
            further.append(int(taken))
        tail = tuple(batch.column(g)[batch.num_rows - 1].as_py() for g in group)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(further, pa.int64())], names=[*batch.schema.names, "further"])


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows with the `block` and `sub` they are drawn in. One list of bounds a target is broadcast,
    with an entry for BLOCK_DOCS documents."""
    by = ["mix_name", "source"]
    larger = Window.partitionBy(*by).orderBy(F.col("tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*by, "tokens").agg(F.count("*").alias("n")).withColumn("at", F.floor(F.coalesce(F.sum("n").over(larger), F.lit(0)) / BLOCK_DOCS))
    blocks = sizes.groupBy(*by, "at").agg(F.min("tokens").alias("least"), F.ceil(F.sum("n") / BLOCK_DOCS).alias("parts"))
    bounds = blocks.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("least", "parts")), False).alias("bounds"))
    placed = rows.join(F.broadcast(bounds), by).withColumn("block", F.size(F.filter("bounds", lambda b: b["least"] > F.col("tokens"))))
    return placed.withColumn("sub", F.pmod(F.xxhash64("doc_id", "mix_name"), F.element_at("bounds", F.col("block") + 1)["parts"])).drop("bounds")


def select_documents(sized: DataFrame, calibrated: DataFrame) -> DataFrame:
    """(mix_name, doc_id, source, lang, topic, tokens, copies): the documents of each mixture. Of
    equally long documents a hash of mixture and document decides the order, so every run takes
    the same ones."""
    cells = calibrated.where("copies > 0").select("mix_name", *CELL, F.floor("copies").alias("copies"), F.round((F.col("copies") - F.floor("copies")) * ONE).cast("long").alias("part"))
    rows = bounded_join(sized, cells, CELL).select("mix_name", "doc_id", *CELL, "tokens", "copies", "part")
    placed = _in_blocks(rows.where("part > 0"))
    order = [*_BLOCK, F.col("tokens").desc(), F.xxhash64("mix_name", "doc_id"), "doc_id", "lang", "topic"]
    in_order = placed.repartition(*_BLOCK).sortWithinPartitions(*order)
    schema = T.StructType([*placed.schema.fields, T.StructField("further", T.LongType())])
    drawn = written(in_order.mapInArrow(_drawn, schema), "drawn")
    out = rows.where("part = 0").unionByName(drawn.withColumn("copies", F.col("copies") + F.col("further")).select(rows.columns))
    return out.where("copies > 0").drop("part")


def shares_reached(sized: DataFrame, calibrated: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per mixture and source the wanted and reached tokens and shares, and the tokens of the
    source's largest document: `reached` is nearer to `wanted` than that, unless the source is short."""
    reached = chosen.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    wanted = calibrated.groupBy("mix_name", "source").agg(F.sum("tokens").alias("size"), F.max("share").alias("share"), F.max("wanted").alias("wanted"), F.max("max_repeats").cast("long").alias("max_repeats"), F.bool_or("short").alias("short"))
    totals = reached.groupBy("mix_name").agg(F.sum("reached").alias("all"))
    zero = F.lit(0).cast("long")
    report = wanted.join(sized.groupBy("source").agg(F.max("tokens").alias("largest")), "source", "left").join(reached, ["mix_name", "source"], "left").join(totals, "mix_name", "left")
    return report.select("mix_name", "source", "size", F.coalesce("largest", zero).alias("largest"), F.round("share", 9).alias("share"), F.round("wanted", 3).alias("wanted"), "max_repeats", "short", F.coalesce("documents", zero).alias("documents"), F.coalesce("most_copies", zero).alias("most_copies"), F.coalesce("reached", zero).alias("reached"), F.round(F.coalesce(F.col("reached") / F.col("all"), F.lit(0.0)), 9).alias("reached_share"))


def margins_reached(calibrated: DataFrame, chosen: DataFrame) -> DataFrame:
    """(mix_name, dimension, value, wanted_share, calibrated_share, reached_share) of languages and
    topics: their shares of the mixture's documents, after raking, and of the tokens taken."""
    ways = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in ("lang", "topic")))
    by = ["mix_name", "dimension", "value"]

    def share(rows: DataFrame, tokens, name: str) -> DataFrame:
        sums = rows.where("lang is not null").select("mix_name", tokens.alias("t"), F.explode(ways).alias("w")).groupBy("mix_name", "w.dimension", "w.value").agg(F.sum("t").alias("t"))
        all_of = sums.groupBy("mix_name", "dimension").agg(F.sum("t").alias("all"))
        return sums.join(all_of, ["mix_name", "dimension"]).select(*by, F.coalesce(F.try_divide("t", "all"), F.lit(0.0)).alias(name))

    wanted = share(calibrated, F.col("tokens"), "wanted_share")
    raked = share(calibrated, F.col("tokens") * F.col("copies"), "calibrated_share")
    taken = share(chosen, F.col("tokens") * F.col("copies"), "reached_share")
    return wanted.join(raked, by, "left").join(taken, by, "left").select(*by, *(F.round(F.coalesce(c, F.lit(0.0)), 9).alias(c) for c in ("wanted_share", "calibrated_share", "reached_share")))


def mix_sized(sized: DataFrame, mixtures: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(selection, shares, margins) of documents whose tokens are counted."""
    calibrated = written(calibrate(sized, mixtures), "calibrated")
    chosen = select_documents(sized, calibrated)
    return chosen, shares_reached(sized, calibrated, chosen), margins_reached(calibrated, chosen)


def mix(docs: DataFrame, mixtures: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection, report): the documents taken, and per mixture and source the wanted and
    reached tokens and shares."""
    return mix_sized(written(sized_documents(docs, path), "sized"), mixtures)[:2]
