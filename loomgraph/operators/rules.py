"""Layering rules, co-occurrence invariants and impact of changes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph_stats import endpoints
from loomgraph.session import bounded_join, written


def glob_regex(glob: str) -> str:
    """A regular expression for a path glob: ``**`` crosses folders (and takes a following
    slash), ``*`` and ``?`` stay within one."""
    out = []
    for piece in re.findall(r"\*\*/?|\*|\?|[^*?]+", glob):
        out.append(".*" if piece.startswith("**") else "[^/]*" if piece == "*" else "[^/]" if piece == "?" else re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", piece))
    return "^" + "".join(out) + "$"


def layer_of(path: Column, layers: dict[str, str]) -> Column:
    """The first declared layer whose glob matches the path, else null."""
    normal = F.replace(path, F.lit("\\"), F.lit("/"))
    cases = (F.when(normal.rlike(glob_regex(g)), F.lit(name)) for name, g in layers.items())
    return F.coalesce(*cases)


def violations(nodes: DataFrame, edges: DataFrame, layers: dict[str, str], forbidden: list[tuple[str, str]], kinds: tuple[str, ...] = ("Function", "Method", "Class", "Interface")) -> DataFrame:
    """Imports from a layer to one it must not use."""
    rows = endpoints(edges.where("type = 'IMPORTS'"), nodes, ["file_path", "kind", "qualified_name"]).where(F.col("target_kind").isin(*kinds))
    placed = rows.withColumns({"source_layer": layer_of(F.col("source_file_path"), layers), "target_layer": layer_of(F.col("target_file_path"), layers)})
    banned = reduce(Column.__or__, ((F.col("source_layer") == a) & (F.col("target_layer") == b) for a, b in forbidden), F.lit(False))
    return placed.where(banned).select("id", "source_id", "target_id", "source_layer", "target_layer")


def callee_pairs(edges: DataFrame, callees: DataFrame, type: str, min_callers: int) -> tuple[DataFrame, DataFrame]:
    """(solo, pairs): distinct callers of each callee, and of each pair of callees of one caller.

    Only callees with enough callers enter the self join on the caller, whose pairs are counted
    in part before the shuffle. A caller of k such callees makes k (k - 1) / 2 rows there."""
    calls = edges.where(F.col("type") == type).select("source_id", "target_id").distinct().join(callees.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    solo = calls.groupBy("target_id").agg(F.count("*").alias("callers")).where(F.col("callers") >= min_callers)
    kept = calls.join(solo.select("target_id"), "target_id", "left_semi")
    a, b = kept.select("source_id", F.col("target_id").alias("a")), kept.select("source_id", F.col("target_id").alias("b"))
    pairs = a.join(b, (a["source_id"] == b["source_id"]) & (F.col("a") < F.col("b"))).groupBy("a", "b").agg(F.count("*").alias("joint")).where(F.col("joint") >= min_callers)
    return solo, pairs


def invariants(nodes: DataFrame, edges: DataFrame, *, type: str = "CALLS", kinds: tuple[str, ...] = ("Function", "Method"), min_callers: int = 3, min_confidence: float = 0.8, forward_only: bool = False) -> DataFrame:
    """(from_id, to_id, callers, joint, confidence): who calls `from` usually calls `to` too.
    Both directions count by themselves; `forward_only` asks that the one from the lesser id
    holds before the other is given."""
    callees = nodes.where(F.col("kind").isin(*kinds) & (F.coalesce("is_test", F.lit(0)) == 0))
    solo, pairs = callee_pairs(edges, callees, type, min_callers)
    n = lambda c, name: solo.select(F.col("target_id").alias(c), F.col("callers").alias(name))
    both = pairs.join(n("a", "na"), "a").join(n("b", "nb"), "b")
    share = lambda c: F.round(F.col("joint") / F.col(c), 3)
    if forward_only:
        both = both.where(share("na") >= min_confidence)
    ways = F.array(F.struct(F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.col("na").alias("callers"), share("na").alias("confidence")), F.struct(F.col("b").alias("from_id"), F.col("a").alias("to_id"), F.col("nb").alias("callers"), share("nb").alias("confidence")))
    rows = both.select("joint", F.explode(ways).alias("w")).select("w.from_id", "w.to_id", "w.callers", "joint", "w.confidence")
    return rows.where(F.col("confidence") >= min_confidence)


def broken_invariants(found: DataFrame, edges: DataFrame, scope: DataFrame, *, type: str = "CALLS", each: int = 10) -> DataFrame:
    """Callers within `scope` (a frame with id) that call `from` but not `to`, at most `each`
    per invariant, lowest ids first."""
    calls = edges.where(F.col("type") == type).select(F.col("source_id").alias("id"), "target_id").distinct()
    inside = calls.join(scope.select("id"), "id", "left_semi")
    with_from = found.select("from_id", "to_id").join(inside.withColumnRenamed("target_id", "from_id"), "from_id")
    missing = with_from.join(inside.withColumnRenamed("target_id", "to_id"), ["id", "to_id"], "left_anti")
    order = Window.partitionBy("from_id", "to_id").orderBy("id")
    return missing.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each).select("from_id", "to_id", "id")


def event_bridges(nodes: DataFrame, edges: DataFrame, scope: Column) -> DataFrame:
    """(file_path): files outside the scope joined to it through a channel, whichever side
    emits."""
    emits = edges.where("type = 'EMITS'").select("source_id", F.col("target_id").alias("channel"))
    hears = edges.where("type = 'LISTENS_ON'").select("source_id", F.col("target_id").alias("channel"))
    ends = emits.withColumn("side", F.lit(0)).unionByName(hears.withColumn("side", F.lit(1)))
    placed = ends.join(nodes.select(F.col("id").alias("source_id"), "file_path", scope.alias("inside")), "source_id").select("channel", "side", "file_path", "inside").distinct()
    reached = placed.where("inside").select("channel", (1 - F.col("side")).alias("side")).distinct()
    return placed.where("not inside").join(reached, ["channel", "side"], "left_semi").select("file_path").distinct()


def boundary_edges(nodes: DataFrame, edges: DataFrame, scope: Column, types: tuple[str, ...] = ("CALLS", "IMPORTS", "USAGE")) -> DataFrame:
    """Edges with exactly one end in scope, once per (direction, type, ends)."""
    placed = endpoints(edges.where(F.col("type").isin(*types)), nodes.withColumn("inside", scope), ["inside"])
    crossing = placed.where(F.col("source_inside") != F.col("target_inside"))
    return crossing.select(F.when(F.col("source_inside"), "outgoing").otherwise("incoming").alias("direction"), "type", "source_id", "target_id").distinct()


def downstream_files(nodes: DataFrame, edges: DataFrame, scope: Column) -> DataFrame:
    """Files outside the scope that files in it call, import or use."""
    placed = endpoints(edges.where(F.col("type").isin("CALLS", "IMPORTS", "USAGE")), nodes.withColumn("inside", scope), ["inside", "file_path"])
    return placed.where("source_inside and not target_inside").select(F.col("target_file_path").alias("file_path")).distinct()


def dependent_files(nodes: DataFrame, edges: DataFrame, file: str, limit: int = 200) -> DataFrame:
    """Other files with an edge into the file."""
    into = nodes.where(F.col("file_path") == file).select(F.col("id").alias("target_id"))
    sources = bounded_join(edges, into, ["target_id"], "left_semi").select(F.col("source_id").alias("id"))
    return nodes.join(sources, "id", "left_semi").where(F.col("file_path") != file).select("file_path").distinct().orderBy("file_path").limit(limit)


def marked_ends(nodes: DataFrame, edges: DataFrame, changed: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(own, ends): the nodes of changed and deleted files, and the edges that touch them with
    both ends' file, qualified name and marks. Nodes are marked once and edges meet the marks
    once; only what touches a changed or deleted file is kept, written once."""
    touched = changed.select("file_path", F.lit(True).alias("c"), F.lit(False).alias("d")).unionByName(deleted.select("file_path", F.lit(False).alias("c"), F.lit(True).alias("d")))
    marks = touched.groupBy("file_path").agg(F.bool_or("c").alias("changed"), F.bool_or("d").alias("deleted"))
    own = written(bounded_join(nodes.select("id", "file_path", "qualified_name", "kind", "is_test"), marks, ["file_path"]), "own")
    kinds = edges.where(F.col("type").isin("TESTS", "TESTS_FILE", "CALLS", "USAGE", "IMPORTS", "EMITS", "LISTENS_ON")).select("source_id", "target_id", "type")
    mark = lambda end: own.select(F.col("id").alias(f"{end}_id"), F.col("changed").alias(f"{end}_changed"), F.col("deleted").alias(f"{end}_deleted"))
    hit = kinds.join(mark("source"), "source_id", "left").join(mark("target"), "target_id", "left").where("source_changed is not null or target_changed is not null")
    places = lambda end: nodes.select(F.col("id").alias(f"{end}_id"), F.col("file_path").alias(f"{end}_file"), F.col("qualified_name").alias(f"{end}_name"))
    ends = hit.fillna(False, ["source_changed", "source_deleted", "target_changed", "target_deleted"]).join(places("source"), "source_id").join(places("target"), "target_id")
    return own, written(ends, "ends")


def impact_findings(nodes: DataFrame, edges: DataFrame, changed: DataFrame, deleted: DataFrame, marked: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(category, file_path, symbol): findings on changed and deleted files (frames with
    file_path): tests that cover them, untested files, symbols without callers, references to
    deleted symbols, files not in the graph, and files downstream."""
    touched, ends = marked or marked_ends(nodes, edges, changed, deleted)
    own, gone, c = touched.where("changed"), touched.where("deleted"), F.col
    named = lambda rows, category, file, symbol: rows.select(F.lit(category).alias("category"), c(file).alias("file_path"), (c(symbol) if symbol else F.lit("")).alias("symbol"))
    covering = named(ends.where(c("type").isin("TESTS", "TESTS_FILE") & c("target_changed")), "covered_by", "target_file", "source_name").distinct()
    untested = named(own.where("coalesce(is_test, 0) = 0").select("file_path").distinct().join(covering.select("file_path"), "file_path", "left_anti"), "untested", "file_path", None)
    called = ends.where(c("type").isin("CALLS", "USAGE") & c("target_changed")).select(c("target_id").alias("id"))
    lonely = named(own.join(called, "id", "left_anti"), "no_callers", "file_path", "qualified_name")
    live = ends.where(c("type").isin("CALLS", "USAGE", "IMPORTS") & c("target_deleted") & ~c("source_deleted")).select(c("target_id").alias("id"))
    dangling = named(gone.join(live, "id", "left_semi"), "deleted_in_use", "file_path", "qualified_name")
    unknown = named(changed.select("file_path").distinct().join(own.select("file_path"), "file_path", "left_anti"), "not_indexed", "file_path", None)
    below = named(ends.where(c("type").isin("CALLS", "IMPORTS", "USAGE") & c("source_changed") & ~c("target_changed")), "downstream", "target_file", None).distinct()
    return reduce(DataFrame.unionByName, (covering, untested, lonely, dangling, unknown, below))


#: How sure a finding is, by its category.
CONFIDENCE = {"deleted_in_use": "high", "covered_by": "high", "broken_rule": "high", "downstream": "medium", "async_dependent": "medium", "broken_invariant": "medium", "untested": "medium", "no_callers": "low", "not_indexed": "low"}


def finding_order() -> list[Column]:
    """Order of findings: the surest first, then by category, file and symbol."""
    return [F.array_position(F.array(*(F.lit(x) for x in ("high", "medium", "low"))), F.col("confidence")).asc(), F.col("category").asc(), F.col("file_path").asc(), F.col("symbol").asc_nulls_first()]


def assessment(nodes: DataFrame, edges: DataFrame, changed: DataFrame, deleted: DataFrame, layers: dict[str, str], forbidden: list[tuple[str, str]], **invariant) -> DataFrame:
    """(category, file_path, symbol, confidence) of `impact_findings` and, on changed files: files
    joined to them through a channel, callers that break an invariant, and forbidden imports.
    `invariant` are the parameters of `invariants`."""
    marked = marked_ends(nodes, edges, changed, deleted)
    own, ends = marked
    c = F.col
    sides = ends.where(c("type").isin("EMITS", "LISTENS_ON") & c("source_changed")).select(c("target_id"), F.when(c("type") == "EMITS", "LISTENS_ON").otherwise("EMITS").alias("type")).distinct()
    others = edges.where(c("type").isin("EMITS", "LISTENS_ON")).join(sides, ["target_id", "type"], "left_semi").select(c("source_id").alias("id"))
    dependent = nodes.join(others, "id", "left_semi").select("file_path").distinct().join(changed.select("file_path"), "file_path", "left_anti")
    scope = own.where("changed").select("id")
    found = invariants(nodes, edges, **invariant)
    broken = broken_invariants(found, edges, scope, type=invariant.get("type", "CALLS")).select("id").distinct().join(nodes, "id")
    imports = ends.where(c("type").isin("IMPORTS") & c("source_changed")).select(c("source_id"), c("target_id"), c("source_file"), c("source_name"), c("target_file"))
    target = nodes.where(c("kind").isin("Function", "Method", "Class", "Interface")).select(c("id").alias("target_id"))
    sided = imports.join(target, "target_id", "left_semi").withColumns({"a": layer_of(c("source_file"), layers), "b": layer_of(c("target_file"), layers)})
    banned = reduce(Column.__or__, ((c("a") == a) & (c("b") == b) for a, b in forbidden), F.lit(False))
    part = lambda rows, category, file, symbol: rows.select(F.lit(category).alias("category"), c(file).alias("file_path"), symbol.alias("symbol"))
    more = [part(dependent, "async_dependent", "file_path", F.lit("")), part(broken, "broken_invariant", "file_path", c("qualified_name")), part(sided.where(banned), "broken_rule", "source_file", c("source_name")).distinct()]
    rows = reduce(DataFrame.unionByName, (impact_findings(nodes, edges, changed, deleted, marked), *more))
    sure = F.coalesce(*(F.when(c("category") == k, F.lit(v)) for k, v in CONFIDENCE.items()))
    return rows.withColumn("confidence", sure)


def test_counts(nodes: DataFrame, edges: DataFrame, files: DataFrame, file_types: tuple[str, ...] = ("TESTS_FILE",), symbol_types: tuple[str, ...] = ("TESTS",), file_kinds: tuple[str, ...] = ("File",), symbol_kinds: tuple[str, ...] = ("Function", "Method")) -> DataFrame:
    """(file_path, level, tests): for each file its test relations as a file, and those of its
    symbols; sources that are no tests don't count. Zeros are kept."""
    own = nodes.join(files.select("file_path").distinct(), "file_path", "left_semi").select(F.col("id").alias("target_id"), "file_path", "kind")
    source = nodes.where("is_test = 1").select(F.col("id").alias("source_id"))
    rows = edges.select("source_id", "target_id", "type").join(own, "target_id").join(source, "source_id", "left_semi")
    level = F.when(F.col("type").isin(*file_types) & F.col("kind").isin(*file_kinds), "file").when(F.col("type").isin(*symbol_types) & F.col("kind").isin(*symbol_kinds), "symbol")
    counted = rows.withColumn("level", level).where("level is not null").groupBy("file_path", "level").agg(F.count("*").alias("tests"))
    every = files.select("file_path").distinct().withColumn("level", F.explode(F.array(F.lit("file"), F.lit("symbol"))))
    return every.join(counted, ["file_path", "level"], "left").select("file_path", "level", F.coalesce("tests", F.lit(0).cast("long")).alias("tests"))


def fair_selection(rows: DataFrame, category: str, order: list[Column], limit: int, least: int = 5) -> DataFrame:
    """A page that is fair to categories: each gets max(least, limit / categories) rows in its
    own order, what is left over is dealt round by round, and at most `limit` rows come out in
    the global order."""
    per = Window.partitionBy(category).orderBy(*order)
    ranked = rows.withColumn("_rank", F.row_number().over(per)).where(F.col("_rank") <= max(limit, least))
    names = rows.select(category).distinct().agg(F.count("*").alias("_n"))
    base = F.greatest(F.lit(least), F.floor(F.lit(limit) / F.col("_n")))
    dealt = ranked.join(F.broadcast(names)).withColumns({"_extra": F.greatest(F.col("_rank") - base, F.lit(0))})
    turn = [F.col("_extra").asc(), F.when(F.col("_extra") > 0, F.col(category)), *order]
    chosen = dealt.orderBy(*turn).limit(limit) if limit else dealt.limit(0)
    return chosen.drop("_rank", "_n", "_extra")


def role_quotas(degree: DataFrame, nodes: DataFrame, cuts: DataFrame, quotas: list[tuple[str, int]], limit: int) -> DataFrame:
    """Nodes by role (entry, hotspot, risk, value) filled in the order of `quotas`, then by
    degree up to `limit`. `cuts` is one row with cut_15 and cut_40."""
    total = F.coalesce(F.col("in_degree") + F.col("out_degree"), F.lit(0).cast("long"))
    rows = nodes.join(degree, "id", "left").withColumn("degree", total).join(F.broadcast(cuts))
    role = F.when((F.col("is_entry_point") == 1) | (F.col("kind") == "Route"), "entry").when(F.col("degree") >= F.greatest("cut_15", F.lit(2)), "hotspot").when(F.col("degree") >= F.greatest("cut_40", F.lit(1)), "risk").otherwise("value")
    placed = rows.withColumn("role", role)
    order = [F.col("degree").desc(), F.col("id").asc()]
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("role").orderBy(*order))).where(F.col("_rank") <= limit)
    turn = reduce(lambda c, q: c.when((F.col("role") == q[1][0]) & (F.col("_rank") <= q[1][1]), q[0]), enumerate(quotas), F.when(F.lit(False), -1)).otherwise(len(quotas))
    return ranked.orderBy(turn, *order).limit(limit).select("id", "role", "degree")


def induced(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with both ends among the chosen nodes."""
    ids = chosen.select("id")
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
