"""Aggregations over nodes and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Edge types that keep a definition alive.
REFERENCES = ("CALLS", "USAGE", "READS", "TESTS", "TESTS_FILE")


def not_test_path(col: str = "file_path") -> Column:
    return ~F.col(col).startswith("tests/") & ~F.col(col).contains("/tests/")


def number(key: str) -> Column:
    """A numeric property of the node, null where there is none."""
    return F.get_json_object("properties", f"$.{key}").try_cast("double")


def counts(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"))


def property_keys(nodes: DataFrame) -> DataFrame:
    """(kind, key, n): the properties that occur per kind."""
    return nodes.select("kind", F.explode(F.json_object_keys("properties")).alias("key")).groupBy("kind", "key").agg(F.count("*").alias("n"))


def endpoints(edges: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Edges with the given columns of both ends, prefixed source_ and target_."""
    s = nodes.select(F.col("id").alias("source_id"), *(F.col(c).alias(f"source_{c}") for c in columns))
    t = nodes.select(F.col("id").alias("target_id"), *(F.col(c).alias(f"target_{c}") for c in columns))
    return edges.join(s, "source_id").join(t, "target_id")


def patterns(edges: DataFrame, nodes: DataFrame, limit: int = 30) -> DataFrame:
    """The most frequent (source kind)-[type]->(target kind) patterns."""
    found = endpoints(edges, nodes, ["kind"]).groupBy("source_kind", "type", "target_kind").agg(F.count("*").alias("n"))
    return found.orderBy(F.col("n").desc(), "source_kind", "type", "target_kind").limit(limit)


def incident_counts(edges: DataFrame, types: list[str]) -> DataFrame:
    """(id, in_<type>, out_<type> ...): edges of each type at either end. An edge is turned
    into its two ends, so there is no join on "source or target"."""
    rows = edges.where(F.col("type").isin(types))
    ends = rows.select("type", F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit("out").alias("d")), F.struct(F.col("target_id").alias("id"), F.lit("in").alias("d")))).alias("e"))
    return ends.groupBy("e.id").agg(*(F.count_if((F.col("type") == t) & (F.col("e.d") == d)).alias(f"{d}_{t.lower()}") for t in types for d in ("in", "out")))


def unreferenced(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("Function", "Class"), min_span: int = 2) -> DataFrame:
    """Definitions of production code that no edge refers to: an anti join."""
    path = F.col("file_path")
    test = path.startswith("tests/") | path.contains("/__tests__/") | path.contains(".test.") | path.contains(".spec.")
    flags = (F.coalesce("is_test", F.lit(0)) == 0) & (F.coalesce("is_entry_point", F.lit(0)) == 0)
    rows = nodes.where(F.col("kind").isin(*kinds) & flags & (F.col("end_line") - F.col("start_line") >= min_span) & ~test & ~((F.col("name") == "main") & path.endswith(".sh")))
    referred = edges.where(F.col("type").isin(*REFERENCES)).select(F.col("target_id").alias("id"))
    signature = F.trim(F.coalesce(F.get_json_object("properties", "$.signature"), F.lit("")))
    callable_ = (signature != "") & (F.length(signature) <= 300) & ~signature.contains("\n")
    kept = rows.join(referred, "id", "left_anti").where(callable_ | (F.length("name") > 2))
    confidence = F.when(~callable_, "low").when((F.coalesce("is_exported", F.lit(0)) == 0) & (F.col("kind") != "Method"), "high").otherwise("medium")
    return kept.withColumn("confidence", confidence)


def hotspots(nodes: DataFrame, edges: DataFrame, limit: int = 20, include_tests: bool = False) -> DataFrame:
    """Functions and methods by callers: 0.4 for each call, 0.6 for each distinct caller."""
    rows = nodes.where(F.col("kind").isin("Function", "Method"))
    if not include_tests:
        rows = rows.where((F.col("is_test") == 0) & not_test_path())
    named = nodes.select(F.col("id").alias("source_id"), F.nullif("qualified_name", F.lit("")).alias("caller"))
    calls = edges.where("type = 'CALLS'").select("source_id", "target_id").groupBy("target_id", "source_id").agg(F.count("*").alias("n"))
    fan = calls.join(named, "source_id", "left").groupBy(F.col("target_id").alias("id")).agg(F.sum("n").alias("fan_in"), F.countDistinct("caller").alias("distinct_callers"))
    score = F.round(F.col("fan_in") * 0.4 + F.col("distinct_callers") * 0.6, 6)
    complexity = F.coalesce(F.nullif(number("cyclomaticComplexity"), F.lit(0.0)), number("complexity"), F.lit(0.0))
    return rows.join(fan, "id").withColumns({"score": score, "complexity": complexity}).orderBy(F.col("score").desc(), "qualified_name", "id").limit(limit)


def large_components(nodes: DataFrame, min_lines: int = 300, limit: int = 20) -> DataFrame:
    """Classes and modules of many lines."""
    lines = number("lineCount").cast("long")
    rows = nodes.where(F.col("kind").isin("Class", "Module") & (F.col("is_test") == 0) & not_test_path()).withColumn("line_count", lines)
    return rows.where(F.col("line_count") >= min_lines).orderBy(F.col("line_count").desc(), "qualified_name", "id").limit(limit)


def project_stats(nodes: DataFrame) -> DataFrame:
    """Counts and averages of the functions' metrics, to two places."""
    rows = nodes.where(F.col("kind").isin("Function", "Method"))
    return rows.agg(F.count("*").alias("functions"), F.round(F.avg(number("cyclomaticComplexity")), 2).alias("avg_complexity"), F.round(F.avg(number("lineCount")), 2).alias("avg_lines"), F.max(number("cyclomaticComplexity")).alias("max_complexity"))


def degree_bands(degree: DataFrame, hot: int = 30, risky: int = 10) -> DataFrame:
    """How many nodes are hotspots by total degree and risky by fan-in."""
    total = F.col("in_degree") + F.col("out_degree")
    return degree.agg(F.count_if(total >= hot).alias("hotspots"), F.count_if(F.col("in_degree") >= risky).alias("risky"), F.count("*").alias("connected"))


def extensions(nodes: DataFrame) -> DataFrame:
    """Distinct files by extension."""
    ext = F.regexp_extract("file_path", r"[.]([A-Za-z0-9]+)$", 1)
    return nodes.select("file_path").distinct().groupBy(ext.alias("extension")).agg(F.count("*").alias("files"))


def occurrences(edges: DataFrame) -> DataFrame:
    """Parallel edges counted: (source_id, target_id, type, occurrences, first_line)."""
    return edges.groupBy("source_id", "target_id", "type").agg(F.count("*").alias("occurrences"), F.min("line").alias("first_line"))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Exact duplicates dropped; parallel edges that differ in a property stay."""
    return edges.dropDuplicates(["project", "source_id", "target_id", "type", "line"])


def file_coverage(nodes: DataFrame, hashes: DataFrame) -> DataFrame:
    """Files of a manifest that have graph nodes."""
    return hashes.select("file_path").distinct().join(nodes.select("file_path").distinct(), "file_path", "left_semi").agg(F.count("*").alias("files"))


def evidence_by_edge(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each edge with its number of evidence rows and greatest strength, 0 and null without."""
    per = evidence.groupBy("edge_id").agg(F.count("*").alias("evidence"), F.max("strength").alias("strength"))
    return edges.join(per, edges["id"] == per["edge_id"], "left").drop("edge_id").withColumn("evidence", F.coalesce("evidence", F.lit(0).cast("long")))


def tier(strength: Column) -> Column:
    """Confidence tier of a strength."""
    return F.when(strength >= 0.98, "exact_ast").when(strength >= 0.85, "resolver").otherwise("heuristic")


def coverage_rollup(files: DataFrame) -> DataFrame:
    """Totals of (total_calls, unresolved_calls) and the resolution rate to four places, 1 where
    there is no call."""
    total, missing = F.coalesce(F.sum("total_calls"), F.lit(0)), F.coalesce(F.sum("unresolved_calls"), F.lit(0))
    return files.agg(total.alias("total"), missing.alias("unresolved"), F.when(total == 0, 1.0).otherwise(F.round((total - missing) / total, 4)).alias("rate"))


def merged_reasons(files: DataFrame, column: str = "reasons") -> DataFrame:
    """(reason, n): map columns summed by key."""
    return files.select(F.explode(column).alias("reason", "k")).groupBy("reason").agg(F.sum("k").alias("n"))


def federated(local: DataFrame, shared: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of two providers merged by (qualified_name, file_path); the local row wins, with
    provenance local, shared or mixed and the number of providers."""
    both = local.select("qualified_name", "file_path", *columns, F.lit(0).alias("p")).unionByName(shared.select("qualified_name", "file_path", *columns, F.lit(1).alias("p")))
    merged = both.groupBy("qualified_name", "file_path").agg(F.min(F.struct("p", *columns)).alias("r"), F.countDistinct("p").alias("providers"), F.min("p").alias("p"))
    provenance = F.when(F.col("providers") == 2, "mixed").when(F.col("p") == 0, "local").otherwise("shared")
    return merged.select("qualified_name", "file_path", *(F.col(f"r.{c}").alias(c) for c in columns), provenance.alias("provenance"), "providers")


def review_issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, file_path, severity, category): size, complexity, loops, coupling, and once per file
    missing tests. Thresholds are those of the conditions below."""
    calls = edges.where("type = 'CALLS'").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("fan_in"))
    covered = edges.where(F.col("type").isin("TESTS", "TESTS_FILE")).select(F.col("target_id").alias("id"))
    tested_file = nodes.join(covered, "id", "left_semi").select("file_path", F.lit(True).alias("tested")).distinct()
    rows = nodes.where(F.col("kind").isin("Function", "Method", "Class")).join(calls, "id", "left").join(tested_file, "file_path", "left")
    lines, cc, loops, fan = F.col("end_line") - F.col("start_line") + 1, F.coalesce(number("cyclomaticComplexity"), F.lit(0.0)), F.coalesce(number("loopDepth"), F.lit(0.0)), F.coalesce("fan_in", F.lit(0).cast("long"))

    def issue(severity: str, category: str, test: Column) -> Column:
        return F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category")))

    found = [
        F.coalesce(issue("high", "size", lines > 200), issue("medium", "size", lines > 80)),
        F.coalesce(issue("critical", "complexity", cc > 100), issue("high", "complexity", cc > 50), issue("medium", "complexity", cc > 20)),
        issue("high", "performance", loops >= 3),
        issue("high", "risk", fan >= 20),
    ]
    own = rows.select("id", "file_path", F.explode(F.filter(F.array(*found), lambda i: i.isNotNull())).alias("i")).select("id", "file_path", "i.*")
    path = F.col("file_path")
    test = path.contains(".test.") | path.contains(".spec.") | path.contains("__tests__")
    untested = rows.where((F.coalesce("is_test", F.lit(0)) != 1) & ~test & F.col("tested").isNull() & ((cc > 10) | (fan > 5)))
    per_file = untested.groupBy("file_path").agg(F.min("id").alias("id")).select("id", "file_path", F.lit("medium").alias("severity"), F.lit("test-coverage").alias("category"))
    return own.unionByName(per_file)


SEVERITIES = ("critical", "high", "medium", "low", "info")


def by_severity(rows: DataFrame, limit: int) -> DataFrame:
    """The gravest rows first."""
    rank = reduce(lambda c, s: c.when(F.col("severity") == s[1], s[0]), enumerate(SEVERITIES[1:], 1), F.when(F.col("severity") == SEVERITIES[0], 0)).otherwise(len(SEVERITIES))
    return rows.orderBy(rank, "category", "file_path", "id").limit(limit)


def capped_neighbours(edges: DataFrame, k: int) -> DataFrame:
    """At most `k` outgoing edges per node, lowest ids first (WindowGroupLimit prunes early)."""
    order = Window.partitionBy("source_id").orderBy("id", "target_id", "line")
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_cutoffs(degree: DataFrame, shares: tuple[float, float] = (0.15, 0.40)) -> DataFrame:
    """The total degree at floor(share * n) in descending order, for each share: found from the
    histogram of degrees, so no global sort of nodes is needed."""
    histogram = degree.groupBy((F.col("in_degree") + F.col("out_degree")).alias("degree")).agg(F.count("*").alias("n"))
    after = Window.orderBy(F.col("degree").desc())
    # one row per distinct degree: a window over few rows
    placed = histogram.withColumns({"to": F.sum("n").over(after), "all": F.sum("n").over(Window.partitionBy(F.lit(1)))})
    return placed.agg(*(F.max(F.when(F.col("to") > F.floor(F.col("all") * s), F.col("degree"))).alias(f"cut_{int(s * 100)}") for s in shares))


def file_tree(nodes: DataFrame) -> DataFrame:
    """(path, parent, is_dir, children): every folder and file with its number of children."""
    files = nodes.select("file_path").where("file_path <> ''").distinct()
    parts = F.split("file_path", "/")
    paths = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path"), (i < F.size(parts)).alias("is_dir")))).alias("p")).select("p.*").groupBy("path").agg(F.bool_or("is_dir").alias("is_dir"))
    placed = paths.withColumn("parent", F.regexp_replace("path", "/?[^/]*$", ""))
    children = placed.groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("children"))
    return placed.join(children, "path", "left").withColumn("children", F.coalesce("children", F.lit(0).cast("long")))


def suffixes(nodes: DataFrame) -> DataFrame:
    """(suffix, id): every dotted suffix of the qualified names."""
    parts = F.split("qualified_name", r"\.")
    return nodes.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("suffix"))


def unique_longest_suffix(wanted: DataFrame, paths: DataFrame) -> DataFrame:
    """Each wanted path with the one path that shares its longest slash suffix; ambiguous and
    unmatched ones are left out."""

    def exploded(rows: DataFrame, name: str) -> DataFrame:
        parts = F.split(name, "/")
        cut = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), "/").alias("suffix"), (F.size(parts) - i + 1).alias("depth")))
        return rows.select(name, F.explode(cut).alias("s")).select(name, "s.suffix", "s.depth")

    # a suffix that many paths share can't win: counted before the join, so hot suffixes drop out
    owners = exploded(paths.select("path").distinct(), "path").groupBy("suffix").agg(F.count("*").alias("n"), F.first("path").alias("path"))
    hits = exploded(wanted.select("wanted").distinct(), "wanted").join(owners, "suffix")
    best = hits.groupBy("wanted").agg(F.max(F.struct("depth", "n", "path")).alias("b"))
    return best.where("b.n = 1").select("wanted", "b.path", "b.depth")


def parents(nodes: DataFrame) -> DataFrame:
    """(id, parent_id): the node whose qualified name is the node's without its last segment."""
    cut = nodes.select("id", F.regexp_extract("qualified_name", r"^(.*)\.[^.]*$", 1).alias("qualified_name")).where("qualified_name <> ''")
    return cut.join(nodes.select(F.col("id").alias("parent_id"), "qualified_name"), "qualified_name").select("id", "parent_id")
