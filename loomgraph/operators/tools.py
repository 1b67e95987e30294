"""Composite questions about symbols, files and changes, built from the other operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.texts import snippet
from loomgraph.operators.graph_stats import counts, extensions, hotspots, not_test_path, number
from loomgraph.operators.search import degrees, in_scope, text_rank, tokens, with_degrees
from loomgraph.operators.traversal import MODES, found_symbol, path_evidence, shortest_path, trace

TEST_TYPES = ("TESTS", "TESTS_FILE")


def find_tests(nodes: DataFrame, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, level, tests) for wanted symbols (id): tests of the symbol itself, else those of its
    file, else none."""
    tests = edges.where(F.col("type").isin(*TEST_TYPES)).select("source_id", F.col("target_id").alias("id")).distinct()
    own = tests.groupBy("id").agg(F.count("*").alias("direct"))
    by_file = tests.join(nodes.select("id", "file_path"), "id").groupBy("file_path").agg(F.countDistinct("source_id").alias("file"))
    rows = wanted.select("id").distinct().join(nodes.select("id", "file_path"), "id").join(own, "id", "left").join(by_file, "file_path", "left")
    level = F.when(F.col("direct").isNotNull(), "symbol").when(F.col("file").isNotNull(), "file").otherwise("none")
    return rows.select("id", level.alias("level"), F.coalesce("direct", "file", F.lit(0).cast("long")).alias("tests"))


def find_tests_by_text(nodes: DataFrame, edges: DataFrame, wanted: DataFrame, sources: DataFrame) -> DataFrame:
    """`find_tests` with a third, weaker level: test files (sources: file_path, content) whose text
    has the symbol's name as a whole word. Texts are cut into words once and joined by word."""
    found = find_tests(nodes, edges, wanted)
    names = found.where("level = 'none'").join(nodes.select("id", "name"), "id").select("id", "name")
    words = sources.select("file_path", F.explode(F.array_distinct(F.split("content", r"[^\p{L}\p{N}_$]+"))).alias("name")).where("name <> ''")
    said = words.join(names.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.countDistinct("file_path").alias("files"))
    by_text = names.join(said, "name").select("id", "files")
    rows = found.join(by_text, "id", "left")
    return rows.select("id", F.when(F.col("files").isNotNull(), "text").otherwise(F.col("level")).alias("level"), F.coalesce("files", "tests").alias("tests"))


#: Edge types that count as coming into a symbol and as going out of it when it is explained.
INTO, OUT_OF = ("CALLS", "USAGE", "TESTS"), ("CALLS", "USAGE", "IMPORTS")


def explain_symbols(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out, callers, tested, complexity, risk) of every callable and type."""
    into = edges.where(F.col("type").isin(*INTO)).groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("fan_in"), F.countDistinct("source_id").alias("callers"))
    out = edges.where(F.col("type").isin(*OUT_OF)).groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("fan_out"))
    tested = edges.where(F.col("type").isin(*TEST_TYPES)).select(F.col("target_id").alias("id"), F.lit(True).alias("tested")).distinct()
    rows = nodes.where(F.col("kind").isin("Function", "Method", "Class", "Interface")).join(into, "id", "left").join(out, "id", "left").join(tested, "id", "left")
    zero = F.lit(0).cast("long")
    cc, fan = F.coalesce(number("cyclomaticComplexity"), F.lit(0.0)), F.coalesce("fan_in", zero)
    risk = F.when((fan >= 20) | (cc > 100), "critical").when((fan >= 10) | (cc > 50), "high").when((fan >= 5) | (cc > 20), "medium").otherwise("low")
    return rows.select("id", fan.alias("fan_in"), F.coalesce("fan_out", zero).alias("fan_out"), F.coalesce("callers", zero).alias("callers"), F.coalesce("tested", F.lit(False)).alias("tested"), cc.alias("complexity"), risk.alias("risk"))


def explain_context(nodes: DataFrame, edges: DataFrame, wanted: DataFrame, findings: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """(id, role, type, other) of wanted symbols (id): up to `limit` callers and callees each,
    lowest ids first, every parent, and the categories of findings (id, target_qn, category)."""
    c = F.col
    ids = wanted.select("id").distinct()

    def side(types: tuple[str, ...], own: str, other: str, role: str) -> DataFrame:
        rows = edges.where(c("type").isin(*types)).select(c(own).alias("id"), "type", c(other).alias("other"), c("id").alias("edge")).join(ids, "id", "left_semi")
        ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("other", "type", "edge")))
        return ranked.where(c("rank") <= limit).select("id", F.lit(role).alias("role"), "type", c("other").cast("string").alias("other"))

    parents = edges.where("type = 'INHERITS'").select(c("source_id").alias("id"), "type", c("target_id").alias("other")).join(ids, "id", "left_semi").distinct().select("id", F.lit("parent").alias("role"), "type", c("other").cast("string").alias("other"))
    parts = [side(INTO, "target_id", "source_id", "caller"), side(OUT_OF, "source_id", "target_id", "callee"), parents]
    if findings is not None:
        named = nodes.join(ids, "id", "left_semi").select("id", c("qualified_name").alias("target_qn"))
        parts.append(findings.select("target_qn", "category").join(named, "target_qn").select("id", F.lit("finding").alias("role"), c("category").alias("type"), F.lit("").alias("other")).distinct())
    return reduce(DataFrame.unionByName, parts)


def _production(nodes: DataFrame, include_tests: bool) -> DataFrame:
    return nodes if include_tests else nodes.where((F.coalesce("is_test", F.lit(0)) == 0) & not_test_path())


def hotspot_report(nodes: DataFrame, edges: DataFrame, limit: int = 20, include_tests: bool = False, min_lines: int = 10) -> DataFrame:
    """(part, name, value): the hottest, most complex and most coupled symbols, the largest modules
    and classes, and averages; `limit` of each, ties by name."""
    rows = _production(nodes, include_tests)
    c = F.col
    callable_ = rows.where(c("kind").isin("Function", "Method"))

    def part(found: DataFrame, name: str, label: str, value: Column) -> DataFrame:
        top = found.select(F.lit(name).alias("part"), c(label).alias("name"), value.cast("double").alias("value")).where("value is not null")
        return top.orderBy(c("value").desc(), "name").limit(limit)

    into = edges.groupBy(c("target_id").alias("id")).agg(F.count("*").alias("fan_in"))
    coupled = rows.where(c("kind").isin("Function", "Method", "Class", "Module")).join(into, "id")
    complexity, lines = number("cyclomaticComplexity"), number("lineCount")
    averages = callable_.agg(F.count("*").cast("double").alias("functions"), F.round(F.avg(complexity), 2).alias("avg_complexity"), F.round(F.avg(lines), 2).alias("avg_lines"))
    stats = averages.select(F.lit("stats").alias("part"), F.explode(F.create_map(*(x for name in averages.columns for x in (F.lit(name), c(name))))).alias("name", "value"))
    parts = [
        hotspots(nodes, edges, limit, include_tests).select(F.lit("hotspot").alias("part"), c("qualified_name").alias("name"), c("score").cast("double").alias("value")),
        part(callable_, "complex", "qualified_name", complexity),
        part(coupled, "coupled", "qualified_name", c("fan_in")),
        part(rows.where(c("kind").isin("Module", "Class") & (lines > min_lines)), "large", "qualified_name", lines),
        stats,
    ]
    return reduce(DataFrame.unionByName, parts)


def architecture(nodes: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """(part, name, n): totals, files by extension, nodes by kind, edges by type, entry points (their
    place) and hotspots (their callers)."""
    c = F.col
    one = lambda rows, part, name, n: rows.select(F.lit(part).alias("part"), name.alias("name"), n.cast("long").alias("n"))
    places = [(c("kind") == "Route").desc(), c("file_path").rlike("(^|/)index[.]").desc(), c("file_path"), c("start_line"), c("id")]
    entries = nodes.where(c("is_entry_point") == 1).where(c("kind").isin("Function", "Method", "Class", "Module", "Route") & (c("file_path") != "")).orderBy(*places).limit(limit)
    parts = [
        one(nodes.agg(F.count("*").alias("n")), "total", F.lit("nodes"), c("n")),
        one(edges.agg(F.count("*").alias("n")), "total", F.lit("edges"), c("n")),
        one(extensions(nodes), "extension", c("extension"), c("files")),
        one(counts(nodes, "kind"), "kind", c("kind"), c("n")),
        one(counts(edges, "type"), "type", c("type"), c("n")),
        one(entries, "entry", c("qualified_name"), c("start_line")),
        one(hotspots(nodes, edges, limit), "hotspot", c("qualified_name"), c("fan_in")),
    ]
    return reduce(DataFrame.unionByName, parts)


def investigate(nodes: DataFrame, edges: DataFrame, name: str, max_depth: int = 2, walk: DataFrame | None = None) -> DataFrame:
    """(layer, name, value) of one symbol: the best matches of its name, its metrics, what it
    reaches and is reached from (the hop), and its tests."""
    c = F.col
    symbol = found_symbol(nodes, name).select("id")
    word = (tokens(name.rsplit(".", 1)[-1]) or [name.lower()])[0]
    matches = text_rank(nodes, edges, word).orderBy(c("score").desc(), "name", "id").limit(3).select(F.lit("search").alias("layer"), c("qualified_name").alias("name"), c("score").cast("long").alias("value"))
    about = explain_symbols(nodes, edges).join(symbol, "id", "left_semi").join(nodes.select("id", "qualified_name"), "id")
    metrics = about.select(F.lit("explain").alias("layer"), F.explode(F.create_map(*(x for m in ("fan_in", "fan_out", "callers") for x in (F.concat("qualified_name", F.lit(f":{m}")), c(m))))).alias("name", "value"))
    traced = trace(nodes, edges, name, "both", "auto", max_depth, walk=walk).select(c("direction").alias("layer"), c("qualified_name").alias("name"), c("hop").cast("long").alias("value"))
    tested = find_tests(nodes, edges, symbol).join(nodes.select("id", "qualified_name"), "id").select(F.concat(F.lit("tests:"), "level").alias("layer"), c("qualified_name").alias("name"), c("tests").alias("value"))
    return reduce(DataFrame.unionByName, (matches, metrics, traced, tested))


def edge_evidence(edges: DataFrame, evidence: DataFrame, source: int, target: int, max_depth: int = 3) -> DataFrame:
    """(hop, edge, evidence, strength, tier) of the direct edges of a pair (hop 0), or, where there
    are none, of the shortest path of calls; evidence is (edge_id, strength)."""
    direct = edges.where((F.col("source_id") == source) & (F.col("target_id") == target)).select(F.lit(0).alias("hop"), F.col("id").alias("edge"))
    rows = direct if not direct.isEmpty() else shortest_path(edges, source, target, max_depth).select("hop", "edge")
    return path_evidence(rows, evidence)


def node_evidence(edges: DataFrame, evidence: DataFrame, node: int, direction: str = "both", limit: int = 30) -> DataFrame:
    """(direction, edge_id, id, strength) of the evidence at a node's edges, the strongest first, of
    equal strength the least id, at most `limit`."""
    c = F.col
    way = F.when(c("target_id") == node, "inbound").otherwise("outbound")
    rows = edges.where((c("source_id") == node) | (c("target_id") == node)).select(c("id").alias("edge_id"), way.alias("direction"))
    rows = rows if direction == "both" else rows.where(c("direction") == direction)
    return evidence.join(rows, "edge_id").select("direction", "edge_id", "id", "strength").orderBy(c("strength").desc_nulls_last(), "id").limit(limit)


def edge_context(edges: DataFrame, source: int, target: int, around: int = 10) -> DataFrame:
    """(id, role): the direct edges of a pair and up to `around` further edges out of the source
    and into the target, lowest ids first."""
    direct = edges.where((F.col("source_id") == source) & (F.col("target_id") == target)).select("id", "type", F.lit("direct").alias("role"))
    out = edges.where((F.col("source_id") == source) & (F.col("target_id") != target)).select("id", "type", F.lit("out").alias("role")).orderBy("id", "type").limit(around)
    into = edges.where((F.col("target_id") == target) & (F.col("source_id") != source)).select("id", "type", F.lit("in").alias("role")).orderBy("id", "type").limit(around)
    return reduce(DataFrame.unionByName, (direct, out, into))


def pack_terms(nodes: DataFrame, edges: DataFrame, task: str, per_term: int = 3, area: str | None = None, bonus: int = 30) -> DataFrame:
    """(id, score): the best `per_term` nodes of each word of a task, each node once with its best
    score; nodes under `area` get a bonus."""
    found = []
    for word in tokens(task):
        ranked = text_rank(nodes, edges, word)
        score = F.col("score") + (F.when(in_scope(area), bonus).otherwise(0) if area else F.lit(0))
        order = [score.desc(), (F.col("in_degree") + F.col("out_degree")).desc(), F.col("name").asc(), F.col("id").asc()]
        found.append(ranked.withColumn("score", score).orderBy(F.col("score").desc(), *order[1:]).limit(per_term).select("id", "score"))
    return reduce(DataFrame.unionByName, found).groupBy("id").agg(F.max("score").alias("score"))


def candidate_order() -> list[Column]:
    """Order of packed candidates; scores equal to three places are ties."""
    return [F.round("score", 3).desc(), F.col("area").asc(), F.col("fan_in").desc(), F.col("id").asc()]


def change_severity(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(file_path, symbols, callers, severity) of changed files (file_path): distinct callers from
    other files decide the severity."""
    own = nodes.join(changed.select("file_path").distinct(), "file_path", "left_semi").select("id", "file_path")
    callers = edges.where("type = 'CALLS'").select("source_id", F.col("target_id").alias("id")).join(own, "id").join(nodes.select(F.col("id").alias("source_id"), F.col("file_path").alias("caller_file")), "source_id")
    per = callers.where("caller_file <> file_path").groupBy("file_path").agg(F.countDistinct("source_id").alias("callers"))
    rows = own.groupBy("file_path").agg(F.count("*").alias("symbols")).join(per, "file_path", "left").withColumn("callers", F.coalesce("callers", F.lit(0).cast("long")))
    n = F.col("callers")
    return rows.withColumn("severity", F.when(n >= 20, "critical").when(n >= 10, "high").when(n >= 3, "medium").otherwise("low"))


def changed_symbols(nodes: DataFrame, edges: DataFrame, changed: DataFrame, hot: DataFrame) -> DataFrame:
    """(id, callers, is_hot, severity, tier) of the symbols of changed files (file_path): distinct
    names that call them, whether they are among the hotspots (a frame with qualified_name), and
    how sure it is that others depend on them: confirmed by calls or imports, probable by other
    callers of the same folder, nominal otherwise."""
    c = F.col
    own = nodes.join(changed.select("file_path").distinct(), "file_path", "left_semi").select("id", "qualified_name", "file_path")
    into = edges.where(c("type").isin(*MODES["calls"], "IMPORTS")).select(c("target_id").alias("id"), "source_id", "type").join(own, "id")
    caller = nodes.select(c("id").alias("source_id"), c("name").alias("caller"), c("file_path").alias("from"))
    same = F.regexp_replace("from", "/?[^/]*$", "") == F.regexp_replace("file_path", "/?[^/]*$", "")
    calls = c("type") != "IMPORTS"
    per = into.join(caller, "source_id").groupBy("id").agg(F.countDistinct(F.when(calls, c("caller"))).alias("callers"), F.count_if(c("type").isin("CALLS", "IMPORTS")).alias("sure"), F.count_if(calls & same).alias("near"))
    rows = own.join(per, "id", "left").join(hot.select("qualified_name", F.lit(True).alias("hot")).distinct(), "qualified_name", "left")
    n, is_hot = F.coalesce("callers", F.lit(0).cast("long")), F.coalesce("hot", F.lit(False))
    severity = F.when(is_hot | (n >= 20), "critical").when(n >= 10, "high").when(n >= 3, "medium").otherwise("low")
    tier = F.when(c("sure") > 0, "confirmed").when(c("near") > 0, "probable").otherwise("nominal")
    return rows.select("id", n.alias("callers"), is_hot.alias("is_hot"), severity.alias("severity"), tier.alias("tier"))


def change_risk(symbols: DataFrame) -> DataFrame:
    """One row over `changed_symbols`: how many there are of each tier, and the risk of the change."""
    c = F.col
    counted = symbols.agg(F.count("*").alias("symbols"), *(F.count_if(c("tier") == t).alias(t) for t in ("confirmed", "probable", "nominal")), F.count_if(c("severity") == "critical").alias("critical"), F.count_if(c("is_hot") | (c("severity") == "high")).alias("grave"))
    return counted.select("symbols", "confirmed", "probable", "nominal", F.when(c("critical") > 0, "critical").when(c("grave") > 0, "high").otherwise("low").alias("risk"))


def change_buckets(status: DataFrame) -> DataFrame:
    """(bucket, path) of status rows, one per path (path, staged, unstaged, change): a rename is no
    deletion, and what is both staged and not is in both buckets of changes."""
    c = F.col
    special = F.when(c("change") == "renamed", "renamed").when(c("change") == "deleted", "deleted").when(c("change") == "untracked", "untracked")
    plain = F.filter(F.array(F.when(c("staged") | ~c("unstaged"), "tracked"), F.when(c("unstaged"), "unstaged")), lambda b: b.isNotNull())
    return status.select(F.explode(F.when(special.isNotNull(), F.array(special)).otherwise(plain)).alias("bucket"), "path")


#: Bytes taken for a file whose size isn't known, and bytes of a token.
UNKNOWN_BYTES, TOKEN_BYTES = 3600, 4


def tokens_of_files(files: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, tokens, files, confidence) of answers by the files (id, file) they spare reading; sizes
    is (file, size). More files make the estimate surer."""
    known = sizes.where("size > 0").groupBy("file").agg(F.max("size").alias("size"))
    per = files.join(known, "file", "left").groupBy("id").agg(F.sum(F.coalesce("size", F.lit(UNKNOWN_BYTES))).alias("bytes"), F.count("*").alias("files"))
    sure = F.when(F.col("files") >= 12, "high").when(F.col("files") >= 4, "medium").otherwise("low")
    return per.select("id", F.floor(F.col("bytes") / TOKEN_BYTES + 0.5).alias("tokens"), "files", sure.alias("confidence"))


def allowed_rows(shared: DataFrame, grants: DataFrame) -> DataFrame:
    """Rows of a second provider that its grants (project) allow; without grants none."""
    return shared.join(grants.select("project").distinct(), "project", "left_semi")


def member_calls(calls: DataFrame, members: DataFrame, aliases: DataFrame) -> DataFrame:
    """(call_id, id) of calls (call_id, owner, name, lang) on a named owner: the only member (id,
    owner, name, lang) of that owner and name in the language. An owner that is an alias (alias,
    target) with one target stands for it."""
    one = aliases.groupBy(F.col("alias").alias("owner")).agg(F.countDistinct("target").alias("k"), F.min("target").alias("target")).where("k = 1").drop("k")
    named = calls.join(one, "owner", "left").select("call_id", F.coalesce("target", "owner").alias("owner"), "name", "lang")
    only = members.groupBy("owner", "name", "lang").agg(F.count("*").alias("k"), F.min("id").alias("id")).where("k = 1").drop("k")
    return named.join(only, ["owner", "name", "lang"]).select("call_id", "id")


def unique_same_file(calls: DataFrame, nodes: DataFrame, shadows: DataFrame) -> DataFrame:
    """Calls (call_id, file, owner, name) to the only callable of that name in their file, unless
    the caller shadows the name (file, owner, name)."""
    one = nodes.where("kind in ('Function', 'Method')").groupBy(F.col("file_path").alias("file"), "name").agg(F.count("*").alias("n"), F.min("id").alias("target_id")).where("n = 1").drop("n")
    return calls.join(one, ["file", "name"]).join(shadows.select("file", "owner", "name"), ["file", "owner", "name"], "left_anti").select("call_id", "target_id")


def implementations(declarations: DataFrame, definitions: DataFrame, known: DataFrame) -> DataFrame:
    """(decl_id, id): a header's declaration (decl_id, name, lang) and the only exported definition
    (id, name, lang) of that name, where the name is declared once and no edge (decl_id) is known."""
    single = declarations.withColumn("n", F.count("*").over(Window.partitionBy("name", "lang"))).where("n = 1").drop("n")
    one = definitions.groupBy("name", "lang").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")
    return single.join(known.select("decl_id"), "decl_id", "left_anti").join(one, ["name", "lang"]).select("decl_id", "id")


def suffix_either_way(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b) pairs of paths one of which ends with the other at a slash: every suffix of each
    side is joined to whole paths of the other, never all with all."""

    def cut(rows: DataFrame, c: str) -> DataFrame:
        parts = F.split(c, "/")
        return rows.select(c, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("s"))

    left, right = a.select("a").distinct(), b.select("b").distinct()
    return cut(left, "a").join(right, F.col("s") == F.col("b")).select("a", "b").unionByName(cut(right, "b").join(left, F.col("s") == F.col("a")).select("a", "b")).distinct()


def digest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, name, n): totals, the most frequent edge types, the nodes of most edges and the files
    of most nodes."""
    total = nodes.agg(F.lit("total").alias("part"), F.lit("nodes").alias("name"), F.count("*").alias("n")).unionByName(edges.agg(F.lit("total").alias("part"), F.lit("edges").alias("name"), F.count("*").alias("n")))
    types = edges.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "name").limit(16).select(F.lit("type").alias("part"), "name", "n")
    busy = with_degrees(nodes, edges).select(F.lit("node").alias("part"), F.col("qualified_name").alias("name"), (F.col("in_degree") + F.col("out_degree")).alias("n")).orderBy(F.col("n").desc(), "name").limit(20)
    files = nodes.groupBy(F.col("file_path").alias("name")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "name").limit(18).select(F.lit("file").alias("part"), "name", "n")
    return reduce(DataFrame.unionByName, (total, types, busy, files))


def changed_ratio(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: the share of digest entries (part, name, n) that differ between two digests."""
    both = before.withColumnRenamed("n", "a").join(after.withColumnRenamed("n", "b"), ["part", "name"], "full")
    return both.agg(F.round(F.count_if(~F.col("a").eqNullSafe(F.col("b"))) / F.greatest(F.count("*"), F.lit(1)), 4).alias("ratio"))


def freshness(projects: DataFrame, now: str, stale_hours: int = 24) -> DataFrame:
    """(project, freshness) of (project, status, indexed_at, indexed_commit, head, nodes): empty,
    failed, moved where the head is another commit, stale by age, unknown without a time, fresh."""
    c = F.col
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(c("indexed_at").cast("timestamp"))
    state = F.when(F.coalesce(c("nodes"), F.lit(0)) == 0, "empty").when(c("status") == "failed", "failed").when(c("head").isNotNull() & c("indexed_commit").isNotNull() & (c("head") != c("indexed_commit")), "moved")
    return projects.select("project", state.when(age.isNull(), "unknown").when(age > stale_hours * 3_600_000_000, "stale").otherwise("fresh").alias("freshness"))


def upsert_records(stored: DataFrame, incoming: DataFrame, key: list[str], order: str) -> DataFrame:
    """Records (decisions, notes) with the incoming ones in place of those of the same key; of
    several incoming ones the last by `order` counts."""
    newest = Window.partitionBy(*key).orderBy(F.col(order).desc_nulls_last())
    fresh = incoming.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")
    return stored.join(fresh.select(*key), key, "left_anti").select(*stored.columns).unionByName(fresh.select(*stored.columns))


def value_layers(rows: DataFrame) -> DataFrame:
    """(id, observed, likely, maximum, status) of tool results (id, tokens, potential, files, symbols,
    calls, other_relations, results, confidence, conflict): tokens saved as observed, what a search
    of the project may have cost, and how far relations back the result."""
    c = F.col
    zero = lambda name: F.coalesce(c(name), F.lit(0)).cast("double")
    observed = F.greatest(zero("tokens"), F.lit(0.0))
    density = F.when(zero("files") > 0, zero("symbols") / zero("files")).otherwise(0.0)
    # fixed values of the estimate: the search space counts by its logarithm, within bounds
    search = F.round(F.least(F.lit(1200.0), 90 * F.log2(F.greatest(zero("files") + 1, F.lit(2.0))) + F.least(density * 8, F.lit(480.0))))
    whole = F.greatest(observed, zero("potential"))
    likely = F.when(whole > observed, F.round(observed + (whole - observed) * 0.35)).otherwise(observed + search)
    empty = (observed == 0) & (zero("results") + zero("calls") == 0)
    backed = (zero("calls") > 0) & (zero("other_relations") == 0) & c("confidence").isin("high", "medium")
    status = F.when(F.coalesce(c("conflict"), F.lit(False)), "conflicting_evidence").when(empty, "evidence_gap").when(F.coalesce(backed, F.lit(False)), "confirmed").otherwise("partial")
    return rows.select("id", observed.alias("observed"), likely.alias("likely"), F.when(whole > observed, whole).otherwise(F.round(likely * 1.3)).alias("maximum"), status.alias("status"))


def snippets(nodes: DataFrame, edges: DataFrame, sources: DataFrame, wanted: DataFrame, around: int = 0, limit: int = 20) -> DataFrame:
    """(id, snippet, callers, callees) of wanted symbols (id): their lines in sources (file_path,
    content) with `around` more on either side, null without a source, and the first `limit`
    distinct names on either side of their calls, by name."""
    c = F.col
    own = nodes.join(wanted.select("id").distinct(), "id", "left_semi").select("id", "file_path", "start_line", "end_line")
    text = sources.groupBy("file_path").agg(F.min("content").alias("content"))
    calls, names = edges.where(c("type").isin(*MODES["calls"])).select("source_id", "target_id"), nodes.select("id", "name")

    def side(at: str, other: str, label: str) -> DataFrame:
        found = calls.select(c(at).alias("id"), c(other).alias("other")).join(own.select("id"), "id", "left_semi").join(names.select(c("id").alias("other"), "name"), "other").select("id", "name").distinct()
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("name"))).where(c("rank") <= limit)
        return ranked.groupBy("id").agg(F.array_sort(F.collect_list("name")).alias(label))

    rows = own.join(text, "file_path", "left").join(side("target_id", "source_id", "callers"), "id", "left").join(side("source_id", "target_id", "callees"), "id", "left")
    none = F.array().cast("array<string>")
    return rows.select("id", snippet(c("content"), c("start_line"), c("end_line"), around).alias("snippet"), F.coalesce("callers", none).alias("callers"), F.coalesce("callees", none).alias("callees"))


def index_status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per project: nodes, edges, files and the status of its index."""
    n = nodes.groupBy("project").agg(F.count("*").alias("nodes"), F.countDistinct("file_path").alias("files"))
    e = edges.groupBy("project").agg(F.count("*").alias("edges"))
    rows = n.join(e, "project", "full").fillna(0, ["nodes", "files", "edges"])
    return rows.withColumn("status", F.when(F.col("nodes") == 0, "empty").when(F.col("edges") == 0, "unresolved").otherwise("ready"))


def findings_matching(findings: DataFrame, text: str | None = None, file: str | None = None, category: str | None = None, limit: int = 20) -> DataFrame:
    """Findings (id, target_file, category, title, description, created_at), newest first, that
    contain any word of three or more letters of `text`."""
    tests = []
    words = [w for w in tokens(text or "") if len(w) >= 3]
    if words:
        tests.append(reduce(Column.__or__, (F.lower(c).contains(w) for w in words for c in ("title", "description"))))
    tests += [F.col("target_file") == file] if file else []
    tests += [F.col("category") == category] if category else []
    rows = findings.where(reduce(Column.__and__, tests)) if tests else findings
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object per line; null fields are kept."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def markdown(rows: DataFrame, limit: int = 50) -> str:
    """A report table of the first rows of an ordered frame."""
    cells = [[("" if v is None else str(v)).replace("|", "\\|") for v in r] for r in rows.limit(limit).collect()]
    return "\n".join("| " + " | ".join(line) + " |" for line in (rows.columns, ["-"] * len(rows.columns), *cells))
