"""Search over the graph's nodes: structured filters, ranked text, fuzzy ranking, paging.

All predicates and scores are column expressions; degrees come from one aggregation of the
edges, joined once. Every order ends with the node id, so a page is the same on every run.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a kind adds to a node's rank, and the words a query drops.
KIND_BOOST = {"Function": 10, "Method": 10, "Route": 8, "Class": 5, "Interface": 5, "Type": 3, "Enum": 3, "Variable": 1}
TEXT_BOOST = {"Function": 10, "Method": 10, "Route": 8, "Class": 5, "Interface": 5, "Type": 3, "Enum": 3}
FUZZY_BOOST = {"Route": 5, "Function": 3, "Method": 3, "Class": 2}
FUZZY_KINDS = ("Function", "Method", "Class", "Interface", "Variable", "Route")
STOPWORDS = ("how", "what", "where", "who", "when", "the", "is", "are", "to", "of", "in", "on", "for", "with", "and", "or")


def by_kind(boost: dict[str, float], default: float = 0) -> Column:
    """The boost of the node's kind."""
    cases = [F.when(F.col("kind").isin(*[k for k, v in boost.items() if v == b]), F.lit(b)) for b in sorted(set(boost.values()))]
    return F.coalesce(*cases, F.lit(default))


def tokens(query: str, split_camel: bool = False) -> list[str]:
    """Distinct lower-case words of at least two letters that aren't stopwords."""
    parts = re.split(r"[\s_\-.:/\\]+", query)
    if split_camel:
        parts = [w for p in parts for w in (*re.split(r"(?=[A-Z])", p), p)]
    return [w for w in dict.fromkeys(p.lower() for p in parts) if len(w) >= 2 and w not in STOPWORDS]


_WILD = re.compile(r"(?P<any>\\?\.\\?[*+])|(?P<some>\\[dw]\+)|(?P<one>\\[dw]|\.)|(?P<dot>\\\.)|(?P<meta>[_%])|(?P<plain>.)", re.S)


def like_of_regex(pattern: str) -> str:
    """A LIKE pattern for a simple regular expression; raises on what LIKE can't express. A
    pattern without regex signs is a LIKE pattern already; one without wildcards is sought
    anywhere."""
    if re.search(r"[\[\](){}|?]", pattern):
        raise ValueError(f"{pattern!r} has no LIKE form")
    if not re.search(r"[.^$]|\\[dwDW]", pattern):
        return pattern
    body = pattern[1:] if pattern.startswith("^") else pattern
    body = body[:-1] if body.endswith("$") else body
    made, wild = [], False
    for m in _WILD.finditer(body):
        kind = m.lastgroup
        wild |= kind in ("any", "some", "one", "meta")
        made.append({"any": "%", "some": "_%", "one": "_", "dot": ".", "meta": "\\" + m[0]}.get(kind, m[0]))
    like = "".join(made)
    return like if wild else f"%{like}%"


def path_like(glob: str) -> str:
    """A LIKE pattern that finds a path glob anywhere in a path."""
    return "%" + glob.replace("*", "%").replace("?", "_") + "%"


def in_scope(prefix: str, col: str = "file_path") -> Column:
    """The path lies under a folder; pushed down as a prefix."""
    return F.col(col).startswith(prefix.rstrip("/") + "/")


def overlaps(file: str, first: int, last: int) -> Column:
    """The node's lines meet those of a file's range."""
    return (F.col("file_path") == file) & (F.col("start_line") <= last) & (F.col("end_line") >= first)


def degrees(edges: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """(id, in_degree, out_degree) of every node with an edge: each edge is counted once at
    either end, in one aggregation."""
    rows = edges.where(F.col("type").isin(*types)) if types else edges
    ends = rows.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def with_degrees(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """Nodes with in_degree and out_degree, 0 where there is no edge."""
    zero = F.lit(0).cast("long")
    joined = nodes.join(degrees(edges, types), "id", "left")
    return joined.withColumns({c: F.coalesce(c, zero) for c in ("in_degree", "out_degree")})


def structured_search(
    nodes: DataFrame,
    edges: DataFrame,
    *,
    kind: str | None = None,
    name_regex: str | None = None,
    qn_regex: str | None = None,
    name_like: str | None = None,
    qn_like: str | None = None,
    path_glob: str | None = None,
    min_degree: int | None = None,
    max_degree: int | None = None,
    exclude_entry_points: bool = False,
    any_token: list[str] | None = None,
    relationship: str | None = None,
) -> DataFrame:
    """Nodes that meet all given conditions, with degrees. Folders and modules are only found
    when asked for by kind."""
    tests = [F.col("kind") == kind if kind else ~F.col("kind").isin("Folder", "Module")]
    for col, like in (("name", name_regex and like_of_regex(name_regex)), ("qualified_name", qn_regex and like_of_regex(qn_regex)), ("name", name_like), ("qualified_name", qn_like), ("file_path", path_glob and path_like(path_glob))):
        if like:
            tests.append(F.col(col).ilike(like))
    if exclude_entry_points:
        tests.append(F.coalesce("is_entry_point", F.lit(0)) == 0)
    if any_token:
        tests.append(reduce(Column.__or__, (F.lower(c).contains(t) for t in any_token for c in ("name", "qualified_name"))))
    found = nodes.where(reduce(Column.__and__, tests))
    if relationship:
        of_type = edges.where(F.col("type") == relationship)
        ends = of_type.select(F.explode(F.array("source_id", "target_id")).alias("id"))
        found = found.join(ends, "id", "left_semi")
    found = with_degrees(found, edges)
    degree = F.col("in_degree") + F.col("out_degree")
    if min_degree is not None:
        found = found.where(degree >= min_degree)
    if max_degree is not None:
        found = found.where(degree <= max_degree)
    return found


ORDERS = {
    "relevance": lambda: [by_kind(KIND_BOOST).desc(), F.col("name").asc(), F.col("id").asc()],
    "name": lambda: [F.col("name").asc(), F.col("id").asc()],
    "degree": lambda: [(F.col("in_degree") + F.col("out_degree")).desc(), F.col("name").asc(), F.col("id").asc()],
}


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of a total order; `limit` is kept within 1 and 200."""
    return rows.orderBy(*order).offset(offset).limit(max(1, min(limit, 200)))


def text_rank(nodes: DataFrame, edges: DataFrame, query: str) -> DataFrame:
    """Nodes that contain a word of the query, with `score`: 8 per word in the name, 4 in the
    qualified name, 3 in the path, plus the kind's boost."""
    words = tokens(query)
    hits = [(F.lower(c).contains(w), points) for w in words for c, points in (("name", 8), ("qualified_name", 4), ("file_path", 3))]
    if not hits:
        return with_degrees(nodes.where("false"), edges).withColumn("score", F.lit(0))
    found = nodes.where(reduce(Column.__or__, (h for h, _ in hits)))
    score = reduce(Column.__add__, (F.when(h, p).otherwise(0) for h, p in hits)) + by_kind(TEXT_BOOST)
    return with_degrees(found, edges).withColumn("score", score)


def trigram_overlap(text: Column, word: str) -> Column:
    """Share of the word's trigrams, repeats counted, that occur in the text."""
    grams = [word[i : i + 3] for i in range(len(word) - 2)]
    if not grams:
        return F.lit(0.0)
    return reduce(Column.__add__, (F.when(text.contains(g), 1.0).otherwise(0.0) for g in grams)) / float(len(grams))


def direct_match(text: Column, word: str) -> Column:
    """The word, or its singular, stands in the text."""
    found = text.contains(word)
    return found | text.contains(word[:-1]) if len(word) >= 4 and word.endswith("s") else found


def fuzzy_rank(nodes: DataFrame, edges: DataFrame, query: str, findings: DataFrame | None = None) -> DataFrame:
    """Callable and type nodes with a `score` from words in name and qualified name, trigram
    overlap, coverage of the query's words, kind, fan-in, complexity, findings (a frame with
    target_qn) and tests. Nothing is found where no meaningful word of three or more occurs
    directly in any node."""
    words = tokens(query)
    meaningful = [w for w in words if len(w) >= 3]
    name, qn = F.lower("name"), F.lower("qualified_name")
    rows = nodes.where(F.col("kind").isin(*FUZZY_KINDS))

    def points(w: str) -> Column:
        prefix = 1.0 if len(w) >= 4 else 0.4
        in_name = F.lit(2.0) + F.when(name == w, 3.0).when(name.startswith(w), prefix).otherwise(0.0)
        near = trigram_overlap(name, w)
        fuzzy = F.when(near >= 0.4, near * 1.5).otherwise(0.0) if len(w) >= 3 else F.lit(0.0)
        return F.when(name.contains(w), in_name).when(qn.contains(w), 1.0).otherwise(fuzzy)

    matched = reduce(Column.__add__, (points(w) for w in words), F.lit(0.0))
    covered = reduce(Column.__add__, ((direct_match(name, w) | direct_match(qn, w)).cast("int") for w in meaningful), F.lit(0))
    rows = rows.withColumns({"matched": matched, "covered": covered}).where("matched > 0")
    if len(meaningful) >= 3:
        some = rows.where("covered > 0").limit(1).select(F.lit(1).alias("direct"))
        rows = rows.join(F.broadcast(some)).drop("direct")  # one row or none
    fan_in = edges.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("fan_in"))
    rows = rows.join(fan_in, "id", "left").withColumn("fan_in", F.coalesce("fan_in", F.lit(0).cast("long")))
    if findings is None:
        rows = rows.withColumn("found", F.lit(False))
    else:
        rows = rows.join(findings.select(F.col("target_qn").alias("qualified_name"), F.lit(True).alias("found")).distinct(), "qualified_name", "left")
    complexity = F.coalesce(F.get_json_object("properties", "$.cyclomaticComplexity").try_cast("double"), F.lit(0.0))
    test = F.col("file_path").contains(".test.") | F.col("file_path").contains(".spec.") | F.col("file_path").contains("__tests__")
    exported = F.col("qualified_name").contains(".") & ~F.col("qualified_name").contains("..")
    score = (
        F.col("matched")
        + (F.col("covered") * (48.0 / len(meaningful)) if meaningful else F.lit(0.0))
        + by_kind(FUZZY_BOOST)
        + F.least("fan_in", F.lit(20)) * 0.5
        + F.least(complexity, F.lit(100.0)) * 0.1
        + F.when(F.col("found"), 2).otherwise(0)
        + F.when(exported, 1).otherwise(0)
        - F.when(test, 5).otherwise(0)
        - F.when((F.length("name") <= 2) & (F.col("kind") == "Variable"), 3).otherwise(0)
    )
    return rows.withColumn("score", F.round(score, 2))


def ambiguous(scored: DataFrame, share: float, gap: float = 1.0) -> DataFrame:
    """One row: whether the best score leads the next by at most `gap` or `share` of itself."""
    top = scored.orderBy(F.col("score").desc()).limit(2).agg(F.sort_array(F.collect_list("score"), False).alias("s"))
    first, second = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    return top.select(F.coalesce((first - second <= gap) | (first - second <= first.cast("double") * share), F.lit(False)).alias("ambiguous"))


def code_score(in_degree: Column) -> Column:
    """Rank of a text match's enclosing symbol."""
    vendored = F.col("file_path").rlike("(^|/)(vendor|node_modules|third_party)/")
    test = F.col("file_path").rlike("(^|/)tests?/|[.](test|spec)[.]")
    return in_degree + by_kind({"Function": 10, "Method": 10, "Route": 15, "Class": 5}) - F.when(vendored, 50).otherwise(0) - F.when(test, 5).otherwise(0)


def enclosing_symbols(matches: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each match (file_path, line, ...) with the smallest symbol whose lines enclose it, null
    without one. The range condition is tested within one file only; ties go to the id. Equal
    matches are looked up once, by their own columns, and come out as often as they went in."""
    keyed = matches.groupBy(*matches.columns).agg(F.count("*").alias("_times"))
    spans = nodes.where("kind not in ('File', 'Folder', 'Module')").select(F.col("file_path").alias("_file"), "start_line", "end_line", F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "id", "name", "qualified_name", "kind").alias("_s"))
    inside = keyed.join(spans, (F.col("file_path") == F.col("_file")) & F.col("line").between(F.col("start_line"), F.col("end_line")), "left")
    found = inside.groupBy(*matches.columns, "_times").agg(F.min("_s").alias("_s"))
    out = found.withColumn("_each", F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int"))))
    return out.select(*matches.columns, "_s.id", "_s.name", "_s.qualified_name", "_s.kind")
