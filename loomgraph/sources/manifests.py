"""File manifests, change classification and dependency manifests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.texts import normal_list  # noqa: F401  (part of this module's surface)

# Folders that are never read, further ones and extensions that the fast mode leaves
# out, and languages by extension and by file name.
EXCLUDED = (
    "node_modules", ".git", ".claude", ".next", ".next-build", "dist", "build", "out", "obj", "target", "tmp", "temp", ".tmp", "tmp_build",
    "vendor", "vendored", "backups", "reports", "logs", ".turbo", "__pycache__", ".venv", "venv", ".cache", "coverage", ".nyc_output", ".idea", ".vscode",
)
FAST_EXCLUDED, FAST_EXTENSIONS = ("docs", "examples", "fixtures", "test", "tests", "__tests__"), ("md", "json", "yml", "yaml", "toml", "lock", "css", "html")
LANGUAGES = {
    "py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp", "rb": "ruby", "php": "php", "cs": "csharp", "swift": "swift",
    "kt": "kotlin", "kts": "kotlin", "scala": "scala", "sh": "bash", "bash": "bash", "zsh": "bash", "ps1": "powershell", "sql": "sql", "lua": "lua", "pl": "perl", "pm": "perl", "r": "r", "jl": "julia", "dart": "dart",
    "ex": "elixir", "exs": "elixir", "erl": "erlang", "hs": "haskell", "ml": "ocaml", "mli": "ocaml", "fs": "fsharp", "clj": "clojure", "groovy": "groovy", "gradle": "groovy", "zig": "zig", "nim": "nim", "m": "objc", "mm": "objc",
    "vue": "vue", "svelte": "svelte", "html": "html", "css": "css", "scss": "scss", "less": "less", "json": "json", "yml": "yaml", "yaml": "yaml", "toml": "toml", "xml": "xml", "md": "markdown", "proto": "protobuf", "graphql": "graphql", "tf": "hcl",
}
FILE_NAMES = {"dockerfile": "dockerfile", "makefile": "make", "cmakelists.txt": "cmake", "rakefile": "ruby", "gemfile": "ruby", "jenkinsfile": "groovy"}
MAX_BYTES = 10_000_000


def language(path: Column) -> Column:
    """Language of a path by its file name, else by its extension, null for others."""
    table = lambda names, key: F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), key)
    return F.coalesce(table(FILE_NAMES, F.lower(F.regexp_extract(path, r"[^/]*$", 0))), table(LANGUAGES, F.lower(F.regexp_extract(path, r"[.]([A-Za-z0-9]+)$", 1))))


def kept_paths(files: DataFrame, fast: bool = False, extra_excluded: tuple[str, ...] = ()) -> DataFrame:
    """Rows (path relative to the root, ...) of files outside excluded and hidden folders, of nested
    repositories (folders that hold a .git file or folder) and of folders that an ignore file
    names by a plain entry (rows of .gitignore have their `content`). Folders are looked up by
    joining each file's own folders, not file by file."""
    parts = F.split("path", "/")
    bad = F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda f: f.isin(*EXCLUDED, *extra_excluded, *(FAST_EXCLUDED if fast else ())) | f.startswith("."))
    nested = files.select(F.regexp_extract("path", r"^(.+)/[.]git(/|$)", 1).alias("folder")).where("folder <> ''")
    lines = files.where(F.col("path").rlike(r"(^|/)[.]gitignore$")).select(F.regexp_extract("path", r"^(.*/)?[^/]*$", 1).alias("at"), F.explode(F.split("content", r"\r?\n")).alias("line"))
    plain = lines.select(F.concat("at", F.regexp_replace(F.trim("line"), "^/|/$", "")).alias("folder"), "line").where(F.trim("line").rlike(r"^/?[\w.-]+(/[\w.-]+)*/?$"))
    closed = nested.unionByName(plain.select("folder")).distinct()
    rows = files.where(~bad)
    if fast:
        rows = rows.where(~F.lower(F.regexp_extract("path", r"[.]([A-Za-z0-9]+)$", 1)).isin(*FAST_EXTENSIONS))
    folders = rows.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("folder"))
    return rows.join(folders.join(closed, "folder", "left_semi").select("path").distinct(), "path", "left_anti")


def _hidden(spark: SparkSession, root: str, name: str, depth: int) -> list:
    """Paths of hidden entries of a name down to a depth, which file sources of Spark skip. Only
    names are listed, on the driver, as for any table."""
    out = []
    for level in range(depth + 1):
        pattern = spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/*" * level + "/" + name)
        found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
        out += [s.getPath() for s in found or []]
    return out


def discover(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, extra_excluded: tuple[str, ...] = (), fast: bool = False, depth: int = 12) -> DataFrame:
    """(path, language, size, sha256, content) of the source files under `root`: `kept_paths`, no
    large files, known languages only. Files are read by the executors; ignore files and nested
    repositories are looked for down to `depth` folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^[a-z0-9]+:/*", "/", root).rstrip("/") + "/"
    rel = F.regexp_replace("path", "^.*?" + re.escape(base), "")
    none = F.lit(None)
    listed = files.where(F.col("length") <= max_bytes).select(rel.alias("path"), F.col("length").alias("size"), F.col("content").alias("bytes"), none.cast("string").alias("content"))
    text = lambda p: spark._jvm.org.apache.commons.io.IOUtils.toString(p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p), "UTF-8")
    marks = [(p.toString(), text(p)) for p in _hidden(spark, root, ".gitignore", depth)] + [(p.toString(), None) for p in _hidden(spark, root, ".git", depth)]
    if marks:
        shown = spark.createDataFrame(marks, "path string, content string").select(rel.alias("path"), none.cast("long").alias("size"), none.cast("binary").alias("bytes"), "content")
        listed = listed.unionByName(shown.where("path <> '.git'"))
    rows = kept_paths(listed, fast, extra_excluded).where("bytes is not null").withColumn("language", language(F.col("path"))).where("language is not null")
    return rows.select("path", "language", "size", F.sha2("bytes", 256).alias("sha256"), F.decode("bytes", "UTF-8").alias("content"))


def stale_files(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Files of (path, sha256) whose hash isn't the stored one: those to extract again."""
    return current.join(stored.select("path", "sha256"), ["path", "sha256"], "left_anti")


def classify_changes(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change, old_path): added, modified, deleted, or renamed where exactly one deleted
    and one added file have one hash."""
    both = stored.select("path", F.col("sha256").alias("old")).join(current.select("path", F.col("sha256").alias("new")), "path", "full")
    modified = both.where("old <> new").select("path", F.lit("modified").alias("change"), F.lit(None).cast("string").alias("old_path"))
    gone, fresh = both.where("new is null"), both.where("old is null")
    one = lambda rows, h, name: rows.groupBy(F.col(h).alias("hash")).agg(F.min("path").alias(name), F.count("*").alias("n")).where("n = 1").drop("n")
    renamed = one(gone, "old", "old_path").join(one(fresh, "new", "path"), "hash").select("path", F.lit("renamed").alias("change"), "old_path")
    deleted = gone.select("path").join(renamed.select(F.col("old_path").alias("path")), "path", "left_anti").select("path", F.lit("deleted").alias("change"), F.lit(None).cast("string").alias("old_path"))
    added = fresh.select("path").join(renamed.select("path"), "path", "left_anti").select("path", F.lit("added").alias("change"), F.lit(None).cast("string").alias("old_path"))
    return modified.unionByName(renamed).unionByName(deleted).unionByName(added)


def package_json(files: DataFrame) -> DataFrame:
    """(path, name, version, dev) of the dependencies of package.json texts; broken ones give none."""
    kinds = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    rows = files.where(F.col("path").rlike(r"(^|/)package[.]json$")).select("path", kinds.alias("k"))
    part = lambda key, dev: rows.select("path", F.explode(f"k.{key}").alias("name", "version"), F.lit(dev).alias("dev"))
    return part("dependencies", False).unionByName(part("devDependencies", True))


def requirements(files: DataFrame) -> DataFrame:
    """(path, name, version) of requirements.txt lines; comments, options and blanks are skipped."""
    lines = files.where(F.col("path").rlike(r"(^|/)requirements[^/]*[.]txt$")).select("path", F.explode(F.split("content", r"\r?\n")).alias("line"))
    bare = F.trim(F.regexp_replace("line", "#.*$", ""))
    rows = lines.withColumn("line", bare).where("line <> '' and line not like '-%'")
    return rows.select("path", F.regexp_extract("line", r"^([^=<>~!\[;\s]+)", 1).alias("name"), F.regexp_extract("line", r"[=<>~!]=?\s*([^;\s]+)", 1).alias("version"))


def dependency_edges(dependencies: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source_id, dependency, type, dev) from the files of manifests (path, name, dev) to the names
    they depend on, each once; a name that is wanted at run time is no development dependency."""
    files = nodes.where("kind = 'File'").groupBy(F.col("file_path").alias("path")).agg(F.min("id").alias("source_id"))
    rows = dependencies.where("name <> ''").join(files, "path").groupBy("source_id", F.col("name").alias("dependency")).agg(F.bool_and("dev").alias("dev"))
    return rows.select("source_id", "dependency", F.lit("DEPENDS_ON").alias("type"), "dev")


def name_status(lines: DataFrame, column: str = "value") -> DataFrame:
    """(path, old_path, change) of name-status lines (a letter, then tab-separated paths)."""
    parts = F.split(F.col(column), "\t")
    letter = F.substring(column, 1, 1)
    change = F.coalesce(*(F.when(letter == a, F.lit(b)) for a, b in (("A", "added"), ("M", "modified"), ("D", "deleted"), ("R", "renamed"), ("C", "copied"), ("T", "modified"))))
    moved = letter.isin("R", "C")
    return lines.where(F.col(column).rlike(r"^[AMDRCT][0-9]*\t")).select(F.when(moved, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1))).alias("path"), F.when(moved, F.get(parts, F.lit(1))).alias("old_path"), change.alias("change")).where("path is not null")


def status_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(path, old_path, staged, unstaged, change) of short version-control status lines."""
    text = F.col(column)
    code, rest = F.substring(text, 1, 2), F.substring(text, 4, 1 << 20)
    plain = lambda c: F.regexp_replace(c, '^"|"$', "")
    moved = rest.contains(" -> ")
    x, y = F.substring(code, 1, 1), F.substring(code, 2, 1)
    change = F.when(code == "??", "untracked").when(code.contains("R"), "renamed").when(code.contains("D"), "deleted").when(code.contains("A"), "added").when(code.contains("U"), "conflicted").otherwise("modified")
    rows = lines.where(text.rlike(r"^[ MADRCUT?!]{2} .+"))
    return rows.select(plain(F.when(moved, F.substring_index(rest, " -> ", -1)).otherwise(rest)).alias("path"), F.when(moved, plain(F.substring_index(rest, " -> ", 1))).alias("old_path"), (~x.isin(" ", "?")).alias("staged"), ((y != " ") & (code != "??")).alias("unstaged"), change.alias("change"))


def merged_status(rows: DataFrame) -> DataFrame:
    """One row per path: staged or unstaged in any entry, and the gravest change."""
    order = ["conflicted", "deleted", "renamed", "added", "modified", "untracked"]
    rank = F.array_position(F.array(*(F.lit(c) for c in order)), F.col("change"))
    return rows.groupBy("path").agg(F.bool_or("staged").alias("staged"), F.bool_or("unstaged").alias("unstaged"), F.min_by("change", rank).alias("change"))


def benchmark_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, (reason, n) of the rejected lines) of a JSONL benchmark index."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.select(F.from_json("value", "timestamp string, project string, tasks int, valid boolean, cost double, _corrupt_record string", {"mode": "PERMISSIVE"}).alias("r"))
    reason = F.when(F.col("r._corrupt_record").isNotNull(), "malformed_json").when(~F.coalesce("r.valid", F.lit(False)), "invalid_flag").when(F.coalesce("r.tasks", F.lit(0)) <= 0, "legacy_empty_tasks")
    judged = parsed.withColumn("reason", reason)
    return judged.where("reason is null").select("r.timestamp", "r.project", "r.tasks", "r.cost"), judged.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def usage_log(spark: SparkSession, path: str, project: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, broken lines) of a JSONL usage log."""
    schema = "ts string, type string, project string, tokens_saved long, files array<string>, session_id string, event_id string, _corrupt_record string"
    lines = spark.read.text(path).where("trim(value) <> ''")
    rows = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    good = rows.where("_corrupt_record is null").drop("_corrupt_record")
    return good.where(F.col("project") == project) if project else good, rows.where("_corrupt_record is not null").select("_corrupt_record")


def drift(stored: DataFrame, current: DataFrame) -> DataFrame:
    """One row: entries that differ between two keyed frames (key, value), and the status."""
    both = stored.select("key", F.col("value").alias("a"), F.lit(1).alias("ia")).join(current.select("key", F.col("value").alias("b"), F.lit(1).alias("ib")), "key", "full")
    n = both.agg(F.count_if(F.col("ia").isNull() | F.col("ib").isNull() | ~F.col("a").eqNullSafe(F.col("b"))).alias("mismatches"), F.count("*").alias("n"))
    return n.withColumn("status", F.when(F.col("n") == 0, "unknown").when(F.col("mismatches") == 0, "clean").otherwise("drifted"))
