"""Bounded traversal and propagation: loops of joins whose state is written to the shared
folder after each round, so lineage doesn't grow and a lost executor costs one round."""

from __future__ import annotations

import mmap
import os
import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph_stats import tier
from loomgraph.session import written

DIRECTIONS = ("inbound", "outbound", "both")
MODES = {"calls": ("CALLS", "HTTP_CALLS", "ASYNC_CALLS"), "references": ("CALLS", "USAGE", "READS", "WRITES"), "tests": ("TESTS", "TESTS_FILE")}


#: Ids up to which a frontier is sent to every executor (32 bytes each); a larger one is shuffled.
FRONTIER_IDS = 500_000


def steps(edges: DataFrame, direction: str, types: tuple[str, ...] | None = None) -> DataFrame:
    """(at, to, type, way, edge): one row per edge and way in which it may be walked."""
    if direction not in DIRECTIONS:
        raise ValueError(direction)
    rows = edges.where(F.col("type").isin(*types)) if types else edges
    ends = {"outbound": ("source_id", "target_id"), "inbound": ("target_id", "source_id")}
    ways = [rows.select(F.col(at).alias("at"), F.col(to).alias("to"), "type", F.lit(way).alias("way"), F.col("id").alias("edge")) for way, (at, to) in ends.items() if direction in (way, "both")]
    return reduce(DataFrame.unionByName, ways)


def prepared(edges: DataFrame) -> DataFrame:
    """All steps of a graph, written once in the order of `at`: a hop then reads only the row
    groups that its frontier can lie in. For graphs that are walked more than once."""
    walk = steps(edges, "both")
    return written(walk.repartitionByRange("at").sortWithinPartitions("at"), "walk")


def _allowed(walk: DataFrame, direction: str, types: tuple[str, ...] | None) -> DataFrame:
    if direction not in DIRECTIONS:
        raise ValueError(direction)
    rows = walk.where(F.col("type").isin(*types)) if types else walk
    return rows if direction == "both" else rows.where(F.col("way") == direction)


def bfs(edges: DataFrame, start: DataFrame, direction: str = "outbound", types: tuple[str, ...] | None = None, max_depth: int = 3, max_results: int | None = None, walk: DataFrame | None = None) -> DataFrame:
    """(id, hop): the least number of steps from any start node (a frame with id); starts have
    hop 0. Every level joins the new frontier with the steps and drops what was visited.
    `max_results` ends the walk after the level that reaches so many nodes and keeps the nearest,
    of equal hops those of least id. `walk` is the graph's `prepared` steps; without it the
    edges themselves are read in each level."""
    allowed = _allowed(steps(edges, direction, types) if walk is None else walk, direction, types).select("at", "to")
    seen = written(start.select("id").distinct().withColumn("hop", F.lit(0)), "bfs")
    level = seen
    reached = None
    for hop in range(1, max_depth + 1):
        size = level.agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).first()
        reached = size["n"] if reached is None else reached + size["n"]
        if not size["n"] or (max_results is not None and reached - 1 >= max_results):
            break
        ids = level.select(F.col("id").alias("at"))
        near = allowed.where(F.col("at").between(size["a"], size["b"])).join(F.broadcast(ids) if size["n"] <= FRONTIER_IDS else ids, "at")
        found = near.select(F.col("to").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        level = written(found.withColumn("hop", F.lit(hop)), "bfs")
        seen = seen.unionByName(level)
    if max_results is None:
        return seen
    return seen.where("hop = 0").unionByName(seen.where("hop > 0").orderBy("hop", "id").limit(max_results))


def walked(edges: DataFrame, nodes: DataFrame, reached: DataFrame, direction: str = "outbound", types: tuple[str, ...] | None = None, max_depth: int = 3, walk: DataFrame | None = None) -> DataFrame:
    """(source_id, target_id, type, from_name, to_name, occurrences, hop): the edges a walk has
    passed, those out of every node that it went on from. Parallel edges are one row; `hop` is
    that of the nearer end. Edges to nodes that aren't stored are left out."""
    allowed = _allowed(steps(edges, direction, types) if walk is None else walk, direction, types)
    from_ = reached.where(F.col("hop") < max_depth).select(F.col("id").alias("at"), "hop")
    passed = allowed.join(from_, "at")
    out = F.col("way") == "outbound"
    ends = passed.select(F.when(out, F.col("at")).otherwise(F.col("to")).alias("source_id"), F.when(out, F.col("to")).otherwise(F.col("at")).alias("target_id"), "type", "edge", "hop")
    counted = ends.groupBy("source_id", "target_id", "type").agg(F.countDistinct("edge").alias("occurrences"), F.min("hop").alias("hop"))
    names = lambda end, name: nodes.select(F.col("id").alias(end), F.col("name").alias(name))
    return counted.join(names("source_id", "from_name"), "source_id").join(names("target_id", "to_name"), "target_id").select("source_id", "target_id", "type", "from_name", "to_name", "occurrences", "hop")


def risk(hop: Column) -> Column:
    return F.when(hop == 1, "CRITICAL").when(hop == 2, "HIGH").when(hop == 3, "MEDIUM").otherwise("LOW")


def found_symbol(nodes: DataFrame, name: str) -> DataFrame:
    """The nodes a name stands for: by qualified name, else by name in any case."""
    exact = nodes.where(F.col("qualified_name") == name)
    return exact if not exact.isEmpty() else nodes.where((F.lower("name") == name.lower()) & F.col("kind").isin("Function", "Method", "Class"))


def trace(nodes: DataFrame, edges: DataFrame, name: str, direction: str = "both", mode: str = "calls", max_depth: int = 3, include_tests: bool = False, walk: DataFrame | None = None) -> DataFrame:
    """(id, qualified_name, direction, hop, risk) of what a symbol reaches and is reached from.
    Mode 'auto' follows calls, and references where there is no call."""
    start = found_symbol(nodes, name)
    ways = ("inbound", "outbound") if direction == "both" else (direction,)

    def reach(mode: str) -> DataFrame:
        return reduce(DataFrame.unionByName, (bfs(edges, start, way, MODES[mode], max_depth, walk=walk).where("hop > 0").withColumn("direction", F.lit(way)) for way in ways))

    reached = reach("calls" if mode == "auto" else mode)
    if mode == "auto" and reached.isEmpty():
        reached = reach("references")
    rows = reached.join(nodes, "id")
    if not include_tests:
        rows = rows.where((F.coalesce("is_test", F.lit(0)) == 0) & ~F.col("file_path").rlike("(^|/)(tests?|__tests__)/|[.](test|spec)[.]"))
    return rows.select("id", "qualified_name", "direction", "hop", risk(F.col("hop")).alias("risk"))


def relations(passed: DataFrame) -> DataFrame:
    """(from_name, to_name, type, occurrences): the edges of a walk as relations of names."""
    return passed.groupBy("from_name", "to_name", "type").agg(F.sum("occurrences").alias("occurrences"))


def trace_entries(traced: DataFrame, nodes: DataFrame, passed: DataFrame) -> DataFrame:
    """(id, name, direction, hop, types, kind): a trace's nodes with the types of the walk's edges
    that touch their name, and whether one of these is a call."""
    ends = passed.select("type", F.explode(F.array_distinct(F.array("from_name", "to_name"))).alias("name")).groupBy("name").agg(F.sort_array(F.collect_set("type")).alias("types"))
    rows = traced.join(nodes.select("id", "name"), "id").join(ends, "name", "left")
    types = F.coalesce("types", F.array().cast("array<string>"))
    return rows.select("id", "name", "direction", "hop", types.alias("types"), F.when(F.array_contains(types, "CALLS"), "direct_call").otherwise("reference").alias("kind"))


def path_evidence(path: DataFrame, evidence: DataFrame) -> DataFrame:
    """The hops of a path (hop, edge, ...) with the number of evidence rows (edge_id, strength),
    the greatest strength and its tier; 0, null and null without evidence."""
    per = evidence.groupBy(F.col("edge_id").alias("edge")).agg(F.count("*").alias("evidence"), F.max("strength").alias("strength"))
    return path.join(per, "edge", "left").select(*path.columns, F.coalesce("evidence", F.lit(0).cast("long")).alias("evidence"), "strength", F.when(F.col("strength").isNotNull(), tier(F.col("strength"))).alias("tier"))


def shortest_path(edges: DataFrame, source: int, target: int, max_depth: int = 3, types: tuple[str, ...] = ("CALLS",), walk: DataFrame | None = None) -> DataFrame:
    """(hop, edge, source_id, target_id) of the shortest directed path, of several the one with
    the least edge ids from the start; no rows where there is none within `max_depth`. `walk` is
    the graph's `prepared` steps."""
    spark = edges.sparkSession
    out = _allowed(steps(edges, "outbound") if walk is None else walk, "outbound", types)
    rows = out.select(F.col("edge").alias("id"), F.col("at").alias("source_id"), F.col("to").alias("target_id"))
    level = spark.range(1).select(F.lit(source).cast("long").alias("id"), F.array().cast("array<long>").alias("via"))
    seen = level.select("id")
    for _ in range(max_depth):
        met = level.join(rows.withColumnRenamed("id", "edge"), level["id"] == rows["source_id"])
        found = met.select(F.col("target_id").alias("id"), F.concat("via", F.array("edge")).alias("via")).join(seen, "id", "left_anti")
        level = written(found.groupBy("id").agg(F.min("via").alias("via")), "path")
        seen = seen.unionByName(level.select("id"))
        if level.isEmpty() or not level.where(F.col("id") == target).isEmpty():
            break
    hit = level.where((F.col("id") == target) & (F.size("via") > 0)).select(F.posexplode("via").alias("at", "edge"))
    return hit.join(rows.withColumnRenamed("id", "edge"), "edge").select((F.col("at") + 1).alias("hop"), "edge", "source_id", "target_id")


def neighbour_names(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, callers, callees): numbers of distinct names called and calling."""
    rows = edges.where(F.col("type").isin(*MODES["calls"]))
    names = nodes.select("id", "name")
    callers = rows.join(names.withColumnRenamed("id", "source_id"), "source_id").groupBy(F.col("target_id").alias("id")).agg(F.countDistinct("name").alias("callers"))
    callees = rows.join(names.withColumnRenamed("id", "target_id"), "target_id").groupBy(F.col("source_id").alias("id")).agg(F.countDistinct("name").alias("callees"))
    zero = F.lit(0).cast("long")
    return callers.join(callees, "id", "full").select("id", F.coalesce("callers", zero).alias("callers"), F.coalesce("callees", zero).alias("callees"))


def transitive_depth(own: DataFrame, edges: DataFrame, max_rounds: int = 10) -> DataFrame:
    """(id, depth) with depth = max(own, 1 + the callees' depth) after at most `max_rounds`
    simultaneous rounds; `own` is (id, depth). Equal to any order of updates on graphs without
    cycles up to that depth."""
    calls = written(edges.where("type = 'CALLS' and source_id <> target_id").select("source_id", "target_id").distinct(), "calls")
    depth = written(own.select("id", "depth"), "depth")
    for _ in range(max_rounds):
        below = calls.join(depth.withColumnRenamed("id", "target_id"), "target_id").groupBy(F.col("source_id").alias("id")).agg((F.max("depth") + 1).alias("below"))
        raised = written(depth.join(below, "id", "left").select("id", F.greatest("depth", F.coalesce("below", F.col("depth"))).alias("depth")), "depth")
        if raised.join(depth.withColumnRenamed("depth", "before"), "id").where("depth > before").isEmpty():
            return raised
        depth = raised
    return depth


CLUSTERED = ("Function", "Method", "Class", "Interface", "Type")
CLUSTER_EDGES = ("CALLS", "IMPORTS", "HTTP_CALLS", "ASYNC_CALLS")


def _inside(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, source_id, target_id): the edges between clustered nodes. The nodes are joined by
    shuffle: by the bytes of their stored files, Spark would send all their ids by way of the driver."""
    kept = nodes.where(F.col("kind").isin(*CLUSTERED)).select("id", "project")
    rows = edges.where(F.col("type").isin(*CLUSTER_EDGES) & (F.col("source_id") != F.col("target_id"))).select("source_id", "target_id")
    sources, targets = kept.withColumnRenamed("id", "source_id").hint("merge"), kept.select(F.col("id").alias("target_id")).hint("merge")
    return rows.join(targets, "target_id").join(sources, "source_id").select("project", "source_id", "target_id")


def cluster_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, a, b): undirected links between clustered nodes, once from each side."""
    ends = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    return _inside(nodes, edges).select("project", F.explode(F.array(ends("source_id", "target_id"), ends("target_id", "source_id"))).alias("l")).select("project", "l.a", "l.b")


def label_propagation(nodes: DataFrame, edges: DataFrame, max_rounds: int = 30) -> DataFrame:
    """(id, label): communities by synchronous label propagation at any size. A node takes the
    most frequent label among its neighbours, of several the least; odd and even rounds move
    nodes of odd and even hash only, which keeps two-sided groups from swapping for ever."""
    links = written(cluster_links(nodes, edges).select("a", "b"), "links")
    label = written(nodes.where(F.col("kind").isin(*CLUSTERED)).select("id", F.col("id").alias("label")), "labels")
    still = 0
    for turn in range(max_rounds):
        votes = links.join(label.withColumnRenamed("id", "b"), "b").groupBy("a", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy(F.col("a").alias("id")).agg(F.min(F.struct(-F.col("n"), "label"))["label"].alias("wanted"))
        moves = F.pmod(F.xxhash64("id"), F.lit(2)) == turn % 2
        moved = written(label.join(best, "id", "left").select("id", F.when(moves, F.coalesce("wanted", "label")).otherwise(F.col("label")).alias("label"), (moves & (F.col("wanted") != F.col("label"))).alias("changed")), "labels")
        label, quiet = moved.select("id", "label"), moved.where("changed").isEmpty()
        still = still + 1 if quiet else 0
        if still == 2:
            break
    return label


#: Links that the labelling takes at a time; what it makes of one is up to some 60 bytes.
LINKS = 1 << 19
#: Edges in a block: a few KB, as blocks are sent to Python by thousands.
BLOCK_EDGES = 2048


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(project, edges, block): the edges (project, source, target) in compressed blocks, some 4 bytes
    an edge where sources come in order."""
    codec = pa.Codec("zstd", compression_level=1)
    for batch in batches:
        ends = np.stack([batch.column(i).to_numpy() for i in (1, 2)])
        names = batch.column(0).dictionary_encode()
        codes = names.indices.fill_null(len(names.dictionary)).to_numpy()
        rows = []
        for code, name in enumerate([*names.dictionary.to_pylist(), None]):
            mine = ends[:, codes == code]
            for i in range(0, mine.shape[1], BLOCK_EDGES):
                cut = mine[:, i : i + BLOCK_EDGES].copy()
                cut[0, 1:] -= cut[0, :-1].copy()
                split = np.ascontiguousarray(cut.view(np.uint8).reshape(2, -1, 8).transpose(0, 2, 1))  # bytes of one place together
                rows.append((name, cut.shape[1], codec.compress(split, asbytes=True)))
        kinds = zip(("project", "edges", "block"), zip(*rows), (pa.string(), pa.int32(), pa.binary()))
        if rows:
            yield pa.RecordBatch.from_pydict({name: pa.array(values, kind) for name, values, kind in kinds})


def _unpacked(blocks: list[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sources and targets of the blocks, about half of LINKS at a time."""
    codec, step = pa.Codec("zstd"), max(1, LINKS // 2 // BLOCK_EDGES)
    for i in range(0, len(blocks), step):
        ends = []
        for k, block in blocks[i : i + step]:
            split = np.frombuffer(codec.decompress(block, decompressed_size=16 * k), np.uint8).reshape(2, 8, k)
            cut = np.ascontiguousarray(split.transpose(0, 2, 1)).view(np.int64)[..., 0]
            ends.append(np.stack((np.cumsum(cut[0]), cut[1])))
        yield tuple(np.concatenate(ends, axis=1))


def _begins(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate((np.ones(min(len(x), 1), bool), x[1:] != x[:-1])))


def _distinct(chunks: list[np.ndarray]) -> np.ndarray:
    """The values of the chunks, which are taken out of the list, in order."""
    every = np.concatenate(chunks)
    chunks.clear()
    every.sort()
    new = np.ones(len(every), bool)
    np.not_equal(every[1:], every[:-1], out=new[1:])
    return every[new]


def _ids(blocks: list[tuple[int, bytes]]) -> np.ndarray:
    ids, fresh, waiting = np.zeros(0, np.int64), [], 0
    for ends in _unpacked(blocks):
        fresh.append(_distinct(list(ends)))
        waiting += len(fresh[-1])
        if waiting > max(LINKS, len(ids) // 2):
            fresh.append(ids)
            del ids
            ids, waiting = _distinct(fresh), 0
    return _distinct([*fresh, ids])


def _places(ids: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The places of the values in ids; looked up in their order, near ones after each other."""
    order = np.argsort(values)
    found = np.empty(len(values), np.int64)
    found[order] = np.searchsorted(ids, values[order])
    return found


def _links(blocks: list[tuple[int, bytes]], ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The links by places in ids, from both sides and in order: (first, own, count, near), where the
    k-th node own[k] has count[k] links from first[k] on."""
    for ends in _unpacked(blocks):
        a, b = (_places(ids, x) for x in ends)
        keys = np.concatenate((a << 32 | b, b << 32 | a))
        keys.sort()
        own = keys >> 32
        first = _begins(own)
        yield first, own[first], np.diff(np.append(first, len(own))), (keys & 0xFFFFFFFF).astype(np.int32)


def _kept(size: int) -> np.ndarray:
    """int32 numbers, many of them in a file without a name, mapped into memory: its pages are the
    system's cache, which it may drop; the file ends with the array."""
    if size <= LINKS:
        return np.empty(size, np.int32)
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    with tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None) as file:
        os.posix_fallocate(file.fileno(), 0, 4 * size)  # a full disk is an error here, not a fault later
        return np.frombuffer(mmap.mmap(file.fileno(), 4 * size), np.int32)


def _graph(blocks: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, cut, near): near[cut[i] : cut[i + 1]] are the places of the neighbours of ids[i], each link
    from both sides. In memory are the nodes and the blocks, which are taken out of the list."""
    ids = _ids(blocks)
    cut = np.zeros(len(ids) + 1, np.int64)
    for _, own, count, _ in _links(blocks, ids):
        cut[own + 1] += count
    np.cumsum(cut, out=cut)
    near = _kept(int(cut[-1]))
    for first, own, count, found in _links(blocks, ids):
        near[np.arange(len(found)) + np.repeat(cut[own] - first, count)] = found
        cut[own] += count  # where the node's next links go, at last where they end
    blocks.clear()
    cut[1:] = cut[:-1]
    cut[:1] = 0
    return ids, cut, near


def _spans(cut: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all links of the nodes `at`, one node after the other, and their numbers."""
    n = cut[at + 1] - cut[at]
    return np.arange(n.sum()) + np.repeat(cut[at] - (np.cumsum(n) - n), n), n


def _parts(cut: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The nodes `at` in parts of about LINKS links, or of one node."""
    n = np.cumsum(cut[at + 1] - cut[at])
    return np.split(at, np.unique(np.searchsorted(n, np.arange(LINKS, n[-1], LINKS), "right"))) if len(at) and n[-1] > LINKS else [at]


def _ranges(cut: np.ndarray) -> Iterator[tuple[int, int]]:
    """All nodes in ranges of at most 100,000 with about LINKS links, or of one node."""
    i, n = 0, len(cut) - 1
    while i < n:
        j = int(np.searchsorted(cut, cut[i] + LINKS, "right")) - 1
        yield i, (j := min(max(j, i + 1), i + 100_000, n))
        i = j


def _settled(ids: np.ndarray, cut: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The label of each node of a `_graph`, a place in ids, after label propagation in place, in a
    hashed order. A node waits for its neighbours that come before it in the order only, so nodes
    that wait for none of each other are moved at once, with the same labels as one by one; nodes
    whose neighbours stayed as they were stay too."""
    n = len(ids)
    x = ids.astype(np.uint32)
    for _ in range(2):
        x = (x ^ (x >> np.uint32(16))) * np.uint32(0x45D9F3B)  # a public mixing constant, fixed: it decides the order
    x ^= x >> np.uint32(16)
    order = np.argsort(x, kind="stable")
    del x
    rank = np.empty(n, np.int32)
    rank[order] = np.arange(n, dtype=np.int32)
    del order

    waiting = np.empty(n, np.int32)
    for i, j in _ranges(cut):
        own = np.repeat(np.arange(j - i), np.diff(cut[i : j + 1]))
        earlier = rank[near[cut[i] : cut[j]]] < rank[i:j][own]
        waiting[i:j] = np.bincount(own[earlier], minlength=j - i)
    ready, levels = np.flatnonzero(waiting == 0).astype(np.int32), []
    while len(ready):
        levels.append(ready)
        freed = []
        for at in _parts(cut, ready):
            places, k = _spans(cut, at)
            to = near[places]
            later = to[rank[to] > np.repeat(rank[at], k)]
            later.sort()
            first = _begins(later)
            waiting[later[first]] -= np.diff(np.append(first, len(later))).astype(np.int32)
            freed.append(later[first][waiting[later[first]] == 0])
        ready = np.concatenate(freed)
    del rank, waiting

    label, stale = np.arange(n, dtype=np.int32), np.ones(n, bool)
    for _ in range(30):
        changed = False
        for level in levels:
            for at in _parts(cut, level[stale[level]]):
                if not len(at):
                    continue
                stale[at] = False
                places, k = _spans(cut, at)
                votes = np.repeat(np.arange(len(at)) * n, k)
                votes += label[near[places]]
                votes.sort()
                first = _begins(votes)
                counts, (own, name) = np.diff(np.append(first, len(votes))), np.divmod(votes[first], n)
                begin = _begins(own)
                top = np.flatnonzero(counts == np.repeat(np.maximum.reduceat(counts, begin), np.diff(np.append(begin, len(own)))))
                best = name[top[_begins(own[top])]]  # names ascend: of equal counts the least
                moved = best != label[at]
                if moved.any():
                    changed = True
                    label[at[moved]] = best[moved]
                    stale[near[_spans(cut, at[moved])[0]]] = True
        if not changed:
            break
    return label


def _results(name: str | None, blocks: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """(project, id, label, inside, outside) of the nodes of one project's blocks."""
    ids, cut, near = _graph(blocks)
    label = _settled(ids, cut, near)
    for i, j in _ranges(cut):
        k = np.diff(cut[i : j + 1])
        own = np.repeat(np.arange(j - i), k)
        inside = np.bincount(own[label[near[cut[i] : cut[j]]] == label[i:j][own]], minlength=j - i)
        columns = [pa.array(x, pa.int64()) for x in (ids[i:j], ids[label[i:j]], inside, k - inside)]
        yield pa.RecordBatch.from_arrays([pa.array([name] * (j - i), pa.string()), *columns], names=["project", "id", "label", "inside", "outside"])


def _sequential(rows: pd.DataFrame) -> pd.DataFrame:
    """Label propagation in place over the links (project, a, b) of one project, once from each side."""
    once = rows[rows["a"] < rows["b"]]
    edges = pa.RecordBatch.from_pandas(once[["project", "a", "b"]], preserve_index=False)
    return pa.Table.from_batches(_labelled(_packed(iter([edges])))).to_pandas()


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`_results` of each project of a partition of `_packed` edges."""
    held: dict[str | None, list[tuple[int, bytes]]] = {}
    for batch in batches:
        for name, edges, block in zip(*(batch.column(i).to_pylist() for i in range(3))):
            held.setdefault(name, []).append((edges, block))
    while held:
        yield from _results(*held.popitem())


def sequential_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, id, label, inside, outside): the exact sequential variant, with each node's links
    within and out of its community. One project is one task: it holds the project's nodes and its
    edges as compressed blocks in memory, the links in a file of the executor's local folder;
    `label_propagation` has no such limit."""
    rows = _inside(nodes, edges).mapInArrow(_packed, "project string, edges int, block binary").repartition("project")
    return rows.mapInArrow(_labelled, "project string, id long, label long, inside long, outside long")


def communities(labels: DataFrame, nodes: DataFrame, edges: DataFrame, min_members: int = 3, limit: int = 12) -> DataFrame:
    """(label, members, cohesion): the largest communities; cohesion is the share of the edges at
    their nodes that stay inside, to four places. Labels with their numbers of links (`inside`,
    `outside`) are taken at that; else the links are counted."""
    cohesion = F.coalesce(F.round(F.try_divide(F.col("i"), F.col("i") + F.col("o")), 4), F.lit(0.0)).alias("cohesion")
    order = (F.col("members").desc(), "label")
    if "inside" in labels.columns:
        counted = labels.groupBy("label").agg(F.count("*").alias("members"), (F.sum("inside") / 2).alias("i"), F.sum("outside").alias("o"))
        return counted.where(F.col("members") >= min_members).select("label", "members", cohesion).orderBy(*order).limit(limit)
    links = cluster_links(nodes, edges)
    at = labels.select(F.col("id").alias("a"), F.col("label").alias("label"))
    to = labels.select(F.col("id").alias("b"), F.col("label").alias("other"))
    inside = links.join(at, "a").join(to, "b").groupBy("label").agg((F.count_if(F.col("label") == F.col("other")) / 2).alias("i"), F.count_if(F.col("label") != F.col("other")).alias("o"))
    sizes = labels.groupBy("label").agg(F.count("*").alias("members")).where(F.col("members") >= min_members)
    return sizes.join(inside, "label", "left").select("label", "members", cohesion).orderBy(*order).limit(limit)


def deepest_chain(edges: DataFrame, root: int, max_depth: int = 10, types: tuple[str, ...] = ("CALLS",)) -> DataFrame:
    """(chain): the longest simple path from `root`, of several the least by ids. Partial paths
    are kept per end node and set of nodes only, and paths end at `max_depth` edges."""
    spark = edges.sparkSession
    rows = written(edges.where(F.col("type").isin(*types)).select("source_id", "target_id").distinct(), "chain")
    level = spark.range(1).select(F.array(F.lit(root).cast("long")).alias("chain"))
    longest = level
    for _ in range(max_depth):
        grown = level.withColumn("end", F.element_at("chain", -1)).join(rows, F.col("end") == F.col("source_id")).where(~F.array_contains("chain", F.col("target_id")))
        longer = grown.select(F.concat("chain", F.array("target_id")).alias("chain"))
        once = longer.groupBy(F.element_at("chain", -1).alias("end"), F.array_sort("chain").alias("members")).agg(F.min("chain").alias("chain"))
        level = written(once.select("chain"), "chain")
        if level.isEmpty():
            break
        longest = level
    return longest.agg(F.min("chain").alias("chain"))
