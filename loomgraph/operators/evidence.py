"""Confidence of relations from many pieces of evidence, and content-addressed ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import BROADCAST_BYTES, bounded_join, row_bytes, written

PLACES = 12


def _by_type(kind: str, values: dict[str, float]) -> Column:
    return F.coalesce(*(F.when(F.col(kind) == k, F.lit(float(v))) for k, v in values.items()), F.lit(None).cast("double"))


def reconcile(evidence: DataFrame, now: str, ceilings: dict[str, float] | None = None, half_lives: dict[str, float] | None = None, deterministic: tuple[str, ...] = ()) -> DataFrame:
    """(relation, support, contradiction, confidence, level, groups) from (relation, evidence_id,
    kind, polarity, strength, source, observed_at).

    A strength is cut to its kind's ceiling and halved every half-life; of one independence
    source and polarity the strongest counts; sources combine as 1 - prod(1 - s); confidence is
    support * (1 - contradiction). Copies of an evidence_id count once and must be equal: the
    query fails where they differ. Null strengths are 0."""
    said = F.struct("kind", "polarity", "strength", "source", "observed_at")
    once = evidence.groupBy("relation", "evidence_id").agg(F.min(said).alias("e"), F.max(said).alias("f"))
    conflict = F.raise_error(F.concat(F.lit("conflicting copies of evidence "), F.col("evidence_id").cast("string")))
    agreed = once.select("relation", "evidence_id", F.when(F.col("e").eqNullSafe(F.col("f")), F.col("e")).otherwise(conflict).alias("e"))
    rows = agreed.select("relation", "evidence_id", "e.*").where("polarity in ('supports', 'contradicts')")
    strength = F.coalesce("strength", F.lit(0.0))
    if ceilings:
        strength = F.least(strength, F.coalesce(_by_type("kind", ceilings), F.lit(1.0)))
    if half_lives:
        days = F.greatest(F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("observed_at").cast("timestamp")), F.lit(0)) / 86_400_000_000
        life = _by_type("kind", half_lives)
        strength = strength * F.coalesce(F.pow(F.lit(0.5), days / life), F.lit(1.0))
    sure = F.col("kind").isin(*deterministic) if deterministic else F.lit(False)
    rows = rows.withColumn("s", F.round(strength, PLACES)).withColumn("d", F.when(sure, F.col("s")).otherwise(0.0))
    groups = rows.groupBy("relation", "polarity", "source").agg(F.max("s").alias("s"), F.max("d").alias("d"))
    combined = lambda c, p: F.round(1 - F.coalesce(F.product(F.when(F.col("polarity") == p, 1 - F.col(c))), F.lit(1.0)), PLACES)
    per = groups.groupBy("relation").agg(combined("s", "supports").alias("support"), combined("s", "contradicts").alias("contradiction"), combined("d", "supports").alias("certain"), F.count("*").alias("groups"))
    confidence = F.round(F.col("support") * (1 - F.col("contradiction")), PLACES)
    c = F.col("confidence")
    level = F.when((c >= 0.9) & (F.col("certain") >= 0.9), "verified").when(c >= 0.75, "high").when(c >= 0.5, "medium").when(c >= 0.25, "low").otherwise("speculative")
    return per.withColumn("confidence", confidence).withColumn("level", level).drop("certain")


def content_id(*columns: str) -> Column:
    """sha256 of the JSON array of the columns; null stays null in the array."""
    return F.sha2(F.to_json(F.array(*(F.col(c).cast("string") for c in columns))), 256)


#: Kinds of nodes and types of edges that become entities and relations.
ENTITY_KINDS = ("File", "Function", "Method", "Class")
RELATION_TYPES = ("CALLS", "IMPORTS", "TESTS", "CONFIGURES", "EMITS", "LISTENS_ON")


def semantic_entities(nodes: DataFrame) -> DataFrame:
    """(id, project, semantic_id, entity_class, signature, context) of the nodes that are entities:
    callables go by their signature, if they have one, all others by their qualified name; the
    context is where they are defined."""
    c = F.col
    said = lambda key: F.trim(F.coalesce(F.get_json_object("properties", f"$.{key}"), F.lit("")))
    callable_, parent = c("kind").isin("Function", "Method"), said("parentClass")
    signature = F.when(callable_ & (said("signature") != ""), said("signature")).otherwise(c("qualified_name"))
    context = F.when((c("kind") == "Method") & (parent != ""), F.concat_ws(":", "file_path", parent, "qualified_name")).when(c("kind").isin("Function", "Class"), F.concat_ws(":", "file_path", "qualified_name")).otherwise(c("file_path"))
    rows = nodes.where(c("kind").isin(*ENTITY_KINDS)).select("id", "project", c("kind").alias("entity_class"), signature.alias("signature"), context.alias("context"))
    return rows.select("id", "project", content_id("project", "entity_class", "signature", "context").alias("semantic_id"), "entity_class", "signature", "context")


def _twins(entities: DataFrame, content: tuple[str, ...]) -> DataFrame:
    """(id, least): entities that have the content of another with a lesser id."""
    rows = entities.withColumn("k", F.xxhash64(*content))
    shared = rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    least = F.min("id").over(Window.partitionBy("semantic_id"))
    return written(bounded_join(rows, shared, ["k"], "left_semi").select("id", least.alias("least")).where("id <> least").distinct(), "twins")


#: So many times BROADCAST_BYTES of entities that are targets are sent to every executor, in parts.
TARGET_PARTS = 4


def semantic_relations(nodes: DataFrame, edges: DataFrame, max_parts: int = TARGET_PARTS) -> DataFrame:
    """(relation_id, project, source, type, target, occurrences): the edges between entities by
    content, parallel ones as one relation.

    Edges are counted by node and shuffled once, by source, without texts; digests travel as 32
    bytes. The targets' are sent to every executor while they have at most `max_parts` times
    BROADCAST_BYTES, else joined by shuffle. Nodes of one content go by the least of their ids from
    the start. Only where nodes share an id are the counts added up again by content."""
    c = F.col
    entities = semantic_entities(nodes)
    content = ("project", "entity_class", "signature", "context")
    rows = edges.where(c("type").isin(*RELATION_TYPES)).select("project", "source_id", "target_id", "type")
    twins = _twins(entities, content)
    if not twins.isEmpty():
        for end in ("source_id", "target_id"):
            rows = bounded_join(rows, twins.select(c("id").alias(end), "least"), [end], "left").withColumn(end, F.coalesce("least", end)).drop("least")
    aimed = bounded_join(nodes.where(c("kind").isin(*ENTITY_KINDS)), rows.select(c("target_id").alias("id")).distinct(), ["id"], "left_semi")
    targets = written(semantic_entities(aimed).select(c("id").alias("target_id"), F.unhex("semantic_id").alias("target")), "targets")
    parts = -(-targets.agg(F.coalesce(F.sum(row_bytes(targets)), F.lit(0)).alias("n")).first()["n"] // BROADCAST_BYTES) or 1
    counted = rows.repartition("source_id").groupBy("project", "source_id", "target_id", "type").agg(F.count("*").alias("occurrences"))
    sources = entities.select("id", *content).repartition("id").select(c("id").alias("source_id"), F.unhex(content_id(*content)).alias("source"))  # texts pack better than digests
    if parts <= max_parts:
        met = counted.join(sources, "source_id")
        for i in range(parts):
            part = targets.where(F.pmod(F.xxhash64("target_id"), F.lit(parts)) == i).withColumnRenamed("target", f"target_{i}")
            met = met.join(F.broadcast(part), "target_id", "left")
        met = met.withColumn("target", F.coalesce(*(f"target_{i}" for i in range(parts)))).where("target is not null")
    else:
        met = rows.groupBy("project", "source_id", "target_id", "type").agg(F.count("*").alias("occurrences")).join(targets, "target_id").join(sources, "source_id")
    met = met.select("project", "source", "type", "target", "occurrences")
    if not entities.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        met = met.groupBy("project", "source", "type", "target").agg(F.sum("occurrences").alias("occurrences"))
    texts = met.withColumns({k: F.lower(F.hex(k)) for k in ("source", "target")})
    return texts.select(content_id("project", "source", "type", "target").alias("relation_id"), "project", "source", "type", "target", "occurrences")
