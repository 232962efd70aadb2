"""Graph assembly: bulk import under an ontology that is data, with a quarantine for what it refuses, and case graphs.

Import goes in two passes. Entities become nodes by the ontology's labels; then relationships are checked one by one
against the nodes that exist. Every refused row goes to the quarantine with its reason, so rows in = nodes + edges'
rows + quarantine. Citations stay rows (an edge may have very many)."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.dedup import checkpointed


@dataclass(frozen=True)
class Ontology:
    """labels: an entity type's node label (other types are no nodes). relations: (type, source label, target label,
    symmetric); `*` stands for any label. Both are short declared lists."""

    labels: dict[str, str]
    relations: tuple[tuple[str, str, str, bool], ...]

    def label(self, entity_type: Column) -> Column:
        pairs = [F.lit(x) for kv in self.labels.items() for x in kv]
        return F.element_at(F.create_map(*pairs), entity_type) if pairs else F.lit(None).cast("string")

    def known(self, kind: Column) -> Column:
        return kind.isin(*{r[0] for r in self.relations})

    def symmetric(self, kind: Column) -> Column:
        return kind.isin(*{r[0] for r in self.relations if r[3]})

    def allowed(self, kind: Column, source: Column, target: Column) -> Column:
        """Whether a rule permits the type between the labels; a symmetric one either way round."""
        fits = lambda c, want: F.lit(True) if want == "*" else c == want
        out = F.lit(False)
        for name, a, b, both in self.relations:
            one = fits(source, a) & fits(target, b)
            out |= (kind == name) & ((one | (fits(source, b) & fits(target, a))) if both else one)
        return out


@dataclass
class Import:
    """nodes: (node_id, label, entity_type, surface_form, normalized_form, confidence); edges: (edge_key, rel_type, source,
    target, first_seen, last_seen, confidence, rows, citations); citations: (edge_key, evidence_id, first_seen);
    quarantine: (kind, id, reason)."""

    nodes: DataFrame
    edges: DataFrame
    citations: DataFrame
    quarantine: DataFrame


def _first_reason(reasons: Iterable[tuple[str, Column]]) -> Column:
    """The first reason that holds; a condition that is NULL holds (what can't be checked is refused)."""
    out = None
    for name, bad in reasons:
        bad = F.coalesce(bad, F.lit(True))
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return out


def bulk_import(entities: DataFrame, relationships: DataFrame, ontology: Ontology) -> Import:
    """entities: (entity_id, entity_type, surface_form, normalized_form, confidence), one row or equal rows an id;
    relationships: (relationship_id, rel_type, source, target, first_seen, last_seen, confidence, evidence_id), where
    rows of one type and pair become one edge: window union, greatest confidence."""
    e = entities.withColumn("label", ontology.label(F.col("entity_type")))
    reason = _first_reason([("no_id", F.col("entity_id").isNull()), ("no_label", F.col("label").isNull())])
    e = checkpointed(e.withColumn("_reason", reason), "entities")
    labels = e.filter("_reason is null").groupBy("entity_id").agg(F.count_distinct("label").alias("kinds"), F.max_by(F.struct("label", "entity_type", "surface_form", "normalized_form", "confidence"), F.struct("confidence", "entity_type", "surface_form", "normalized_form")).alias("n"))
    # An id with two labels is no node: which one it is can't be told.
    nodes = checkpointed(labels.filter("kinds = 1").select(F.col("entity_id").alias("node_id"), "n.*"), "nodes")
    unsure = labels.filter("kinds > 1").select("entity_id")
    refused = e.filter("_reason is not null").select(F.lit("entity").alias("kind"), F.col("entity_id").cast("string").alias("id"), F.col("_reason").alias("reason"))
    refused = refused.unionByName(e.filter("_reason is null").join(unsure, "entity_id", "left_semi").select(F.lit("entity").alias("kind"), F.col("entity_id").cast("string").alias("id"), F.lit("conflicting_labels").alias("reason")))
    # The nodes were written, so both sides of these joins are plain exchanges and a hub's edges can be split.
    side = lambda p: nodes.select(F.col("node_id").alias(f"_{p}"), F.col("label").alias(f"_{p}_label"))
    r = relationships.join(side("s"), F.col("source") == F.col("_s"), "left").join(side("t"), F.col("target") == F.col("_t"), "left")
    reason = _first_reason([
        ("unknown_type", ~ontology.known(F.col("rel_type"))), ("no_source", F.col("_s").isNull()), ("no_target", F.col("_t").isNull()), ("self_loop", F.col("source") == F.col("target")),
        ("labels_not_allowed", ~ontology.allowed(F.col("rel_type"), F.col("_s_label"), F.col("_t_label"))), ("reversed_window", F.col("first_seen") > F.col("last_seen")), ("confidence", ~F.col("confidence").between(0, 1)),
    ])
    r = checkpointed(r.withColumn("_reason", reason), "relationships")
    refused = refused.unionByName(r.filter("_reason is not null").select(F.lit("relationship").alias("kind"), F.col("relationship_id").cast("string").alias("id"), F.col("_reason").alias("reason")))
    both = ontology.symmetric(F.col("rel_type"))
    a, b = F.when(both, F.least("source", "target")).otherwise(F.col("source")), F.when(both, F.greatest("source", "target")).otherwise(F.col("target"))
    good = r.filter("_reason is null").select("rel_type", a.alias("source"), b.alias("target"), "first_seen", "last_seen", "confidence", "evidence_id")
    key = F.sha2(F.concat_ws("|", "rel_type", "source", "target").cast("binary"), 256)
    good = good.withColumn("edge_key", key)
    citations = good.filter("evidence_id is not null").groupBy("edge_key", "evidence_id").agg(F.min("first_seen").alias("first_seen"))
    cited = citations.groupBy("edge_key").agg(F.count(F.lit(1)).alias("citations"))
    edges = good.groupBy("edge_key", "rel_type", "source", "target").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("rows"))
    edges = edges.join(cited, "edge_key", "left").withColumn("citations", F.coalesce("citations", F.lit(0)).cast("bigint"))
    return Import(nodes, edges, citations, refused)


def case_graph(entities: DataFrame, relationships: DataFrame, edge_types: Iterable[str] | None = None, node_types: Iterable[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of every case. entities: (case_id, entity_id, type, label, ...); relationships: (case_id, type,
    source, target, evidence, ...), evidence a number of cited items. An edge with an end outside the case's entities is
    left out; node_types keeps entities of these types, and so removes edges too. nodes get degree and evidence (that
    of their edges); an edge of a node with itself counts twice, as it has two ends."""
    e = entities.filter(F.col("type").isin(*node_types)) if node_types is not None else entities
    e = checkpointed(e, "entities")
    r = relationships.filter(F.col("type").isin(*edge_types)) if edge_types is not None else relationships
    end = lambda p: e.select(F.col("case_id").alias(f"_{p}_case"), F.col("entity_id").alias(f"_{p}")).distinct()
    on = lambda p, c: (F.col("case_id") == F.col(f"_{p}_case")) & (F.col(c) == F.col(f"_{p}"))
    edges = checkpointed(r.join(end("s"), on("s", "source"), "left_semi").join(end("t"), on("t", "target"), "left_semi"), "edges")
    ends = edges.select("case_id", F.explode(F.array("source", "target")).alias("entity_id"), "evidence").groupBy("case_id", "entity_id").agg(F.count(F.lit(1)).alias("degree"), F.sum("evidence").alias("evidence"))
    nodes = e.join(ends, ["case_id", "entity_id"], "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("degree", "evidence")})
    return nodes, edges


def type_counts(graph: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(case_id, kind, type, n): how many nodes and edges of each type a case's graph has."""
    nodes, edges = graph
    count = lambda d, kind: d.groupBy("case_id", "type").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
    return count(nodes, "node").unionByName(count(edges, "edge")).select("case_id", "kind", "type", "n")


def serialized(rows: DataFrame, key: str) -> DataFrame:
    """(key, line, sha256): each row as JSON with its columns in the order of their names, NULLs kept."""
    line = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    return rows.select(F.col(key), line.alias("line")).withColumn("sha256", F.sha2(F.col("line").cast("binary"), 256))
