from datetime import datetime

from evidentia.operators import graph_build as G

ONTOLOGY = G.Ontology({"person": "ACTOR", "coin": "WALLET"}, (("owns", "ACTOR", "WALLET", False), ("near", "*", "*", True)))
E = "entity_id string, entity_type string, surface_form string, normalized_form string, confidence double"
R = "relationship_id string, rel_type string, source string, target string, first_seen timestamp_ntz, last_seen timestamp_ntz, confidence double, evidence_id string"


def day(n):
    return datetime(2024, 1, n)


def test_import_checks_every_row(spark):
    entities = [("a", "person", "A", "a", 0.5), ("a", "person", "A", "a", 0.9), ("b", "person", "B", "b", 1.0), ("w", "coin", "W", "w", 1.0), ("x", "report", "X", "x", 1.0), ("c", "person", "C", "c", 1.0), ("c", "coin", "C", "c", 1.0), (None, "person", "N", "n", 1.0)]
    relations = [
        ("1", "owns", "a", "w", day(2), day(3), 0.4, "e1"), ("2", "owns", "a", "w", day(1), day(2), 0.6, "e1"), ("3", "owns", "a", "w", day(1), day(2), 0.5, "e0"), ("4", "near", "b", "a", day(1), day(5), 1.0, None), ("5", "near", "a", "b", day(2), day(9), 0.2, "e9"),
        ("6", "owns", "w", "a", day(1), day(2), 0.5, "e"), ("7", "likes", "a", "b", day(1), day(2), 0.5, "e"), ("8", "near", "a", "a", day(1), day(2), 0.5, "e"), ("9", "near", "a", "x", day(1), day(2), 0.5, "e"), ("10", "near", "zz", "a", day(1), day(2), 0.5, "e"),
        ("11", "near", "a", "b", day(3), day(2), 0.5, "e"), ("12", "near", "a", "b", day(1), day(2), 1.5, "e"), ("13", "near", "a", "b", day(1), None, 0.5, "e"), ("14", None, "a", "b", day(1), day(2), 0.5, "e"), ("15", "near", "c", "a", day(1), day(2), 0.5, "e"),
    ]
    g = G.bulk_import(spark.createDataFrame(entities, E), spark.createDataFrame(relations, R), ONTOLOGY)
    assert {(r.node_id, r.label, r.confidence) for r in g.nodes.collect()} == {("a", "ACTOR", 0.9), ("b", "ACTOR", 1.0), ("w", "WALLET", 1.0)}
    got = {(r.rel_type, r.source, r.target): (r.first_seen, r.last_seen, r.confidence, r.rows, r.citations) for r in g.edges.collect()}
    assert got == {("owns", "a", "w"): (day(1), day(3), 0.6, 3, 2), ("near", "a", "b"): (day(1), day(9), 1.0, 2, 1)}
    assert {(r.kind, r.id, r.reason) for r in g.quarantine.collect()} == {
        ("entity", "x", "no_label"), ("entity", None, "no_id"), ("entity", "c", "conflicting_labels"), ("relationship", "6", "labels_not_allowed"), ("relationship", "7", "unknown_type"), ("relationship", "8", "self_loop"), ("relationship", "9", "no_target"),
        ("relationship", "10", "no_source"), ("relationship", "11", "reversed_window"), ("relationship", "12", "confidence"), ("relationship", "13", "reversed_window"), ("relationship", "14", "unknown_type"), ("relationship", "15", "no_source"),
    }
    assert g.citations.count() == 3


def test_case_graph(spark):
    e = spark.createDataFrame([(1, "a", "p"), (1, "b", "p"), (1, "c", "q"), (2, "a", "p")], "case_id int, entity_id string, type string")
    r = spark.createDataFrame([(1, "x", "a", "b", 3), (1, "y", "a", "c", 1), (1, "x", "a", "zz", 9), (2, "x", "a", "b", 9), (1, "y", "b", "b", 2)], "case_id int, type string, source string, target string, evidence int")
    nodes, edges = G.case_graph(e, r)
    assert {(n.case_id, n.entity_id): (n.degree, n.evidence) for n in nodes.collect()} == {(1, "a"): (2, 4), (1, "b"): (3, 7), (1, "c"): (1, 1), (2, "a"): (0, 0)} and edges.count() == 3
    assert {(t.kind, t.type): t.n for t in G.type_counts(G.case_graph(e, r, ["y"], ["p"])).filter("case_id = 1").collect()} == {("node", "p"): 2, ("edge", "y"): 1}
    lines = G.serialized(nodes, "entity_id").collect()
    assert all(x.line.startswith('{"case_id":') for x in lines) and len({x.sha256 for x in lines}) == 4


def test_empty(spark):
    g = G.bulk_import(spark.createDataFrame([], E), spark.createDataFrame([], R), ONTOLOGY)
    assert g.edges.collect() == [] and g.quarantine.collect() == []
