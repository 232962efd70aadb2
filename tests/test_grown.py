"""Work that must not grow with levels, or lie in one task."""

from pyspark.sql import functions as F

from evidentia.operators import graph, infrastructure
from evidentia.plans import catalog
from tests.compare import connect, difference


def test_edges_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def same(x):
        seen.add(1)
        return x

    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}", i) for i in range(8)], "source string, target string, evidence_id int")
    e = e.withColumn("source", F.udf(same, "string")("source"))
    assert [r["evidence_id"] for r in graph.evidence_path(e, "n1", "n5")] == [1, 2, 3, 4] and seen.value == 8
    assert {(r.node, r.hop) for r in graph.neighbourhood(e, "n4", 3).collect()} == {(f"n{i}", abs(i - 4)) for i in range(1, 8)} and seen.value == 16


def test_a_nations_pairs_in_cells(spark, monkeypatch):
    monkeypatch.setattr(infrastructure, "SUPPLIERS_A_BLOCK", 30)
    sf = "/root/testdata/sf0.01"
    assert difference(connect(sf), catalog.oracle_sql()["infra_candidates"], catalog.queries()["infra_candidates"](spark, sf)) == ""


def test_flows_need_no_window(spark):
    q = catalog.queries()["flow_edges"](spark, "/root/testdata/sf0.001")
    assert "Window" not in q._jdf.queryExecution().optimizedPlan().toString()
