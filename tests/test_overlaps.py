"""Windows that meet: every pair once, dealt over cells."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import relational
from evidentia.plans import catalog
from tests.compare import connect, difference


@pytest.mark.parametrize("cell", [10**6, 15])
def test_windows_meet(spark, monkeypatch, cell):
    """Against brute force: points, long windows, windows that end before they start, nulls, days before 1970."""
    monkeypatch.setattr(relational, "PAIRS_A_CELL", cell, raising=False)
    rng = random.Random(7)
    hour = lambda: rng.choice([None, *range(-900, 900)]) if rng.random() < 0.1 else rng.randint(-900, 900)
    side = lambda: [(i, s, s if s is None or rng.random() < 0.2 else s + rng.choice([-30, 5, 40, 168, 400])) for i, s in enumerate(hour() for _ in range(60))]
    a, b = [*side(), (60, 0, 168), (60, 0, 168), (61, 5, None)], [*side(), (60, 168, 200), (61, -5, 0), (62, 0, 168)]
    frame = lambda rows: spark.createDataFrame(rows, "id int, s long, e long").select("id", *[F.timestamp_seconds(F.col(c) * 3600).cast("timestamp_ntz").alias(n) for c, n in (("s", "start"), ("e", "end"))])
    want = sorted((i, j) for i, s, e in a for j, t, f in b if None not in (s, e, t, f) and s <= e and t <= f and max(s, t) <= min(e, f))
    assert sorted((r.l_id, r.r_id) for r in relational.overlap_join(frame(a), frame(b)).collect()) == want and len(want) > 300


def test_pairs_are_dealt_over_cells(spark, monkeypatch):
    """The query in many cells equals its SQL, and no task has a great part of the pairs, though they meet in few buckets."""
    monkeypatch.setattr(relational, "PAIRS_A_CELL", 50, raising=False)
    q, sf = catalog.queries()["interval_overlap_join"], "/root/testdata/sf0.01"
    assert difference(connect(sf), catalog.oracle_sql()["interval_overlap_join"], q(spark, sf)) == ""
    tasks = [r["count"] for r in q(spark, sf).groupBy(F.spark_partition_id()).count().collect()]
    assert max(tasks) < sum(tasks) / 10


def test_few_cells_whatever_the_pairs(spark, monkeypatch):
    """A bucket's cells were as many as pairs asked for, each with a copy of its rows."""
    monkeypatch.setattr(relational, "PAIRS_A_CELL", 1)
    d = spark.range(300).selectExpr("id", "timestamp_ntz'2024-01-02' as start", "timestamp_ntz'2024-01-02' + make_dt_interval(0, cast(id % 5 as int)) as end")
    got = relational.overlap_join(d, d)
    assert got.count() == 300 * 300 and got.rdd.getNumPartitions() <= 2 * 2 * 2 * relational.CELLS_A_CORE * spark.sparkContext.defaultParallelism
