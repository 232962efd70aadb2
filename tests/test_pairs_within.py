"""Features of all pairs of a group: worked out in cells, never joined."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evidentia.operators import blocks, evaluation
from evidentia.plans import catalog


@pytest.mark.parametrize("small", [False, True])
def test_all_pairs_of_groups(spark, monkeypatch, small):
    """Against the features of listed pairs, in one cell a group and in many; nulls, sets that are empty or absent."""
    if small:
        for m, name, n in ((blocks, "PAIRS_A_CELL", 12), (blocks, "ITEMS_HELD", 300), (evaluation, "PAIRS_A_BATCH", 10)):
            monkeypatch.setattr(m, name, n)
    rng = random.Random(8)
    day = lambda: datetime(2024, 1, 1) + timedelta(hours=rng.randint(0, 9))
    rows = [(i, None if i == 5 else i % 3, rng.choice([None, "", "ann_01", "Ann.02", "annie", "bob99", "b"]), day(), None if i % 9 == 0 else day(), [float(rng.randint(0, 3) if i != 7 else 0) for _ in range(24)], rng.choice([None, 0.2, 0.9])) for i in range(24)]
    aliases = spark.createDataFrame(rows, "id bigint, g int, handle string, first_seen timestamp_ntz, last_seen timestamp_ntz, hours array<double>, reliability double")
    texts = spark.createDataFrame([(i, " ".join(rng.choice(["red", "fox", "sea", "oak", "elm"]) for _ in range(4))) for i in range(20)], "id bigint, text string")
    items = lambda n: spark.createDataFrame([(rng.randint(0, 23), rng.choice([None, *range(n)])) for _ in range(60)], "id bigint, item int")
    sets = [items(12).cache(), items(2).cache(), items(30).cache()]
    a, b = aliases.alias("a"), aliases.alias("b")
    pairs = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("l"), F.col("b.id").alias("r"))
    want = {(r.l, r.r): r for r in evaluation.pair_features(pairs, aliases, texts, *sets).collect()}
    got = evaluation.pairs_within(aliases, "g", texts, *sets).collect()
    assert len(got) == len(want) > 60 and {(r.l, r.r) for r in got} == set(want)
    for r in got:
        for c in evaluation.PAIR_FEATURES:
            assert r[c] == pytest.approx(want[r.l, r.r][c], abs=1e-12), c
    assert all(sum((r[c] or 0) > 0 for r in got) > 10 for c in ("handle_edit", "handle_grams", "text_cosine", "window", "identifiers", "platforms", "hours", "graph"))


def test_pairs_are_not_joined(spark):
    """No pair goes through a join: all pairs that share an item were joined to the asked ones."""
    plan = catalog.queries()["resolution_pair_features"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("Union")]
