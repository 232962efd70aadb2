"""The pair head against a plain numpy descent, its refusals and its independence of the partitioning."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import pair_head

WIDTH = 3


def given(seed: int = 3):
    """Nodes of two kinds; pairs of one kind are alike. Some rows can't be learned from."""
    rng = np.random.default_rng(seed)
    nodes = [(f"n{i}", [float(x) for x in np.array([i % 2, 1 - i % 2, 0.5]) + rng.normal(0, 0.2, WIDTH)]) for i in range(40)]
    pairs = [(f"n{i}", f"n{j}", int(i % 2 == j % 2)) for i, j in rng.integers(0, 40, (300, 2)) if i != j]
    odd = [("n1", "n1", 1), ("n1", "lost", 0), (None, "n2", 1), ("n1", "n2", None), ("n1", "n2", 2), ("n1", "short", 1), ("hole", "n1", 1)]
    nodes += [("short", [1.0]), ("hole", [1.0, None, 2.0]), ("nan", [1.0, math.nan, 2.0])]
    return nodes, pairs, odd


def frames(spark, nodes, pairs):
    return spark.createDataFrame(pairs, "source string, target string, label int"), spark.createDataFrame(nodes, "node_id string, h array<double>")


def descent(nodes, pairs, rate, epochs):
    h = {k: np.array(v, float) for k, v in nodes if len(v) == WIDTH and None not in v}
    x = np.array([np.concatenate((abs(h[a] - h[b]), h[a] * h[b])) for a, b, _ in pairs])
    y = np.array([p[2] for p in pairs], float)
    mean, scale = x.mean(0), x.std(0)
    z, w, b = (x - mean) / scale, np.zeros(2 * WIDTH), 0.0
    for _ in range(epochs):
        e = 1 / (1 + np.exp(-(z @ w + b))) - y
        w, b = w - rate * z.T @ e / len(y), b - rate * e.mean()
    return 1 / (1 + np.exp(-(z @ w + b)))


def test_fit_equals_a_plain_descent(spark):
    nodes, pairs, odd = given()
    df, e = frames(spark, nodes, pairs + odd)
    head = pair_head.fit(df, e, WIDTH, 0.2, 12)
    again = pair_head.fit(df.repartition(7), e.repartition(3), WIDTH, 0.2, 12)
    assert np.allclose(head.weights, again.weights, atol=1e-10) and math.isclose(head.bias, again.bias, abs_tol=1e-10)
    assert len(head.loss) == 12 and all(a > b for a, b in zip(head.loss, head.loss[1:])) and math.isclose(head.loss[0], math.log(2))
    kept = spark.createDataFrame([(*p, k) for k, p in enumerate(pairs)], "source string, target string, label int, k int")
    got = {r.k: r.score for r in head.score(kept, e).collect()}
    want = descent(nodes, pairs, 0.2, 12)
    assert len(got) == len(pairs) and all(abs(got[k] - v) < 2e-6 for k, v in enumerate(want))
    assert np.mean([(got[k] >= 0.5) == bool(p[2]) for k, p in enumerate(pairs)]) > 0.95


def test_refusals_and_rows_without_a_vector(spark):
    nodes, pairs, odd = given()
    df, e = frames(spark, nodes, pairs + odd)
    why = {(r.source, r.target, r.reason) for r in pair_head.refused(df, e, WIDTH).collect()}
    assert why == {("n1", "n1", "same node"), ("n1", "lost", "no vector"), (None, "n2", "no vector"), ("n1", "n2", "no label"), ("n1", "short", "no vector"), ("hole", "n1", "no vector")}
    head = pair_head.fit(df, e, WIDTH, 0.2, 2)
    extra = frames(spark, nodes, odd + odd)[0].withColumn("h", F.lit("kept")).withColumn("node_id", F.lit(1))
    got = head.score(extra, e)
    assert got.columns == ["source", "target", "label", "h", "node_id", "score"] and got.count() == 2 * len(odd)
    assert {(r.source, r.target) for r in got.filter("score is null").collect()} == {("n1", "lost"), (None, "n2"), ("n1", "short"), ("hole", "n1")}
    assert head.score(extra.limit(0), e).collect() == []


def test_what_cannot_be_fitted_raises(spark):
    nodes, pairs, _ = given()
    df, e = frames(spark, nodes, pairs)
    for bad in (df.filter("label = 1"), df.limit(0), df.limit(1)):
        with pytest.raises(ValueError):
            pair_head.fit(bad, e, WIDTH, 0.2, 1)
    with pytest.raises(ValueError):
        pair_head.fit(df, e.union(e.limit(1)), WIDTH, 0.2, 1)
    with pytest.raises(ValueError):
        pair_head.fit(df, e, WIDTH, 0.0, 1)


def test_constant_features_and_long_vectors(spark):
    """A feature without spread counts nothing; a thousand dimensions are summed in one row."""
    rng = np.random.default_rng(1)
    nodes = [(str(i), [1.0] * 10 + [float(x) for x in rng.normal(i % 2, 0.1, 490)]) for i in range(12)]
    pairs = [(str(i), str(j), int(i % 2 == j % 2)) for i in range(12) for j in range(i)]
    df, e = frames(spark, nodes, pairs)
    head = pair_head.fit(df, e, 500, 0.01, 3)
    assert not head.weights[:10].any() and not head.weights[500:510].any() and np.isfinite(head.weights).all() and head.loss[-1] < head.loss[0]
