"""Pair head over frozen embeddings: a logistic score of |a - b| and a * b, fitted by full-batch gradient descent.

Features are joined and written once. Each epoch is one pass over them: a task folds its Arrow batches into
one sum for each feature, and these are shuffled by feature and added, so no task and no driver holds more than a number
for each feature and task; the driver gets 2 * width + 2 numbers an epoch and no row of data, and a lost executor costs
part of one epoch. The embeddings stay as they are.

Defined results: pairs without a label of 0 or 1, of a node with itself, or with a node that has no whole vector of the
given width are not learned from; refused() names them with the reason. score() keeps every row and every column of
pairs, repeated rows too, and gives null where there is no whole vector. Labels that are all alike, or fewer than two
usable pairs (an empty table), raise ValueError. A node with several embeddings raises as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.scores import sigmoid
from evidentia.operators.dedup import checkpointed

def whole(v: Column, width: int) -> Column:
    return (F.size(v) == width) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))


def with_features(pairs: DataFrame, embeddings: DataFrame, width: int) -> DataFrame:
    """pairs (source, target, ...) with _x, the 2 * width features, or null."""
    e = embeddings.select("node_id", F.col("h").cast("array<double>").alias("h")).filter(whole(F.col("h"), width))
    a, b = e.toDF("_a", "_u"), e.toDF("_b", "_v")
    joined = pairs.join(a, F.col("source") == F.col("_a"), "left").join(b, F.col("target") == F.col("_b"), "left")
    x = F.concat(F.zip_with("_u", "_v", lambda p, q: F.abs(p - q)), F.zip_with("_u", "_v", lambda p, q: p * q))
    return joined.withColumn("_x", F.when(F.col("_u").isNotNull() & F.col("_v").isNotNull(), x)).drop("_a", "_b", "_u", "_v")


def reason() -> Column:
    """Why a row of with_features can't be learned from; null if it can."""
    usable = F.coalesce(F.col("label").isin(0, 1), F.lit(False))
    return F.when(F.col("source") == F.col("target"), "same node").when(F.col("_x").isNull(), "no vector").when(~usable, "no label")


def refused(pairs: DataFrame, embeddings: DataFrame, width: int) -> DataFrame:
    """(source, target, reason) of the pairs that fit leaves out."""
    return with_features(pairs.select("source", "target", "label"), embeddings, width).select("source", "target", reason().alias("reason")).filter("reason is not null")


def totals(data: DataFrame, size: int, fold) -> np.ndarray:
    """The sum over all rows (x, y) of what fold(x matrix, y vector) gives for a batch: size numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(size), False
        for b in batches:
            if b.num_rows:
                seen = True
                total += fold(b.column(0).flatten().to_numpy().reshape(b.num_rows, -1), b.column(1).to_numpy())
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["i", "s"])

    out = np.zeros(size)
    for r in data.select("x", "y").mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        out[r["i"]] = r["s"]
    return out


@dataclass(frozen=True)
class PairHead:
    """A fitted head: weights of standardised features; loss has the mean log loss before each epoch."""

    width: int
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    loss: tuple[float, ...]

    def score(self, pairs: DataFrame, embeddings: DataFrame, name: str = "score") -> DataFrame:
        """pairs with the score, rounded to 6 places, in built-in expressions."""
        w = self.weights / self.scale
        at = F.array(*[F.lit(float(v)) for v in w])
        z = F.aggregate(F.zip_with("_x", at, lambda x, v: x * v), F.lit(float(self.bias - self.mean @ w)), lambda s, t: s + t)
        return with_features(pairs, embeddings, self.width).withColumn(name, F.round(sigmoid(z), 6)).drop("_x")


def fit(pairs: DataFrame, embeddings: DataFrame, width: int, learning_rate: float = 0.2, epochs: int = 400) -> PairHead:
    """The head of (source, target, label) pairs over embeddings (node_id, h)."""
    if learning_rate <= 0 or epochs < 1:
        raise ValueError("learning_rate must be positive and epochs at least one")
    if embeddings.groupBy("node_id").count().filter("count > 1").limit(1).count():
        raise ValueError("a node has several embeddings")
    data = with_features(pairs.select("source", "target", "label"), embeddings, width).filter(reason().isNull())
    data = checkpointed(data.select(F.col("_x").alias("x"), F.col("label").cast("double").alias("y")), "pairs")
    k = 2 * width
    first = totals(data, k + 2, lambda x, y: np.concatenate((x.sum(axis=0), [y.sum(), len(y)])))
    n, positive = first[k + 1], first[k]
    if n < 2 or positive in (0, n):
        raise ValueError("training needs pairs of both labels")
    mean = first[:k] / n
    scale = np.sqrt(totals(data, k, lambda x, y: ((x - mean) ** 2).sum(axis=0)) / n)
    scale[scale <= 1e-12 * np.maximum(1, np.abs(mean))] = 1.0
    weights, bias, loss = np.zeros(k), 0.0, []
    for _ in range(epochs):

        def fold(x: np.ndarray, y: np.ndarray, w: np.ndarray = weights, b: float = bias) -> np.ndarray:
            x = (x - mean) / scale
            z = x @ w + b
            error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
            return np.concatenate((error @ x, [error.sum(), (np.logaddexp(0, z) - y * z).sum()]))

        g = totals(data, k + 2, fold) / n
        weights, bias = weights - learning_rate * g[:k], bias - learning_rate * g[k]
        loss.append(float(g[k + 1]))
    return PairHead(width, mean, scale, weights, float(bias), tuple(loss))
