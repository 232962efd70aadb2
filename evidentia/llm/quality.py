"""Quality classifier: a second-order factorisation machine over hashed words, structure statistics and metadata.

The pairwise part uses the sum-of-squares identity, so scoring a text is linear in its features:
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ].

The model is fitted on the driver from a bounded labelled sample (MAX_PER_CLASS rows a class) and has a fixed size.
Defined results: a null text scores like an empty one; a missing n_chars is a bucket of its own; repeated rows get
equal scores, equal texts of one length too (ties); without labels of both classes the score is the class share, or
0.5 without any label; texts of any length are scored whole, in linear time; an empty table gives an empty result; other
columns don't matter, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import held_out, labelled_sample, map_text

#: Labelled documents of each class that the model is fitted on, at most.
MAX_PER_CLASS = 1500
WORD_BUCKETS, LENGTH_BUCKETS, RANK, SEED = 1 << 13, 26, 8, 42
UPPER = bytes(range(65, 91))
SYMBOLS = b"#*$%&|<>"
POINTS = b".,;:?-\"'()"
DIGITS = b"0123456789"
HIGH = bytes(range(128, 256))
STRUCTURE = 16


def structure(text: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """STRUCTURE statistics of a text's form, each of the order of one."""
    n, size = max(1, len(words)), max(1, len(text))
    without = lambda chars: (len(text) - len(text.translate(None, chars))) / size
    lines = text.split(b"\n")
    return [
        np.log1p(len(words)) / 8, sum(map(len, words)) / n / 10, without(UPPER), without(SYMBOLS), text.count(b"!") / n, text.count(b"|") / n,
        without(POINTS), without(DIGITS), without(HIGH), (len(lines) - len(set(lines))) / len(lines), len(lines) / n, len(counts) / n,
        sum(map(eq, words, words[1:])) / n, max(counts.values(), default=0) / n, sum(len(w) < 3 for w in counts) / max(1, len(counts)), text.count(b".") / n,
    ]


def features(texts: list[bytes | None], lengths: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: (where each row starts, feature places, values). Structure, then length bucket, then words."""
    place, value, size = [], [], []
    head = list(range(STRUCTURE))
    for text, length in zip(texts, lengths, strict=True):
        text = text or b""
        words = text.split()
        counts = Counter(words)
        bucket: dict[int, float] = {}
        for w, n in counts.items():
            h = zlib.crc32(w) % WORD_BUCKETS
            bucket[h] = bucket.get(h, 0) + n
        v = np.log1p(np.fromiter(bucket.values(), np.float32, len(bucket)))
        place.append(np.array([*head, STRUCTURE + (LENGTH_BUCKETS - 1 if length is None else min(LENGTH_BUCKETS - 2, max(0, int(length)).bit_length()))], np.int32))
        place.append(np.fromiter(bucket, np.int32, len(bucket)) + (STRUCTURE + LENGTH_BUCKETS))
        value.append(np.array([*structure(text, words, counts), 1.0], np.float32))
        value.append(v / max(1e-9, float(np.sqrt(v @ v))))
        size.append(STRUCTURE + 1 + len(bucket))
    return np.cumsum([0, *size])[:-1], np.concatenate(place), np.concatenate(value)


class FactorisationMachine:
    def __init__(self, width: int, rank: int = RANK):
        rng = np.random.default_rng(SEED)
        self.bias, self.w = 0.0, np.zeros(width, np.float32)
        self.v = rng.normal(0, 0.02, (width, rank)).astype(np.float32)

    def constant(self, classes: set) -> FactorisationMachine:
        """Scores everything as the only class there is, or 0.5."""
        self.bias = 30.0 * (1 in classes) - 30.0 * (0 in classes)
        self.v[:] = 0
        return self

    def raw(self, starts: np.ndarray, place: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The margin of each row and its factor sums."""
        vx = self.v[place] * value[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.w[place] * value, starts) + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def score(self, starts: np.ndarray, place: np.ndarray, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(starts, place, value)[0], -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, epochs: int = 12, rate: float = 0.08, l2: float = 1e-4, batch: int = 64) -> None:
        """Adagrad on the weighted logistic loss."""
        rng = np.random.default_rng(SEED)
        gw, gv, gb = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6
        self.bias = float(np.log((weight @ y + 1) / (weight @ (1 - y) + 1)))
        weight = weight / weight.mean()
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for lo in range(0, len(order), batch):
                own = order[lo : lo + batch]
                size = np.array([len(rows[i][0]) for i in own])
                starts = np.cumsum(size) - size
                place, value = (np.concatenate([rows[i][k] for i in own]) for k in (0, 1))
                raw, sums = self.raw(starts, place, value)
                g = (weight[own] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[own])).astype(np.float32)
                each = np.repeat(g, size) * value
                used, at = np.unique(place, return_inverse=True)
                dw = np.bincount(at, each, len(used)).astype(np.float32) + l2 * self.w[used]
                dv = each[:, None] * (np.repeat(sums, size, axis=0) - self.v[place] * value[:, None])
                dv = np.stack([np.bincount(at, dv[:, f], len(used)) for f in range(dv.shape[1])], axis=1).astype(np.float32) + l2 * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                gb += float(g.sum()) ** 2
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= rate * dv / np.sqrt(gv[used])
                self.bias -= rate * float(g.sum()) / gb**0.5


def with_length(documents: DataFrame) -> DataFrame:
    length = F.col("n_chars").cast("bigint") if "n_chars" in documents.columns else F.lit(None).cast("bigint")
    return documents.select("doc_id", F.col("text").cast("binary").alias("text"), length.alias("length"))


def fit(documents: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> FactorisationMachine:
    width = STRUCTURE + LENGTH_BUCKETS + WORD_BUCKETS
    fm = FactorisationMachine(width)
    sample, class_weight = labelled_sample(documents, labels, "quality", {0: max_per_class, 1: max_per_class})
    if len(class_weight) < 2:
        return fm.constant(set(class_weight))
    known = sample.select(F.col("doc_id").alias("known"), "y").dropDuplicates(["known"])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        starts, place, value = features(b.column(1).to_pylist(), b.column(2).to_pylist())
        at = pa.array(np.r_[starts, len(place)].astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(at, pa.array(place)), pa.ListArray.from_arrays(at, pa.array(value)), b.column(3), b.column(0)], names=["place", "value", "y", "doc_id"])

    wanted = with_length(documents).join(F.broadcast(known), F.col("doc_id") == F.col("known"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    # A row has at most WORD_BUCKETS + STRUCTURE + 1 places, so what the driver gathers has a fixed bound.
    got = map_text(wanted, ["doc_id", "text", "length", "y"], run, f"place array<int>, value array<float>, y int, doc_id {kind}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * max_per_class).toArrow()
    rows = [(np.array(p, np.int32), np.array(v, np.float32)) for p, v in zip(got["place"].to_pylist(), got["value"].to_pylist(), strict=True)]
    y = got["y"].to_numpy().astype(np.float64)
    if len(set(y)) < 2:  # labels of both classes, but not on these documents
        return fm.constant(set(y))
    fm.fit(rows, y, np.where(y == 1, class_weight[1], class_weight[0]))
    return fm


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, max_per_class: int = MAX_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, max_per_class))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, lengths, out = b.column(1).to_pylist(), b.column(2).to_pylist(), []
        lo = room = 0
        for k, t in enumerate(texts, 1):
            room += len(t or b"")
            if room > 4_000_000 or k == len(texts):
                out.append(shared.value.score(*features(texts[lo:k], lengths[lo:k])))
                lo, room = k, 0
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out).astype(np.float64))], names=["doc_id", "score"])

    scored = map_text(with_length(documents), ["doc_id", "text", "length"], run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
