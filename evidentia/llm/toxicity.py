"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a lexicon (words, and word beginnings for inflected forms) learned from labelled rows,
closeness of its hits to second-person words, capitals, punctuation, and obfuscated spellings. Lexicon, trees and
calibration come from three disjoint parts of a bounded labelled sample (MAX_TOXIC, MAX_CLEAN) in which groups of
near copies count about once, so that the words of a much copied text don't pass for a lexicon; class weights
restore the true class shares.

Defined results: a null text scores like an empty one; repeated rows get equal scores, equal texts too; texts of any
length are read whole, in time that grows with their length; without labels of both classes the score is the class
share, or 0 without any label; an empty table gives an empty result; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from evidentia.llm.common import held_out, labelled_sample, map_text, small_batches
from evidentia.llm.rules import let

#: Bounds of the labelled sample and of the learned lexicon.
MAX_TOXIC, MAX_CLEAN, MAX_TERMS = 2000, 4000, 600
WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6, 7)
#: Second-person words of the corpus languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr sie ihnen tu te toi ton ta tes vous votre vos usted ustedes tú ti tuyo vosotros".split())
LEET = str.maketrans("0134578@$!|", "oieastba" + "sil")
#: A run of digits or signs with a letter behind it, inside or at the head of a word.
MASKED = re.compile(r"(?<![0-9@$!*+._-])[0-9@$!*+._-]++(?=[^\W\d_])")
GAP = re.compile(r"\s")
NEAR = 4
NAMES = ["word_density", "stem_density", "word_kinds", "stem_kinds", "near_you", "you_density", "caps", "shout", "bangs", "points", "obfuscated", "masked_hits", "stretched", "log_words"]


def terms_of(words: set[str]) -> set[str]:
    """Words, and the beginnings of longer words, marked by a trailing hyphen."""
    return words | {w[:k] + "-" for w in words for k in STEMS if len(w) > k}


@dataclass
class Lexicon:
    words: frozenset = frozenset()
    stems: frozenset = frozenset()
    by_length: dict = field(default_factory=dict)

    @staticmethod
    def of(terms: list[str]) -> Lexicon:
        words = frozenset(t for t in terms if t[-1] != "-")
        by_length = defaultdict(list)
        for w in sorted(words):
            by_length[len(w)].append(w)
        return Lexicon(words, frozenset(t[:-1] for t in terms if t[-1] == "-"), dict(by_length))

    def stem_of(self, w: str) -> str | None:
        return next((w[:k] for k in STEMS if len(w) > k and w[:k] in self.stems), None)

    def unmask(self, token: str) -> bool:
        """Whether a token with digits or signs in it spells a word of the lexicon."""
        token = token.strip(".,;:?!\"'()")
        plain = "".join(c for c in token.translate(LEET) if c.isalpha())
        if plain in self.words or "".join(c for c in token if c.isalpha()) in self.words:
            return True
        if "*" in token:
            alike = lambda w: all(c in ("*", x) for c, x in zip(token, w, strict=True))
            return any(alike(w) for w in self.by_length.get(len(token), ()))
        return False


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    text = text or ""
    low = text.lower()
    words = WORD.findall(low)
    n = max(1, len(words))
    counts = Counter(words)
    hits = lexicon.words & counts.keys()
    stems = {w: s for w in counts if (s := lexicon.stem_of(w)) is not None and w not in hits} if lexicon.stems else {}
    n_hit, n_stem = sum(counts[w] for w in hits), sum(counts[w] for w in stems)
    near = 0
    if n_hit or n_stem:
        places = [i for i, w in enumerate(words) if w in hits or w in stems]
        near = sum(not SECOND_PERSON.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]) for i in places)
    masked = masked_hits = end = 0
    for m in MASKED.finditer(low):
        if m.start() < end:
            continue
        before = low[end : m.start()]
        head = before.rsplit(None, 1)[-1] if before and not before[-1].isspace() else ""
        gap = GAP.search(low, m.end())
        end = gap.start() if gap else len(low)
        token = head + low[m.start() : end]
        if ("a" <= token.strip("*_-.!")[-1:] <= "z" or any(c.isdigit() for c in token)) and sum(c.isalpha() for c in token) > 1:
            masked += 1
            masked_hits += lexicon.unmask(token)
    stretched = sum(counts[w] for w in counts if len(w) > 3 and any(c * 3 in w for c in set(w)) and re.sub(r"(.)\1+", r"\1", w) in lexicon.words) if any(c * 3 in low for c in "aeiou") else 0
    size = max(1, len(text))
    data = text.encode()
    caps = len(data) - len(data.translate(None, bytes(range(65, 91))))
    return [
        (n_hit + masked_hits + stretched) / n, n_stem / n, len(hits), len(set(stems.values())), near / max(1, n_hit + n_stem), sum(counts[w] for w in SECOND_PERSON & counts.keys()) / n,
        caps / size, float(caps > 0.5 * size), text.count("!") / n, (text.count(".") + text.count(",") + text.count("?")) / n, masked / n, masked_hits, stretched, np.log1p(len(words)),
    ]


class Trees:
    """Boosted trees of fixed depth on the weighted logistic loss, over quantile bins."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bias = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(c[c > 0] if (c > 0).any() else c, np.linspace(0, 1, self.bins))) for c in x.T]
        cuts = [np.unique(np.r_[0.0, (c[1:] + c[:-1]) / 2, c[0] / 2]) for c in cuts]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        width = max(len(c) for c in cuts) + 1
        weight = weight / weight.mean()
        self.bias = float(np.log((weight @ y + 1) / (weight @ (1 - y) + 1)))
        margin = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = weight * (p - y), weight * p * (1 - p) + 1e-9
            node = np.zeros(len(y), np.int64)
            features, values = [], []
            for level in range(self.depth):
                nodes = 1 << level
                best = np.full(nodes, 1e-6)
                f_of, b_of = np.zeros(nodes, np.int64), np.full(nodes, width)
                for f in range(x.shape[1]):
                    at = node * width + binned[:, f]
                    gl = np.bincount(at, g, nodes * width).reshape(nodes, width).cumsum(axis=1)
                    hl = np.bincount(at, h, nodes * width).reshape(nodes, width).cumsum(axis=1)
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(nodes), k]
                    new = top > best
                    best[new], f_of[new], b_of[new] = top[new], f, k[new]
                features.append(f_of)
                values.append(np.array([cuts[f][b] if b < len(cuts[f]) else np.inf for f, b in zip(f_of, b_of, strict=True)]))
                node = 2 * node + (binned[np.arange(len(y)), f_of[node]] > b_of[node])
            leaves = 1 << self.depth
            leaf = -self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.l2)
            self.trees.append((np.concatenate(features), np.concatenate(values), leaf))
            margin += leaf[node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (x[rows, feature[at]] > cut[at])
            out += leaf[node]
        return out


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (scores, calibrated values), both ascending, to be interpolated."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of weight, of weight * y, of weight * score
    for s, t, w in zip(score[order], y[order], weight[order], strict=True):
        blocks.append([w, w * t, w * s])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    # Half a case of either class keeps the ends off 0 and 1.
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    xs: np.ndarray
    ys: np.ndarray
    constant: float = 0.0

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.constant)
        margin = self.trees.margin(np.array([features(t, self.lexicon) for t in texts]))
        # A little of the margin keeps the order inside a pooled block.
        return np.clip(0.98 * np.interp(margin, self.xs, self.ys) + 0.02 / (1 + np.exp(-np.clip(margin, -30, 30))), 0, 1)


def apart(sample: DataFrame) -> DataFrame:
    """doc_id, text, y with one document, that of the smallest doc_id, for each class and smallest hash of three
    neighbouring words; near copies mostly share it."""
    def lowest(w):
        return F.when(F.size(w) < 3, F.xxhash64(w)).otherwise(F.array_min(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))))

    low = let(F.split(F.coalesce("text", F.lit("")), r"\s+"), lowest)
    return sample.groupBy(low.alias("low"), "y").agg(F.min("doc_id").alias("id"), F.min_by("text", "doc_id").alias("text")).select(F.col("id").alias("doc_id"), "text", "y")


def learn_lexicon(sample: DataFrame, sizes: dict[int, int]) -> Lexicon:
    """Terms of many toxic and next to no clean sample documents."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[tuple[str, int], int] = defaultdict(int)
        for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for term in terms_of(set(WORD.findall((t or "").lower()))):
                counts[term, y] += 1
        return pa.RecordBatch.from_arrays([pa.array([t for t, _ in counts], pa.string()), pa.array([y for _, y in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["term", "y", "n"])

    counted = map_text(sample, ["text", "y"], run, "term string, y int, n bigint")
    hot = counted.groupBy("term").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("clean"))
    least = max(4, 0.006 * sizes.get(1, 0))
    pure = (F.col("toxic") >= least) & (F.col("clean") / max(1, sizes.get(0, 0)) <= 0.02 * F.col("toxic") / max(1, sizes.get(1, 0)))
    return Lexicon.of([r["term"] for r in hot.filter(pure).orderBy(F.desc("toxic"), "term").limit(MAX_TERMS).collect()])


def fit(documents: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    sample, weight = labelled_sample(documents, labels, "toxic", {0: max_clean, 1: max_toxic})
    nothing = np.zeros(1)
    if len(weight) < 2:
        return Model(Lexicon(), None, nothing, nothing, float(1 in weight))
    sample = apart(sample).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(5)))
    fitted = sample.filter("part > 1")
    sizes = {int(r["y"]): r["n"] for r in fitted.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    lexicon = learn_lexicon(fitted, sizes)
    shared = documents.sparkSession.sparkContext.broadcast(lexicon)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x = [features(t, shared.value) for t in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "part", "x"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = map_text(sample, ["doc_id", "text", "y", "part"], run, f"doc_id {kind}, y int, part bigint, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * (max_toxic + max_clean)).toArrow()
    y = rows["y"].to_numpy().astype(np.float64)
    if len(set(y)) < 2:  # labels of both classes, but not on these documents
        return Model(Lexicon(), None, nothing, nothing, float(y[0]) if len(y) else 0.0)
    x, part = np.array(rows["x"].to_pylist(), np.float64), rows["part"].to_numpy()
    shares = {c: weight[c] * {0: max_clean, 1: max_toxic}[c] if weight[c] > 1 else max(1.0, (y == c).sum()) for c in (0, 1)}
    w = np.where(y == 1, shares[1] / max(1, (y == 1).sum()), shares[0] / max(1, (y == 0).sum()))
    own, held = part == 1, part == 0
    if len(set(y[own])) < 2 or len(set(y[held])) < 2:
        own = held = np.ones(len(y), bool)
    trees = Trees().fit(x[own], y[own], w[own])
    xs, ys = isotonic(trees.margin(x[held]), y[held], w[held])
    return Model(lexicon, trees, xs, ys)


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text."""
    return scored(documents.select("doc_id", "text"), fit(documents, labels, max_toxic, max_clean)).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def scored(documents: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The documents' own columns and, under the given name, the model's score of the whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")
    small_batches(documents.sparkSession)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.score(b.column(at).to_pylist()), pa.float64())], names=[*b.schema.names, name])

    return documents.mapInArrow(run, StructType([*documents.schema.fields, StructField(name, DoubleType())]))


def drop_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score stays below the threshold, unchanged."""
    name = "_toxicity"
    return scored(documents, fit(documents, labels), name).filter(F.col(name) < threshold).drop(name)
