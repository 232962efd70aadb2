"""Language identification with hyperdimensional profiles.

Every letter has a random +-1 vector drawn from a generator seeded by its code point. A trigram is bound from its
letters' vectors, each permuted (rotated) by its place, by elementwise product; a text is the bundle (sum) of its
trigrams. Prototypes bundle the unit vectors of a bounded sample of each language's training texts; a text gets the
language of the prototype with the greatest cosine.

A text's dot products with the prototypes come from its trigram counts, and its norm from the bundle itself, so each
distinct trigram is bound once a process (bounded cache). Defined results: null text or no letters gives `und` and
score 0; white space and other characters separate words as one space; equal cosines go to the first language by
name; repeated rows get equal results; texts of any length are read whole; an empty table gives an empty result;
other columns don't matter, whatever their names; without training rows everything is `und`.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import held_out, map_text

DIMENSIONS = 1024
#: Training texts of each language, at most; the model has one prototype for each language.
PER_LANGUAGE = 400
CACHE = 25_000


@lru_cache(20_000)
def letter(code: int, shift: int) -> np.ndarray:
    """The letter's vector, rotated by its place; code 0 is the space."""
    v = np.random.default_rng([20_240, code]).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1
    return np.roll(v, shift).astype(np.float32)


class Grams:
    """Bound trigram vectors, remembered up to CACHE; beyond that they are bound each time."""

    def __init__(self):
        self.row: dict[int, int] = {}
        self.table = np.empty((CACHE, DIMENSIONS), np.float32)

    def bound(self, g: int) -> np.ndarray:
        return letter(g >> 42, 2) * letter(g >> 21 & 0x1FFFFF, 1) * letter(g & 0x1FFFFF, 0)

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(DIMENSIONS, np.float32)
        row, at = self.row, []
        for g in grams.tolist():
            k = row.get(g)
            if k is None and len(row) < CACHE:
                k = row[g] = len(row)
                self.table[k] = self.bound(g)
            at.append(-1 if k is None else k)
        at, counts = np.array(at), counts.astype(np.float32)
        known = at >= 0
        if not known.all():
            for g, n in zip(grams[~known].tolist(), counts[~known].tolist(), strict=True):
                out += n * self.bound(g)
            at, counts = at[known], counts[known]
        for lo in range(0, len(at), 256):  # parts that stay in the cache
            out += counts[lo : lo + 256] @ self.table[at[lo : lo + 256]]
        return out


def is_letter() -> np.ndarray:
    """For each code point: itself lower-cased if a letter, else 0."""
    table = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


@lru_cache(1)
def shared() -> tuple[np.ndarray, Grams]:
    return is_letter(), Grams()


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct trigrams of the text's letters, words parted and framed by one space, and their counts."""
    if not text:
        return None
    table, _ = shared()
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    low = table[codes]
    low = np.r_[0, low, 0]
    keep = np.r_[True, (low[1:] != 0) | (low[:-1] != 0)]
    low = low[keep]
    if len(low) < 3:
        return None
    grams = (low[:-2] << 42) | (low[1:-1] << 21) | low[2:]
    return np.unique(grams, return_counts=True)


def bundle(found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return shared()[1].bundle(*found)


def prototypes(documents: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """The languages, by name, and their unit prototypes. Trains on text and non-null lang outside the held-out fold."""
    train = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
    train = train.filter(F.col("doc_id").isNotNull()).select("doc_id", "lang", "text", F.xxhash64("doc_id").alias("h"))
    # Of a language with n texts some 4 * per_language of the lowest hashes reach the window, however large n is.
    sizes = train.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("n"))
    low = train.join(F.broadcast(sizes), F.col("lang") == F.col("l")).filter(F.col("h") / 2.0**64 + 0.5 <= 4.0 * per_language / F.col("n"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    ranked = low.select("lang", "doc_id", "h").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_language)
    # One row for each language, like the model; texts stay where they are read.
    last = ranked.groupBy(F.col("lang").alias("l")).agg(F.max("h").alias("last"))
    sample = train.join(F.broadcast(last), (F.col("lang") == F.col("l")) & (F.col("h") <= F.col("last"))).select("text", "lang")

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if (found := trigrams(t)) is not None:
                    v = bundle(found)
                    sums[lang] = sums.get(lang, 0) + v / max(1e-9, float(np.linalg.norm(v)))
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.astype(np.float32) for v in sums.values()], pa.list_(pa.float32()))], names=["lang", "v"])

    parts = sample.mapInArrow(run, "lang string, v array<float>")
    whole = parts.select("lang", F.posexplode("v").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v"))
    rows = sorted((r["lang"], [x["x"] for x in r["v"]]) for r in whole.collect())
    if not rows:
        return [], np.zeros((0, DIMENSIONS), np.float32)
    m = np.array([v for _, v in rows], np.float32)
    return [lang for lang, _ in rows], m / np.maximum(1e-9, np.linalg.norm(m, axis=1, keepdims=True))


def identify(documents: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the cosine, at least 0) of every whole text."""
    names, proto = prototypes(documents, per_language)
    model = documents.sparkSession.sparkContext.broadcast((names, proto))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        names, proto = model.value
        best, score = [], []
        for t in b.column(1).to_pylist():
            found = trigrams(t) if names else None
            if found is None:
                best.append("und")
                score.append(0.0)
                continue
            v = bundle(found)
            cosine = proto @ v / max(1e-9, float(np.linalg.norm(v)))
            k = int(cosine.argmax())
            best.append(names[k])
            score.append(float(min(1.0, max(0.0, cosine[k]))))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = map_text(documents, ["doc_id", "text"], run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
