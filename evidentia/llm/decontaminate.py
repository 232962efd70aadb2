"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

Every benchmark item gives windows of consecutive words. The words of a window are ordered by rarity over the corpus;
as an occurrence holds all of them, one necessary prefix token suffices: the rarest. Documents give their places of
prefix tokens, with the words around them, and are joined with the windows of that token. The token's place in the
window (positional bound) and the document's length (length bound) leave one candidate each, which is compared word by
word.

Whatever the benchmark's size, the corpus is read twice: once for the words' frequencies and once for the places.
What is sent to executors are two filters of FILTER_BITS bits; where they pass too much, the joins drop it. Defined
results: a null text has no words; an item without an id, a text or words has no windows; repeated items and repeated
rows count once and give equal results; ties in rarity go to the first word by name; an empty benchmark hits nothing,
an empty table gives an empty result; texts of any length are read whole; other columns are kept by drop_contaminated
and ignored else, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from evidentia.llm.common import listed, map_text, materialize

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bits of a word filter (a power of two), and words that a worker remembers.
FILTER_BITS, REMEMBERED = 1 << 25, 200_000


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.translate(LOWER)) if text else []


def windows_of(words: list[bytes], width: int) -> list[list[bytes]]:
    if not words:
        return []
    return [words[i : i + width] for i in range(max(1, len(words) - width + 1))]


def windows(benchmark: DataFrame, width: int) -> DataFrame:
    """item and win, an array of words: every different window of every item."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = {(i, b" ".join(w)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w in windows_of(words_of(t), width)}
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.string()), pa.array([w.decode() for _, w in rows], pa.string())], names=["item", "win"]) if rows else None

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")).dropna()
    return materialize(map_text(items, ["item", "text"], run, "item string, win string").distinct(), "windows")


class Passes:
    """Whether a word passes a filter; some words beyond those it was made of do."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.known = bits, {}

    def __call__(self, word: bytes) -> bool:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            got = self.known[word] = bool(self.bits[xxh64_intdigest(word, 42) % len(self.bits)])
        return got


def word_filter(words: DataFrame) -> Passes:
    """A filter of FILTER_BITS bits that the column word passes."""
    place = F.pmod(F.xxhash64(F.col("word").cast("binary")).bitwiseAND(FILTER_BITS - 1), F.lit(FILTER_BITS)) + 1
    parts = words.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits"))
    out = np.zeros(FILTER_BITS, bool)
    for r in parts.collect():  # FILTER_BITS / 8 bytes at most
        own = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
        lo = (r["part"] - 1) * len(own)
        out[lo : lo + len(own)] = own[: max(0, FILTER_BITS - lo)]
    return Passes(out)


def frequencies(documents: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """word, n: in how many documents each word of the vocabulary stands, and perhaps of some others."""
    model = documents.sparkSession.sparkContext.broadcast(word_filter(vocabulary))

    def count(batches):
        total: dict[bytes, int] = defaultdict(int)

        def out():
            names = [w.decode() for w in total]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                for w in set(words_of(t)):
                    if model.value(w):
                        total[w] += 1
            if len(total) > REMEMBERED:
                yield out()
                total.clear()
        if total:
            yield out()

    return documents.select(F.col("text").cast("binary")).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def hits(documents: DataFrame, benchmark: DataFrame, width: int = 10) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k, n_words) of every document, and for those with hits k, spans (start and end of each occurrence) and
    items (whose windows occur, sorted as strings). k is the hash of doc_id and text."""
    wins = windows(benchmark, width)
    parted = wins.select("win").distinct().select("win", F.posexplode(F.split("win", " ")).alias("at", "word"))
    vocabulary = materialize(parted.select("word").distinct(), "vocabulary")
    known = frequencies(documents, vocabulary)
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("x")
    spots = materialize(parted.join(known, "word", "left").groupBy("win").agg(rarest, F.count(F.lit(1)).alias("length")).select("win", "length", "x.word", "x.at"), "spots")
    model = documents.sparkSession.sparkContext.broadcast(word_filter(spots.select("word").distinct()))
    place_of = pa.struct([("p", pa.int32()), ("b", pa.int32()), ("word", pa.string()), ("around", pa.string())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        passes, sizes, places = model.value, [], []
        for t in b.column(2).to_pylist():
            words = words_of(t)
            sizes.append(len(words))
            present = {w for w in set(words) if passes(w)}
            own = []
            if present:
                for p, w in enumerate(words):
                    if w in present:
                        lo = max(0, p - width + 1)
                        own.append({"p": p, "b": p - lo, "word": w.decode(), "around": b" ".join(words[lo : p + width]).decode()})
            places.append(own)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(places, pa.list_(place_of))], names=["doc_id", "k", "n_words", "places"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("k"), F.col("text").cast("binary").alias("text"))
    seen = materialize(map_text(texts, ["doc_id", "k", "text"], run, f"doc_id {kind}, k bigint, n_words bigint, places array<struct<p:int,b:int,word:string,around:string>>"), "places")
    start = F.col("x.p") - F.col("at")
    same = F.array_join(F.slice(F.split("x.around", " "), F.col("x.b") - F.col("at") + 1, F.col("length").cast("int")), " ") == F.col("win")
    found = seen.select("k", "n_words", F.explode("places").alias("x")).withColumn("word", F.col("x.word")).join(spots, "word").filter((start >= 0) & (start + F.col("length") <= F.col("n_words"))).filter(same)
    found = materialize(found.select("k", start.alias("start"), (start + F.col("length")).cast("int").alias("end"), "win").distinct(), "hits")
    spans = found.groupBy("k").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    items = found.select("k", "win").distinct().join(wins, "win").groupBy("k").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return seen.select("doc_id", "k", "n_words"), spans.join(items, "k").withColumnRenamed("k", "hit")


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The digest of hits for every document: counts, the items' hash, and whether any word is hit."""
    docs, found = hits(documents, benchmark, width)
    # Sorted spans overlap or follow: each adds what lies behind the last end.
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end"))
    n_hit = F.coalesce(F.aggregate("spans", start, step, lambda a: a["n"]), F.lit(0).cast("bigint"))
    joined = docs.join(found, F.col("k") == F.col("hit"), "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), F.col("hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The documents without any hit word, unchanged."""
    hit = materialize(hits(documents, benchmark, width)[1].select("hit"), "contaminated")
    holders = listed(hit, "hit")
    gone = hit.withColumnRenamed("hit", "_listed") if holders is None else holders
    return documents.withColumn("_k", F.xxhash64("doc_id", "text")).join(gone, F.col("_k") == F.col("_listed"), "left_anti").drop("_k")


def brute_force(documents: list[tuple], items: list[tuple], width: int = 10) -> list[tuple]:
    """The same digest for small inputs, without any filter."""
    wins = [(str(i), w) for i, t in items if t is not None and i is not None for w in windows_of(words_of(t.encode()), width)]
    out = []
    for doc, text in documents:
        words = words_of(text.encode()) if text else []
        hit, found = set(), set()
        for item, w in wins:
            for p in range(len(words) - len(w) + 1):
                if words[p : p + len(w)] == w:
                    hit |= set(range(p, p + len(w)))
                    found.add(item)
        out.append((doc, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out
