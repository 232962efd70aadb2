"""Near-duplicates by the Jaccard similarity of word shingles: SimHash links and exact prefix keys, both verified.

Sets of at least a similarity t share one of their first n - ceil(tn) + 1 shingles in any order that all sets use, so
comparing texts of equal keys loses no pair. Shingles that many sampled documents hold (at most MOST, "common") come
last; what is sampled only changes the cost.

1. Texts of equal words are one text. Candidates are SimHash links (bit-sliced, few bits) and, for each key, a star
   around one of its texts. Common keys, which may be hot, are never shuffled: the stars' centres are a bounded
   list. Sizes prune, then the sets themselves are compared; these links join most copies.
2. All other pairs of a key whose texts are not yet linked and that share enough keys (see needed) are compared, so
   what is linked is exactly what pairs of at least t connect.

Compared texts travel compressed, and only those that are compared (see common.listed). Defined results: a null text,
like one without words, is like any other such text; a text of fewer words than a shingle is one shingle; a null
doc_id is never the smallest id; of rows that repeat doc_id and text one stays; ties don't arise, the smallest id of a
group is its name; very long texts are compared whole; an empty table gives an empty result; other columns are kept
as they are, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest
from zstandard import ZstdCompressor, ZstdDecompressor

from evidentia.llm.common import listed, map_text, materialize
from evidentia.llm.decontaminate import LOWER
from evidentia.llm.graph import components
from evidentia.llm.simhash import linked, majority, one_of_each, shingle_hashes

#: Documents sampled for the order of shingles, sampled ones that make a shingle a common one, and common ones kept.
SAMPLE, FREQUENT, MOST = 20_000, 3, 200_000


def split(text: bytes | None) -> list[bytes]:
    return text.translate(LOWER).split() if text else []


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    return np.unique(shingle_hashes(words, width).copy().view(">i8").astype(np.int64).ravel()) if words else np.zeros(0, np.int64)


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    at = pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32))
    return pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def sets_of(texts: DataFrame, key: str, width: int) -> DataFrame:
    """The key and the shingles of each text (a binary column text)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), lists([shingle_set(split(t), width) for t in b.column(1).to_pylist()])], names=[key, "s"])

    return map_text(texts, [key, "text"], run, f"{key} bigint, s array<bigint>")


def frequent(documents: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many sampled documents, ascending, and their counts: MOST rows at most."""
    every = max(1, documents.count() // SAMPLE)
    sample = documents.select(F.xxhash64("doc_id", "text").alias("k"), F.col("text").cast("binary").alias("text")).filter(F.pmod("k", F.lit(every)) == 0)
    counts = sets_of(sample, "k", width).select(F.explode("s").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FREQUENT)
    rows = sorted((r["x"], r["n"]) for r in counts.orderBy(F.desc("n"), "x").limit(MOST).collect())
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def prefixes(documents: DataFrame, width: int, least: float) -> DataFrame:
    """doc_id, k (a hash of the row), id (a hash of the words), fp, n (shingles), odd (those that aren't common), and the
    prefix in the common order, in two parts: rare and common keys."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    known, counts = frequent(documents, width)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, fps, ns, odd, rare, common = [], [], [], [], [], []
        for t in b.column(2).to_pylist():
            words = split(t)
            if words:
                raw = shingle_hashes(words, width)
                s = np.unique(raw.copy().view(">i8").astype(np.int64).ravel())
                ids.append(xxh64_intdigest(b" ".join(words)))
                fps.append(majority(raw))
            else:
                s = np.zeros(0, np.int64)
                ids.append(0)
                fps.append(0)
            size, n_rare = len(s) - math.ceil(least * len(s) - 1e-9) + 1, len(s)
            if len(known) and len(s):
                at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                weight = np.where(known[at] == s, counts[at], 0)
                s, n_rare = s[np.argsort(weight, kind="stable")], int((weight == 0).sum())
            ns.append(len(s))
            odd.append(n_rare)
            rare.append(s[: min(size, n_rare)])
            common.append(s[n_rare:size])
        signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), signed(ids), signed(fps), pa.array(ns, pa.int32()), pa.array(odd, pa.int32()), lists(rare), lists(common)], names=["doc_id", "k", "id", "fp", "n", "odd", "rare", "common"])

    texts = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("k"), F.col("text").cast("binary").alias("text"))
    return map_text(texts, ["doc_id", "k", "text"], run, f"doc_id {kind}, k bigint, id bigint, fp bigint, n int, odd int, rare array<bigint>, common array<bigint>")


def needed(n: Column, m: Column, least: float) -> Column:
    """How many keys of their prefixes sets of n and m shingles share at least: the rest of the set whose prefix ends
    first adds no more than its size to the overlap."""
    return least / (1 + least) * (n + m) - F.greatest(F.ceil(least * n - 1e-9), F.ceil(least * m - 1e-9)) + 1 - 1e-9


def fits(n: Column, m: Column, x: Column, y: Column, least: float) -> Column:
    """Whether sizes n and m, with x and y keys that may be shared, allow the similarity."""
    return (F.least(n, m) >= least * F.greatest(n, m) - 1e-9) & (F.least(x, y) >= needed(n, m, least))


def hopeful(pairs: DataFrame, sizes: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) that may be similar, with their rows' hashes ku, kv; shared: how many rare keys they share, or
    null if that isn't known."""
    own = lambda x: sizes.select(F.col("id").alias(x), *[F.col(c).alias(c + x) for c in ("n", "k", "c", "live")])
    both = pairs.join(own("u"), "u").join(own("v"), "v").filter(fits(F.col("nu"), F.col("nv"), F.col("liveu"), F.col("livev"), least))
    return both.filter(F.col("shared").isNull() | (F.col("shared") + F.least("cu", "cv") >= needed(F.col("nu"), F.col("nv"), least))).select("u", "v", "ku", "kv").distinct()


def verified(documents: DataFrame, sized: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (u, v) of at least the similarity."""
    wanted = materialize(sized.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("ku").alias("k")), F.struct(F.col("v").alias("id"), F.col("kv").alias("k")))).alias("x")).select("x.id", "x.k").distinct(), "wanted")
    whole, holders = documents.select(F.xxhash64("doc_id", "text").alias("k"), F.col("text").cast("binary").alias("text")), listed(wanted, "k")
    if holders is not None:
        whole = whole.join(holders, F.col("k") == F.col("_listed"), "left_semi")

    def pack(b: pa.RecordBatch) -> pa.RecordBatch:
        tool = ZstdCompressor(level=3)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([tool.compress(t or b"") for t in b.column(1).to_pylist()], pa.binary())], names=["k", "z"])

    packed = materialize(map_text(whole, ["k", "text"], pack, "k bigint, z binary").join(wanted, "k").select("id", "z"), "texts")
    both = sized.select("u", "v").join(packed.select(F.col("id").alias("v"), F.col("z").alias("zv")), "v").join(packed.select(F.col("id").alias("u"), F.col("z").alias("zu")), "u")

    def compare(b: pa.RecordBatch) -> pa.RecordBatch | None:
        tool, sets = ZstdDecompressor(), {}
        kept = []
        columns = [b.column(c).to_pylist() for c in range(4)]
        for u, v, zu, zv in zip(*columns, strict=True):
            for i, z in ((u, zu), (v, zv)):
                if i not in sets:
                    sets[i] = shingle_set(split(tool.decompress(z)), width)
            n, m = len(sets[u]), len(sets[v])
            o = len(np.intersect1d(sets[u], sets[v], assume_unique=True))
            kept.append(o >= least * (n + m - o) - 1e-9)
        at = pa.array(np.flatnonzero(kept))
        return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["u", "v"]) if len(at) else None

    return materialize(map_text(both, ["u", "v", "zu", "zv"], compare, "u bigint, v bigint"), "similar")


def mixed(keys: DataFrame, count: str, least: float) -> DataFrame:
    """Pairs (u, v) of ids that share a key (key, id, root, n, and a count of keys) but not a root, and whose sizes
    and counts allow the similarity; shared: the number of keys."""
    a, b = keys.alias("a"), keys.alias("b")
    apart = (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.root") != F.col("b.root"))
    both = a.join(b, apart & fits(F.col("a.n"), F.col("b.n"), F.col(f"a.{count}"), F.col(f"b.{count}"), least))
    return both.groupBy(F.col("a.id").alias("u"), F.col("b.id").alias("v")).agg(F.count(F.lit(1)).alias("shared"))


def groups(documents: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, k, fp (a group's hash) and component_id, the smallest doc_id that pairs of at least the similarity
    reach, of every document."""
    docs = materialize(prefixes(documents, width, least), "prefixes")
    distinct = docs.groupBy("id").agg(F.min("doc_id").alias("low"), F.min(F.struct("k", "fp", "n", F.size("common").alias("c"))).alias("x")).select("id", "low", "x.*")
    distinct = materialize(distinct, "distinct")
    spread = docs.select(F.explode("rare").alias("key"), "id")
    by_key = Window.partitionBy("key")
    keys = spread.withColumn("head", F.min("id").over(by_key)).withColumn("top", F.max("id").over(by_key)).filter("head < top").select("key", "id", "head").distinct()
    keys = materialize(keys, "keys")
    # c: common keys of the prefix; live: those and the rare ones that another text has too.
    live = keys.groupBy("id").agg(F.count(F.lit(1)).alias("rare"))
    sizes = materialize(distinct.join(live, "id", "left").select("id", "k", "n", "c", (F.coalesce("rare", F.lit(0)) + F.col("c")).alias("live")), "sizes")
    # Of a hot key's texts the one with the fewest shingles of its own is nearest to most others.
    common = docs.select(F.explode("common").alias("key"), "id", "odd")
    heads = common.groupBy("key").agg(F.min(F.struct("odd", "id")).alias("x"), F.min("id").alias("low"), F.max("id").alias("top")).filter("low < top")
    heads = materialize(heads.select("key", F.col("x.id").alias("head")), "heads")

    # SimHash links hold between fingerprints; the smallest text of each stands for it.
    first = materialize(distinct.filter("n > 0").groupBy("fp").agg(F.min("id").alias("r")), "first")
    same = distinct.filter("n > 0").join(first, "fp").select(F.col("r").alias("u"), F.col("id").alias("v"))
    near = linked(first.select("fp")).join(first.select(F.col("fp").alias("u"), F.col("r").alias("x")), "u").join(first.select(F.col("fp").alias("v"), F.col("r").alias("y")), "v").select(F.col("x").alias("u"), F.col("y").alias("v"))
    star = keys.filter("id <> head").groupBy(F.col("head").alias("u"), F.col("id").alias("v")).agg(F.count(F.lit(1)).alias("shared"))
    # heads has MOST rows at most.
    hot = common.join(F.broadcast(heads), "key").select(F.col("head").alias("u"), F.col("id").alias("v"))
    early = same.unionByName(near).unionByName(hot).filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().withColumn("shared", F.lit(None).cast("bigint"))
    tried = materialize(hopeful(early.unionByName(star), sizes, least), "pairs")
    edges = verified(documents, tried, width, least)
    roots = materialize(components(edges), "roots").withColumnsRenamed({"node": "id"})

    rooted = lambda x: x.join(sizes.select("id", "n", "c", "live"), "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    unlike = rooted(keys.select("key", "id")).withColumn("x", F.min("root").over(by_key)).withColumn("y", F.max("root").over(by_key)).filter("x <> y").drop("x", "y")
    rare = mixed(materialize(unlike, "unlike"), "live", least)
    # Pairs that share rare keys too are among those; others share no more than their common keys, and the first one
    # that they share has all others behind it, on either side.
    held = rooted(docs.filter(F.size("common") > 0).select("id", "common").dropDuplicates(["id"]))
    held = held.select("id", "n", "root", F.posexplode("common").alias("at", "key"), "c").withColumn("rest", F.col("c") - F.col("at")).drop("at", "c")
    several = held.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("key")
    hot = mixed(materialize(held.join(F.broadcast(several), "key"), "unlike"), "rest", least).withColumn("shared", F.lit(None).cast("bigint"))
    rest = hopeful(rare.unionByName(hot), sizes, least).join(tried.select("u", "v"), ["u", "v"], "left_anti")
    edges = edges.unionByName(verified(documents, materialize(rest, "pairs"), width, least))
    roots = components(edges)

    joined = distinct.join(roots, F.col("id") == F.col("node"), "left").select("id", "low", F.coalesce("root", "id").alias("root"))
    lowest = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    members = materialize(joined.join(lowest, "root").select(F.col("id").alias("class"), F.col("root").alias("fp"), "component_id"), "members")
    return docs.select("doc_id", "k", "id").join(members, F.col("id") == F.col("class")).select("doc_id", "k", "fp", "component_id")


def keep_one(documents: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """One document of each group, unchanged: that of the smallest doc_id. Documents without an id stay only where
    their group has none with one, one for each group."""
    return one_of_each(documents, groups(documents, width, least))
