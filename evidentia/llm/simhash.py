"""SimHash near-duplicates with bit-sliced comparison.

Distinct fingerprints are dealt to buckets: 64 bits in four blocks, one bucket table for each choice of blocks that
must agree within the radius (at most radius blocks can differ). Inside a bucket the fingerprints' bit planes are
stored vertically, 64 fingerprints to a word. Every fingerprint is compared with all others of its bucket at once:
the planes' differences go through carry-save counters, and words are abandoned as soon as all their lanes exceed
the radius. A bucket gives a star around each of its linked groups, never all pairs.

Buckets above a size are cut into chunks, and every pair of chunks is a bucket of its own, so that no task holds
more than two chunks and no pair is lost.

Defined results: a null text, like one without words, has fingerprint zero and links like any other; copies share
a fingerprint, and only distinct ones are compared; a null doc_id keeps its row and is never the smallest id; a bit set
in exactly half the hashes is 0 (ties); rows that repeat get equal results; texts of any length are read whole; an empty
table gives an empty result; other columns don't matter, whatever their names.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from evidentia.llm.common import listed, map_text, materialize
from evidentia.llm.decontaminate import LOWER
from evidentia.llm.graph import components

#: Members of a bucket, or of one chunk of a larger one.
CHUNK = 2048
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """The big-endian bytes of each word shingle's hash, one row a shingle; fewer words than width are one shingle."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    stop = ends[width - 1 :].tolist() or [len(joined)]
    start = [0, *(ends[: n - 1] + 1).tolist()]
    return np.frombuffer(b"".join(map(xxh64_digest, [joined[a:b] for a, b in zip(start, stop, strict=True)], repeat(42))), np.uint8).reshape(n, 8)


def majority(raw: np.ndarray) -> int:
    ones = np.concatenate([np.bincount(raw[:, k], minlength=256) @ BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big")


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The unsigned 64-bit SimHash of word shingles: a bit is set if it's set in over half of the hashes."""
    words = text.translate(LOWER).split() if text else []
    return majority(shingle_hashes(words, width)) if words else 0


def fingerprints(documents: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, th (a hash of the text) and fp, the fingerprint as a signed long, of every whole text."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = np.array([fingerprint(t, width) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got)], names=["doc_id", "th", "fp"])

    return map_text(documents.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text")), ["doc_id", "th", "text"], run, f"doc_id {kind}, th bigint, fp bigint")


def links(values: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For buckets of uint64 fingerprints laid end to end: (member, root) places, root the smallest member that the
    bucket's links reach, for all members whose root is another."""
    n = len(values)
    starts = np.cumsum(sizes) - sizes
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(n) - starts[bucket]
    words = -(-sizes // 64)
    first_word = np.cumsum(words) - words
    word, lane = first_word[bucket] + place // 64, (place % 64).astype(np.uint64)
    heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    valid = np.bitwise_or.reduceat(np.uint64(1) << lane, heads)
    planes = np.stack([np.bitwise_or.reduceat(((values >> np.uint64(b)) & np.uint64(1)) << lane, heads) for b in range(64)])
    # One row for each member and each word of its bucket.
    member = np.repeat(np.arange(n), words[bucket])
    row_start = np.cumsum(words[bucket]) - words[bucket]
    at = first_word[bucket[member]] + np.arange(len(member)) - row_start[member]
    ones = np.zeros(len(member), np.uint64)
    twos, over = ones.copy(), ones.copy()
    query = values[member]
    for b in range(64):
        d = planes[b][at] ^ np.where((query >> np.uint64(b)) & np.uint64(1), ALL, np.uint64(0))
        carry = ones & d
        ones ^= d
        over |= twos & carry
        twos ^= carry
        if b % 8 == 7:  # abandon words with no lane left within the radius
            out = over | (twos & ones) if radius == 2 else over | twos if radius == 1 else over | twos | ones if radius == 0 else over
            live = (valid[at] & ~out) != 0
            member, at, query, ones, twos, over = (x[live] for x in (member, at, query, ones, twos, over))
    out = over | (twos & ones) if radius == 2 else over | twos if radius == 1 else over | twos | ones if radius == 0 else over
    near = valid[at] & ~out
    # Itself aside.
    own = at == word[member]
    near[own] &= ~(np.uint64(1) << lane[member[own]])
    kept = near != 0
    adjacency: dict[int, list[tuple[int, int]]] = {}
    base = (starts[bucket[member]] + 64 * (at - first_word[bucket[member]]))[kept].tolist()
    for m, lo, bits in zip(member[kept].tolist(), base, near[kept].tolist(), strict=True):
        adjacency.setdefault(m, []).append((lo, bits))
    left, right, seen = [], [], np.zeros(n, bool)
    for m in adjacency:  # members ascend, so a group is met at its smallest member first
        if seen[m]:
            continue
        seen[m] = True
        todo = [m]
        while todo:
            for lo, bits in adjacency[todo.pop()]:
                while bits:
                    low = bits & -bits
                    bits ^= low
                    x = lo + low.bit_length() - 1
                    if not seen[x]:
                        seen[x] = True
                        todo.append(x)
                        left.append(x)
                        right.append(m)
    return np.array(left, np.int64), np.array(right, np.int64)


def linked(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (u, v) between distinct fingerprints fp such that whatever links of at most radius bits connect, the
    edges connect."""
    if not 0 <= radius <= 3:
        raise ValueError("the counters hold distances up to 3")
    blocks, bits = (4, 16) if radius <= 2 else (8, 8)
    parts = [F.shiftrightunsigned("fp", b * bits).bitwiseAND((1 << bits) - 1) for b in range(blocks)]
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        keys.append(F.xxhash64(F.lit(k), *[parts[c] for c in chosen]))
    spread = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    # Written, so that a bucket with very many members can be split in the join.
    large = materialize(spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("c")), "buckets")
    own = F.pmod(F.xxhash64("fp"), F.col("c")).cast("int")
    # A bucket of c chunks gives c(c+1)/2 pairs of chunks; a member goes to the c pairs that hold its chunk.
    tiles = F.when(F.col("c") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda x: F.least(x, own).cast("bigint") * F.col("c") + F.greatest(x, own)))
    dealt = spread.join(large, "key").select("key", "fp", F.explode(tiles).alias("tile"))
    parts_n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts_n, "key", "tile").sortWithinPartitions("key", "tile", "fp")

    def run(batches):
        tail: list[tuple] = []
        for b in batches:
            yield from compare([*tail, (b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy())], tail)
        if tail:
            rest, tail = tail, []
            yield from compare([*rest, None], tail)

    def compare(chunks, tail):
        """Compares all buckets but the last, which may go on in the next batch and stays in tail."""
        final = chunks[-1] is None
        key, fp, tile = (np.concatenate(x) for x in zip(*[c for c in chunks if c is not None], strict=True))
        tail.clear()
        heads = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])])
        if not final:
            tail.append((key[heads[-1] :], fp[heads[-1] :], tile[heads[-1] :]))
            key, fp, tile, heads = key[: heads[-1]], fp[: heads[-1]], tile[: heads[-1]], heads[:-1]
        sizes = np.diff(np.r_[heads, len(fp)])
        lo = 0
        while lo < len(sizes):  # at most about a million rows of (member, word) at once
            hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:] * (-(-sizes[lo:] // 64))), 1_000_000)))
            a, z = heads[lo], heads[lo] + sizes[lo:hi].sum()
            u, v = links(fp[a:z].view(np.uint64), sizes[lo:hi], radius)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(fp[a:z][u]), pa.array(fp[a:z][v])], names=["u", "v"])
            lo = hi

    return dealt.select("key", "fp", "tile").mapInArrow(run, "u bigint, v bigint").distinct()


def classes(documents: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, th, fp and component_id, the smallest doc_id that links reach, of every document."""
    docs = materialize(fingerprints(documents, width), "fingerprints")
    distinct = docs.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(linked(distinct.select("fp"), radius))
    # One row for each distinct fingerprint that has a link; the others keep their own smallest doc_id.
    joined = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    members = joined.join(lowest, "root").select(F.col("fp").alias("class"), "component_id")
    return docs.join(members, F.col("fp") == F.col("class"), "left").select("doc_id", "th", "fp", "component_id")


def near_duplicates(documents: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    return classes(documents, width, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """One document of each group, unchanged: that of the smallest doc_id. Documents without an id stay only where
    their group has none with one, one for each fingerprint."""
    keys = documents.select("doc_id", F.xxhash64("text").alias("th"), F.xxhash64("doc_id", "text").alias("k")).distinct()
    found = classes(documents, width, radius)
    return one_of_each(documents, found.join(keys.withColumnsRenamed({"doc_id": "_id", "th": "_th"}), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("doc_id", "k", "fp", "component_id"))


def one_of_each(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that stay of the groups in found (doc_id, k, fp, component_id); k is the hash of doc_id and text.

    Each group keeps the row of its smallest doc_id. If the rows to go are few enough to be listed, no text moves but
    that of repeated rows (equal doc_id and text), of which one stays; beyond that, texts are shuffled once."""
    found = found.withColumn("loose", F.when(F.col("component_id").isNull(), F.col("fp")))
    chosen = found.groupBy("component_id", "loose").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "k")).alias("x")).select(F.col("x.k").alias("_kept"))
    chosen = materialize(chosen, "chosen")
    rows = materialize(found.groupBy("k").agg(F.count(F.lit(1)).alias("rows")), "rows")
    # Neither gone nor repeated means that the row stays as it is.
    odd = materialize(rows.join(chosen, F.col("k") == F.col("_kept"), "left").filter("_kept is null or rows > 1").select("k", F.col("_kept").isNotNull().alias("stays")), "odd")
    keyed = documents.withColumn("_k", F.xxhash64("doc_id", "text"))
    holders = listed(odd, "k")
    if holders is None:
        return keyed.join(chosen, F.col("_k") == F.col("_kept"), "left_semi").dropDuplicates(["_k"]).drop("_k")
    plain = keyed.join(holders, F.col("_k") == F.col("_listed"), "left_anti")
    # At most as many as odd has, which was counted.
    twice = keyed.join(F.broadcast(odd.filter("stays").select(F.col("k").alias("_listed"))), F.col("_k") == F.col("_listed"), "left_semi").dropDuplicates(["_k"])
    return plain.unionByName(twice).drop("_k")
