"""Exact removal of long repeated strings, by longest-previous-factor arrays.

A string is min_bytes long, or shorter where it already reaches into `words` words (the last one's first byte ends it).
A place is repeated if its longest previous factor (without keep_first: its longest factor that also starts elsewhere)
is at least a string; that factor goes. Equal strings share their minimizer (the smallest hash of their ANCHOR-byte
windows), so it is enough to compare texts around equal anchors:

1. every text gives its anchors with the hash of the bytes around each (the context, all that a string over the anchor
   can reach); anchors that stand once go; where all contexts of an anchor are equal, the whole context is repeated;
2. elsewhere one copy of each different context is fetched. The suffixes of an anchor's contexts are ordered (a suffix
   array for each distance from the anchor, with its common prefixes), and the previous and next smaller text positions
   in suffix order give the longest previous factor of every place. Strings start where it is long enough.

keep_first keeps the first copy, in the order of (doc_id, text hash, place), and removes later ones; without it every
copy goes. An anchor with more than CHUNK different contexts is cut into chunks and compared pair of chunks by pair;
from TILES chunks on, its strings are counted by 128-bit hashes instead, so no work grows with the square of a group.

Texts are shuffled only where they hold something that is compared or removed, as long as the list of those (measured)
has at most LISTED entries; beyond that all texts are.

Defined results: a null text counts as empty; strings never cross documents; texts below a string's length are kept
whole; very long texts are hashed in segments; an empty table gives an empty result; ties don't arise (text positions
are unique); extra columns are carried by rewrite() under any name; rows that repeat doc_id and text are one another's
copies (with keep_first none of them is the later one, and they get equal results); bytes that a removal leaves of a
character are kept in the bytes and dropped from the text.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType
from xxhash import xxh3_64_intdigest, xxh3_128_intdigest

from evidentia.llm.common import listed, map_text, materialize

#: Bytes of an anchor, bytes of a text that are hashed at once, different contexts in a chunk, and chunks of an anchor.
ANCHOR, SEGMENT, CHUNK, TILES = 64, 1 << 20, 2000, 16
#: Bytes of contexts whose suffixes are sorted together.
BATCH = 3 << 20
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


@lru_cache(1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64."""
    n = SEGMENT + 4096
    return np.cumprod(np.r_[np.uint64(1), np.full(n, BASE, np.uint64)]), np.cumprod(np.r_[np.uint64(1), np.full(n, INVERSE, np.uint64)])


def window_hashes(a: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k-byte window that depends on nothing but its bytes."""
    up, down = powers()
    total = np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)])
    h = total[k - 1 :].copy()
    h[1:] -= total[: len(a) - k]
    h *= down[: len(h)]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def needs(a: np.ndarray, least: int, words: int) -> np.ndarray:
    """How many bytes from each place make a string: least, or fewer if they reach into that many words (0: never)."""
    out = np.full(len(a), least, np.int64)
    if words and len(a):
        space = SPACE[a]
        begins = ~space & np.r_[True, space[:-1]]
        heads = np.flatnonzero(begins) + 1
        last = np.cumsum(begins) - 1 + space + words - 1
        full = np.flatnonzero(last < len(heads))
        out[full] = np.minimum(least, heads[last[full]] - full)
    return out


def anchors(data: bytes, least: int, words: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the minimizers of all strings."""
    places, hashes = [], []
    for lo in range(0, max(1, len(data) - ANCHOR + 1), SEGMENT - least):
        a = np.frombuffer(data[lo : lo + SEGMENT], np.uint8)
        if len(a) < ANCHOR:
            break
        h = window_hashes(a, ANCHOR)
        # Unique keys: the hash's upper bits, then the place from the right.
        low = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h) - 1, -1, -1, dtype=np.uint64)
        need = needs(a, least, words)
        start = np.flatnonzero(np.arange(len(a)) + need <= len(a))
        width = need[start] - ANCHOR + 1
        # Minima of 2^k neighbours; a string's is that of two such ranges.
        found, span = [], 1
        while len(start) and span <= width.max():
            own = (width >= span) & (width < 2 * span)
            at, w = start[own], width[own]
            found.append(np.minimum(low[at], low[at + w - span]))
            low = np.minimum(low[: max(0, len(low) - span)], low[span:])
            span *= 2
        if found:
            low = np.concatenate(found)
            at = np.unique(len(h) - 1 - (low & np.uint64(0xFFFFFF)).astype(np.int64))
            places.append(at + lo)
            hashes.append(h[at])
        if lo + SEGMENT >= len(data):
            break
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(hashes)[first]


def previous_factors(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each place in suffix order, the longest prefix that also starts at an earlier text position. order: text
    positions in suffix order; common[k]: the prefix that suffix k shares with its predecessor, 0 at k = 0.

    Of all earlier positions the previous and the next smaller one in suffix order share most. Links to them jump over
    what is larger, all at once, and carry the least common prefix on their way."""
    best = np.zeros(len(order), np.int64)
    for back in (False, True):
        text = order[::-1] if back else order
        reach = np.r_[0, common[:0:-1]] if back else common.copy()
        reach[:1] = 0
        link = np.where(reach > 0, np.arange(len(order)) - 1, -1)
        todo = np.flatnonzero((link >= 0) & (text[link] > text))
        while len(todo):
            over = link[todo]
            reach[todo] = np.minimum(reach[todo], reach[over])
            link[todo] = link[over]
            todo = todo[link[todo] >= 0]
            todo = todo[text[link[todo]] > text[todo]]
        reach[link < 0] = 0
        best = np.maximum(best, reach[::-1] if back else reach)
    return best


def longest_previous_factor(data: bytes) -> np.ndarray:
    """For each position of one text the length of the longest string there that also starts earlier."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    order = np.array(sorted(range(n), key=lambda i: data[i:]))
    common = np.array([0, *(next((k for k, (x, y) in enumerate(zip(data[i:], data[j:], strict=False)) if x != y), n - max(i, j)) for i, j in zip(order[:-1], order[1:], strict=True))])
    out = np.zeros(n, np.int64)
    out[order] = previous_factors(order, common)
    return out


def repeats(bodies: list[bytes], least: int, groups: list[int], centres: list[int], words: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For contexts of anchors, sorted by group and then in text order, each with its anchor's place in it: how long the
    longest factor at each distance to the anchor is (row 0: least - ANCHOR before it) that also starts in an earlier
    context of the group, and in any other; 0 if it is shorter than a string.

    Equal strings share an anchor, so it is enough to compare the suffixes that start at one distance from it. Going
    from the contexts' ends to their starts, each column's suffix order follows from the next one's by a stable sort
    on one byte, and the common prefixes of neighbours from minima of the old ones."""
    left, n = least - ANCHOR, len(bodies)
    grid = np.full((n, left + least), 256, np.int16)  # 256: beyond the document's ends
    need = np.full((n, left + least), 1 << 20, np.int64)
    for row, own, body, centre in zip(grid, need, bodies, centres, strict=True):
        a = np.frombuffer(body, np.uint8)
        row[left - centre : left - centre + len(body)] = a
        own[left - centre : left - centre + len(body)] = needs(a, least, words)
    grid, need = np.ascontiguousarray(grid.T), np.ascontiguousarray(need.T[: left + 1])
    floor = int(need.min(initial=1 << 20))
    base = np.array(groups, np.int64) * 512
    order, common = np.arange(n), np.zeros(n + 1, np.int64)
    earlier, other = np.zeros((left + 1, n), np.int16), np.zeros((left + 1, n), np.int16)
    for c in range(len(grid) - 1, -1, -1):
        byte = grid[c][order]
        key = base + byte
        step = np.zeros(n + 1, np.int64)
        if (key[1:] >= key[:-1]).all():
            same = np.flatnonzero((key[1:] == key[:-1]) & (byte[1:] != 256)) + 1
            step[same] = common[same] + 1
        else:
            perm = np.argsort(key, kind="stable")
            key, byte = key[perm], byte[perm]
            same = np.flatnonzero((key[1:] == key[:-1]) & (byte[1:] != 256)) + 1
            bounds = np.stack([perm[same - 1] + 1, perm[same] + 1], axis=1).ravel()
            if len(bounds):
                step[same] = np.minimum.reduceat(common, bounds)[::2] + 1
            order = order[perm]
        common = step
        if c <= left:
            hit = common[:n] >= floor
            if hit.any():
                inside = hit | np.r_[hit[1:], False]
                rows, shared = order[inside], np.where(hit, common[:n], 0)[inside]
                for found, size in ((earlier, previous_factors(rows, shared)), (other, np.maximum(shared, np.r_[shared[1:], 0]))):
                    found[c, rows] = np.where(size >= need[c][rows], size, 0)
    return earlier, other


def group_numbers(rows: list[tuple]) -> list[int]:
    out: list[int] = []
    for k, r in enumerate(rows):
        out.append(0 if not k else out[-1] + (r[:2] != rows[k - 1][:2]))
    return out


def runs(length: np.ndarray) -> list[tuple[int, int]]:
    """The bytes that factors of these lengths cover (0: none), as maximal runs."""
    at = np.flatnonzero(length)
    if not len(at):
        return []
    ends = np.maximum.accumulate(at + length[at])
    cut = np.flatnonzero(at[1:] > ends[:-1])
    return list(zip(at[np.r_[0, cut + 1]].tolist(), ends[np.r_[cut, len(at) - 1]].tolist(), strict=True))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


SPANS = "array<struct<lo:int,hi:int>>"
PA_SPANS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def pairs(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"lo": lo, "hi": hi} for lo, hi in spans]


def repeated_spans(documents: DataFrame, least: int, keep_first: bool, words: int = 0) -> DataFrame:
    """(id, h, spans) of the documents with bytes to remove, written; h is the text's hash."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    docs = documents.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data"))
    left, right = least - ANCHOR, least

    def mark(b: pa.RecordBatch) -> pa.RecordBatch | None:
        own: list[tuple[int, dict]] = []
        for k, data in enumerate(b.column(2).to_pylist()):
            at, h = anchors(data, least, words)
            rows: dict[tuple[int, int], list] = {}
            for p, key in zip(at.tolist(), h.tolist(), strict=True):
                lo = max(0, p - left)
                rows.setdefault((key, xxh3_64_intdigest(data[lo : p + right], p - lo)), [p - lo, min(right, len(data) - p), []])[2].append(p)
            own.append((k, rows))
        flat = [(k, key, ctx, *v) for k, rows in own for (key, ctx), v in rows.items()]
        if not flat:
            return None
        k, key, ctx, l, r, pos = zip(*flat, strict=True)
        at = pa.array(np.cumsum([0, *map(len, pos)]).astype(np.int32))
        places = pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.array(p, np.int32) for p in pos])))
        take = pa.array(k)
        return pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(np.array(ctx, np.uint64).view(np.int64)), pa.array(l, pa.int32()), pa.array(r, pa.int32()), places], names=["doc_id", "th", "key", "ctx", "l", "r", "pos"])

    marks = materialize(map_text(docs, ["doc_id", "th", "data"], mark, f"doc_id {kind}, th bigint, key bigint, ctx bigint, l int, r int, pos array<int>"), "anchors")
    # Written before they are joined: a join of two plain exchanges is one that adaptive execution can split.
    keys = marks.groupBy("key").agg(F.sum(F.size("pos")).alias("n"), F.min("ctx").alias("low"), F.max("ctx").alias("high")).filter("n > 1").select("key", (F.col("low") != F.col("high")).alias("many"))
    keys = materialize(keys, "keys")
    shared = materialize(marks.join(keys, "key"), "shared")
    # One row for each different context; rep is its first copy.
    contexts = shared.groupBy("key", "ctx", "many", "l", "r").agg(F.sum(F.size("pos")).alias("n"), F.min(F.struct("doc_id", "th", F.array_min("pos").alias("p"))).alias("rep"))
    contexts = materialize(contexts, "contexts")
    whole = F.array(F.struct((-F.col("l")).alias("lo"), F.col("r").alias("hi")))
    none = F.array().cast(SPANS)
    alone = contexts.filter(~F.col("many")).select("key", "ctx", "rep", whole.alias("later"), (none if keep_first else whole).alias("first"))

    # Bytes of the different contexts of the other anchors.
    several = contexts.filter("many")
    wanted = materialize(several.groupBy(F.col("rep.doc_id").alias("id"), F.col("rep.th").alias("h")).agg(F.collect_list(F.struct("key", "ctx", F.col("rep.p").alias("p"), "l", "r", "n")).alias("own")), "wanted")
    holders = listed(wanted, "h")
    texts = docs if holders is None else docs.join(holders, F.col("th") == F.col("_listed"), "left_semi")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("h"))
    cut = F.substring("data", F.col("x.p") - F.col("x.l") + 1, F.col("x.l") + right)
    large = materialize(several.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("c")), "large")
    bodies = texts.join(wanted, same).select("id", "h", "data", F.explode("own").alias("x")).select("id", "h", F.col("x.key").alias("key"), F.col("x.ctx").alias("ctx"), F.col("x.p").alias("p"), F.col("x.l").alias("l"), F.col("x.r").alias("r"), F.col("x.n").alias("n"), cut.alias("body"))
    dealt = bodies.join(large.filter("c > 1"), "key", "left").withColumn("c", F.coalesce("c", F.lit(1)))
    own = F.pmod("ctx", F.col("c")).cast("int")
    tiles = F.when(F.col("c") == 1, F.array(F.lit(0).cast("bigint"))).when(F.col("c") > TILES, F.array(own.cast("bigint"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda x: F.least(x, own).cast("bigint") * F.col("c") + F.greatest(x, own)))
    dealt = dealt.withColumn("tile", F.explode(tiles)).select("key", "tile", "ctx", "id", "h", "p", "l", "r", "n", "body", "c")
    hot = large.agg(F.max("c")).first()[0] or 0
    if hot > TILES:
        dealt = materialize(dealt, "bodies")
    n_parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(batches):
        held: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and row[:3] == held[-1][:3]:
                    continue  # rows that repeat doc_id and text bring their contexts twice
                if size > BATCH and row[:2] != held[-1][:2]:
                    yield verdict(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[-1])
        if held:
            yield verdict(held)

    def verdict(rows: list[tuple]) -> pa.RecordBatch:
        rows = sorted(rows, key=lambda r: (r[0], r[1], r[3] is not None, r[3] if r[3] is not None else 0, r[4], r[5]))
        earlier, other = repeats([r[-1] for r in rows], least, group_numbers(rows), [r[6] for r in rows], words)
        lengths = np.ascontiguousarray((earlier if keep_first else other).T).astype(np.int64)
        later, first = [], []
        for (_, _, _, _, _, _, l, r, n, _), own in zip(rows, lengths, strict=True):
            every = [(-l, r)]
            later.append(pairs(every))
            first.append(pairs([(lo - left, hi - left) for lo, hi in runs(own)] if keep_first or n == 1 else every))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array(later, PA_SPANS), pa.array(first, PA_SPANS)], names=["key", "ctx", "later", "first"])

    tiled = dealt.filter(F.col("c") <= TILES).drop("c").repartition(n_parts, "key", "tile").sortWithinPartitions("key", "tile", "ctx")
    compared = tiled.mapInArrow(compare, f"key bigint, ctx bigint, later {SPANS}, first {SPANS}")
    if hot > TILES:
        compared = compared.unionByName(counted_strings(dealt.filter(F.col("c") > TILES), kind, least, words, keep_first))
    compared = compared.groupBy("key", "ctx").agg(F.first("later").alias("later"), F.flatten(F.collect_list("first")).alias("first"))
    result = materialize(alone.unionByName(compared.join(several.select("key", "ctx", "rep"), ["key", "ctx"]).select("key", "ctx", "rep", "later", "first")), "result")
    is_rep = F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("th") == F.col("rep.th"))
    places = F.flatten(F.transform("pos", lambda p: F.transform(F.when(is_rep & (p == F.col("rep.p")), F.col("first")).otherwise(F.col("later")), lambda s: F.struct((p + s["lo"]).alias("lo"), (p + s["hi"]).alias("hi")))))
    spans = shared.select("doc_id", "th", "key", "ctx", "pos").join(result, ["key", "ctx"]).select("doc_id", "th", places.alias("spans")).filter(F.size("spans") > 0)
    return materialize(spans.groupBy(F.col("doc_id").alias("id"), F.col("th").alias("h")).agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")


def counted_strings(bodies: DataFrame, kind: str, least: int, words: int, keep_first: bool) -> DataFrame:
    """What compare gives, for anchors with very many different contexts: each string over the anchor is a row, and
    equal ones are counted by hash. As many rows as places around the anchor, whatever the size of the group."""
    left = least - ANCHOR

    def spread(b: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = []
        for k, (l, body) in enumerate(zip(b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True)):
            ends = (np.arange(len(body)) + needs(np.frombuffer(body, np.uint8), least, words)).tolist()
            for s in range(l + 1):
                # And what lengthens a string up to where the next one ends.
                for e in range(ends[s], min(len(body) + 1, max(ends[s] + 1, ends[s + 1]))):
                    x = xxh3_128_intdigest(body[s:e], l - s)
                    rows.append((k, x >> 64, x & (1 << 64) - 1, s - l, e - l))
        if not rows:
            return None
        k, x, y, lo, hi = zip(*rows, strict=True)
        signed = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(k)) for c in range(5)), signed(x), signed(y), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["key", "ctx", "id", "h", "p", "x", "y", "lo", "hi"])

    strings = map_text(bodies.dropDuplicates(["key", "ctx"]), ["key", "ctx", "id", "h", "p", "l", "body"], spread, f"key bigint, ctx bigint, id {kind}, h bigint, p int, x bigint, y bigint, lo int, hi int")
    seen = materialize(strings.groupBy("key", "x", "y").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("id", "h", "p")).alias("head")).filter("m > 1"), "strings")
    hits = strings.join(seen, ["key", "x", "y"])
    if keep_first:
        hits = hits.filter(~F.struct("id", "h", "p").eqNullSafe(F.col("head")))
    hits = hits.groupBy("key", "ctx").agg(F.collect_set(F.struct("lo", "hi")).alias("found"))
    ends = bodies.select("key", "ctx", "n", F.array(F.struct((-F.col("l")).alias("lo"), F.col("r").alias("hi"))).alias("later")).dropDuplicates(["key", "ctx"])
    found = F.coalesce("found", F.array().cast(SPANS))
    return ends.join(hits, ["key", "ctx"], "left").select("key", "ctx", "later", (found if keep_first else F.when(F.col("n") > 1, F.col("later")).otherwise(found)).alias("first"))


def remove_repeats(documents: DataFrame, min_bytes: int = 400, keep_first: bool = True, carry: tuple[str, ...] = ("doc_id",), words: int = 0) -> DataFrame:
    """The carried columns, n_bytes, n_removed, n_spans, kept_sha256, and text: the remaining bytes as text, of every
    document. Strings have min_bytes bytes, or fewer where they hold that many words."""
    if min_bytes < 2 * ANCHOR or words and 2 * words - 1 < ANCHOR:
        raise ValueError(f"min_bytes must be at least {2 * ANCHOR}, and words 0 or at least {ANCHOR // 2 + 1}")
    spans = repeated_spans(documents, min_bytes, keep_first, words)
    docs = documents.select(*carry, *(["doc_id"] if "doc_id" not in carry else []), F.xxhash64("text").alias("_th"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("_data"))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            out = []
            for data, found in zip(b.column("_data").to_pylist(), b.column("spans").to_pylist(), strict=True):
                gone = merged([(s["lo"], s["hi"]) for s in found or ()])
                edges = [0, *(x for s in gone for x in s), len(data)]
                kept = b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)) if gone else data
                out.append((len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            n, removed, k, sha, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carry)], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(k, pa.int64()), pa.array(sha), pa.array(kept, pa.string())], names=[*carry, "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    def join(some: DataFrame) -> DataFrame:
        return some.join(spans, some["doc_id"].eqNullSafe(F.col("id")) & (F.col("_th") == F.col("h")), "left").select(*carry, "_data", "spans")

    holders = listed(spans, "h")
    if holders is None:
        joined = join(docs)
    else:  # only texts that lose something are shuffled
        rest = docs.join(holders, F.col("_th") == F.col("_listed"), "left_anti").select(*carry, "_data", F.lit(None).cast(SPANS).alias("spans"))
        joined = join(docs.join(holders, F.col("_th") == F.col("_listed"), "left_semi")).unionByName(rest)
    schema = documents.select(*carry).schema
    for name, kind in (("n_bytes", LongType()), ("n_removed", LongType()), ("n_spans", LongType()), ("kept_sha256", StringType()), ("text", StringType())):
        schema = schema.add(name, kind)
    return joined.mapInArrow(run, schema)


def rewrite(documents: DataFrame, min_bytes: int = 400, words: int = 0) -> DataFrame:
    """The documents without later copies of long strings (see remove_repeats); n_chars follows the text. Documents
    that lose all their words go, the others stay. Other columns are unchanged, whatever their names."""
    # They travel under names of their own, so that none clashes with those made here.
    others = {c: f"c{k}" for k, c in enumerate(documents.columns) if c not in ("doc_id", "text")}
    plain = documents.select("doc_id", "text", *[F.col(f"`{c}`").alias(x) for c, x in others.items()], F.col("text").isNull().alias("absent"))
    out = remove_repeats(plain, min_bytes, True, ("doc_id", *others.values(), "absent"), words).filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"doc_id": F.col("doc_id"), "text": F.when(~F.col("absent"), F.col("text"))} | {c: F.col(x) for c, x in others.items()}
    if "n_chars" in others:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(new["n_chars"]).cast(documents.schema["n_chars"].dataType)
    return out.select(*[new[c].alias(c) for c in documents.columns])


def brute_force(rows: list[tuple], least: int, keep_first: bool = False, words: int = 0) -> list[tuple]:
    """The same digest for small inputs: every string is looked up in all other texts."""
    data = [(i, (t or "").encode()) for i, t in rows]
    out = []
    count = Counter() if words else Counter(d[p : p + least] for _, d in data for p in range(len(d) - least + 1))
    seen: set[bytes] = set()
    for k, (i, d) in enumerate(data):
        before = b"\xff".join(x for _, x in data[:k])
        after = b"" if keep_first else b"\xff".join(x for _, x in data[k + 1 :])

        def repeated(p: int, e: int) -> bool:
            w = d[p:e]
            if not words:
                old = w in seen
                seen.add(w)
                return old if keep_first else count[w] > 1
            return w in before or w in after or d.find(w) < p or not keep_first and d.find(w, p + 1) >= 0

        length = np.zeros(len(d), np.int64)
        for p, e in enumerate((np.arange(len(d)) + needs(np.frombuffer(d, np.uint8), least, words)).tolist()):
            if e <= len(d) and repeated(p, e):
                while words and e < len(d) and repeated(p, e + 1):
                    e += 1
                length[p] = e - p
        gone = runs(length)
        edges = [0, *(x for s in gone for x in s), len(d)]
        kept = b"".join(d[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
        out.append((i, len(d), len(d) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
