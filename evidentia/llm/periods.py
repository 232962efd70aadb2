"""Periodic runs of words: Main-Lorentz divide and conquer on interned word ids.

A run is a stretch of consecutive words with smallest period q and at least max(6, 4q) words that no neighbouring word
extends. Each node of the recursion halves its stretch; Z-functions of the halves tell, for every period, how far
equal words reach to both sides of the midpoint, so all runs that touch the midpoint come from linear work. A find
that reaches over the node's edge belongs to a node above, which has it whole; equal intervals keep their smallest
period.

The recursion runs on what can lie in a run at all: of a run with at least four periods each three-word sequence
occurs at least three times, so stretches of words without such sequences are left out first, by counting in flat
arrays of many texts (a collision of the counting table only keeps more). This loses no run.

Defined results: a null or empty text has no words and no runs; rows that repeat give equal results; ties of the
longest run go to the smallest start, then period; a text of any length is read whole; an empty table gives an empty
result; a null doc_id takes part like any other; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evidentia.llm.common import map_text

LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Bytes of text whose words lie in one flat array, and slots of the counting table.
FLAT_BYTES, SLOTS = 1 << 20, 1 << 21


def z_function(s: list[int]) -> list[int]:
    """z[i]: how many words from i on equal those from the beginning; z[0] is 0."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def find_runs(s: list[int], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in s, by start and then period. periods: at least 4."""
    n = len(s)
    found: dict[tuple[int, int], int] = {}

    def keep(start: int, end: int, q: int, lo: int, hi: int) -> None:
        if end - start < max(least, periods * q) or (start == lo and lo and s[lo - 1] == s[lo - 1 + q]) or (end == hi and hi < n and s[hi] == s[hi - q]):
            return
        if found.get((start, end), n) > q:
            found[start, end] = q

    nodes = [(0, n)]
    while nodes:
        lo, hi = nodes.pop()
        if hi - lo < least:
            continue
        mid = (lo + hi) // 2
        u, v = s[lo:mid], s[mid:hi]
        # At least two periods lie on one side of the midpoint, so periods up to half of that side are enough.
        most_v, most_u = len(v) // 2, len(u) // 2
        forth, back = z_function(v), z_function(u[::-1] + [-1] + (u + v[:most_v])[::-1])
        for q in range(1, most_v + 1):
            keep(mid - back[len(u) + 1 + most_v - q], mid + q + forth[q], q, lo, hi)
        back, forth = z_function(u[::-1]), z_function(v + [-1] + u[len(u) - most_u :] + v)
        for q in range(1, most_u + 1):
            keep(mid - q - back[q], mid + forth[len(v) + 1 + most_u - q], q, lo, hi)
        nodes += [(lo, mid), (mid, hi)]
    return sorted((a, b - a, q) for (a, b), q in found.items())


def _edges(places: np.ndarray) -> np.ndarray:
    """Where neighbouring places begin and end as stretches, as indices into places."""
    return np.concatenate([[0], np.flatnonzero(np.diff(places) > 1) + 1, [len(places)]]) if len(places) else np.zeros(1, np.int64)


def _stretches(ids: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of the words in which runs can lie; no stretch reaches over two groups."""
    keep = np.flatnonzero(group[:-2] == group[2:])
    three = ids[:-2] * np.uint64(0x9E3779B97F4A7C15) + ids[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + ids[2:] * np.uint64(0x165667B19E3779F9)
    within = group[keep].astype(np.uint64)
    while len(keep):
        slot = (((three[keep] + within) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(43)).astype(np.int64)
        often = keep[np.bincount(slot, minlength=SLOTS)[slot] >= LEAST_PERIODS - 1]
        # A run of six words has four three-word sequences in a row.
        sizes = np.diff(_edges(often))
        often = often[np.repeat(sizes >= LEAST_WORDS - 2, sizes)]
        edges = _edges(often)
        if len(often) == len(keep):
            return [(int(often[a]), int(often[b - 1]) + 3) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        # Counted anew within each stretch that is left.
        keep, within = often, np.repeat(np.arange(len(edges) - 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F), np.diff(edges))
    return []


def word_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text's words."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    flat = [w for t in texts for w in t]
    if len(flat) < LEAST_WORDS:
        return out
    ids = pa.array(flat, pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.uint64)
    sizes = np.array([len(t) for t in texts])
    group, first = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    for a, b in _stretches(ids, group):
        t = int(group[a])
        out[t] += [(a - int(first[t]) + s, n, q) for s, n, q in find_runs(ids[a:b].tolist())]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The contract's periodic ending of every tenth document: its words from a place on repeat the ones there."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * ((n - a) // p + 1))[: n - a]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that lie in a run behind its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        depth[s + q] += 1
        depth[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


SCHEMA = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def _row(words: list[bytes], runs: list[tuple[int, int, int]], text: bool) -> tuple:
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    kept = b" ".join(collapse(words, runs))
    more = (kept.decode(), [{"start": a, "length": b, "period": c} for a, b, c in runs]) if text else ()
    return len(runs), s, n, q, 1000 * n // q if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), *more


def detect(documents: DataFrame, change=planted, with_text: bool = False) -> DataFrame:
    """Per document: the number of its runs, the longest one, and digests of the runs and of the text without repeats.

    change(words, doc_id): what is done to the words first (the contract's planted endings; None: nothing). with_text
    adds collapsed, the text without repeats, and runs, an array of (start, length, period)."""
    schema = SCHEMA + (", collapsed string, runs array<struct<start:bigint,length:bigint,period:bigint>>" if with_text else "")
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + ([pa.string(), pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))] if with_text else [])
    names = [c.split()[0] for c in SCHEMA.split(", ")[1:]] + (["collapsed", "runs"] if with_text else [])

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        done: list[tuple] = []
        part: list[list[bytes]] = []
        size = 0
        texts = b.column("text").cast(pa.binary())
        for i, doc_id in enumerate(b.column("doc_id").to_pylist()):
            raw = texts[i].as_py() or b""
            words = raw.split()  # on space and the controls 09-0D, as bytes split
            part.append(change(words, doc_id) if change else words)
            size += len(raw)
            if size >= FLAT_BYTES or i + 1 == b.num_rows:
                done += [_row(w, r, with_text) for w, r in zip(part, word_runs(part), strict=True)]
                part, size = [], 0
        return pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *[pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)]], names=["doc_id", *names])

    return map_text(documents, ["doc_id", "text"], rows, schema)
