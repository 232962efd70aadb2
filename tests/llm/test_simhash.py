import re

import numpy as np
import xxhash

from evidentia.llm import simhash
from evidentia.llm.graph import components
from tests.llm.fixtures import awkward, frame


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(values, radius=2):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def crowd(n, seed=3):
    """Fingerprints around a few centres, many within the radius of each other, by chains too."""
    rng = np.random.default_rng(seed)
    out = [int(x) for x in rng.integers(0, 2**63, 5, dtype=np.uint64)]
    while len(out) < n:
        x = out[rng.integers(len(out))]
        for b in rng.choice(64, rng.integers(1, 6), replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return sorted(set(out))


def test_fingerprints_and_components(spark, sf):
    rows = awkward() + [(1000 + r.doc_id, r.text, None, None, 0, None, None) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {r[1]: brute_fingerprint(r[1]) for r in rows}
    ids = [r[0] for r in rows]
    values = [want[r[1]] for r in rows]
    roots = brute_roots(values)
    low = {}
    for i, r in zip(ids, roots, strict=True):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    expect = sorted(((i, f"{v:016x}", low.get(r)) for i, v, r in zip(ids, values, roots, strict=True)), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == expect


def test_links_in_buckets_and_chunks(spark, monkeypatch):
    values = crowd(700)
    roots = brute_roots(values)
    expect = {}
    for v, r in zip(values, roots, strict=True):
        expect.setdefault(r, set()).add(v)
    expect = {frozenset(x) for x in expect.values() if len(x) > 1}
    fps = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    for chunk in (2048, 16):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        groups = {}
        for r in components(simhash.linked(fps)).collect():
            groups.setdefault(r.root, set()).add(int(np.int64(r.node).view(np.uint64)))
        assert {frozenset(x) for x in groups.values()} == expect


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_empty(spark):
    assert simhash.near_duplicates(frame(spark, [])).collect() == []
