import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from evidentia.llm import manifest
from tests.llm.fixtures import awkward, frame


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(r, extra=0):
    return h(*map(value, (r[0], r[3], r[2], r[4] + extra if r[4] is not None else None, r[1])))


def grow(nodes, arity):
    """The levels of one tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def path(levels, i, arity):
    out = []
    for level in levels[:-1]:
        a = i - i % arity
        run = level[a : a + arity]
        out.append(("".join(run[: i - a]), "".join(run[i - a + 1 :])))
        i //= arity
    return out


def brute(rows, arity=2):
    groups = {}
    for r in rows:
        groups.setdefault("" if r[2] is None else "=" + r[2], []).append(r)
    keys = sorted(groups, key=lambda k: k.encode())
    trees = {}
    for k in keys:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[k] = grow([leaf(r) for r in groups[k]], arity)
    top = grow([trees[k][-1][0] for k in keys], arity)
    out = []
    for j, k in enumerate(keys):
        for i, r in enumerate(groups[k]):
            steps = path(trees[k], i, arity) + path(top, j, arity)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(r, 1 if bad else 0)
            for a, b in steps:
                node = h(a, node, b)
            out.append((str(r[0]), leaf(r), trees[k][-1][0], top[-1][0], h(*[x for s in steps for x in s]), node, node == top[-1][0]))
    return sorted(out)


def rows(n, langs, seed=1):
    rng = random.Random(seed)
    return [(rng.randint(0, 3 * n), f"text é {i}", rng.choice(langs), "s", rng.choice([None, i]), None, None) for i in range(n)]


@pytest.mark.parametrize(("data", "arity", "depth"), [(awkward(), 2, 10), (rows(70, ["a", "b", None, "é", "z"]), 2, 2), (rows(70, ["a"]), 2, 3), (rows(41, ["a", None]), 3, 2), (rows(64, ["a", "b"]), 2, 3), (awkward()[:1], 2, 10), (rows(30, list("abcdefghi")), 2, 1), ([awkward()[7]] * 9, 2, 2)])
def test_matches_brute_force(spark, data, arity, depth):
    got = sorted((str(r.doc_id), *r[1:]) for r in manifest.verify(frame(spark, data), arity, depth).collect())
    assert got == brute(data, arity)


def test_empty(spark):
    assert manifest.verify(frame(spark, [])).collect() == []


def test_one_shuffle_a_block(spark):
    """All levels of a block follow one exchange, and one sort."""
    nodes = manifest.positions(frame(spark, rows(50, ["a", "b"])).select(F.col("lang").alias("group"), "doc_id", F.sha2("text", 256).alias("digest")), ["doc_id"])
    plan = manifest.climb(nodes, 2, 6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Window") == 6 and plan.count("Sort [") == 1
