import random
import re

import corpus_pipeline
from evidentia.llm import similar
from evidentia.llm.common import table
from tests.llm.fixtures import awkward, frame


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_groups(texts, least=0.8):
    sets = [brute_set(t) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (min(len(a), len(b)) >= least * max(len(a), len(b)) - 1e-9 and len(a & b) >= least * len(a | b) - 1e-9):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def edited(rng, words, edits):
    out = list(words)
    for k in rng.sample(range(len(out)), edits):
        out[k] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def near_copies(first):
    """Copies of several texts with 0 to 12 edited words, some of them around the similarity."""
    rng = random.Random(5)
    rows = []
    for _ in range(6):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randint(60, 400))]
        for k in range(12):
            rows.append(edited(rng, base, k))
    return [(first + i, t, None, None, len(t), None, None) for i, t in enumerate(rows)]


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    return sorted((order[k][0] for k in set(brute_groups([r[1] for r in order]))), key=str)


def test_stage_against_brute_force(spark, sf, monkeypatch):
    real = [(5000 + r.doc_id, r.text, None, None, 0, None, None) for r in table(spark, sf, "documents").collect()]
    rows = awkward() + near_copies(1000) + real
    for most in (200_000, 0):
        monkeypatch.setattr(similar, "MOST", most)
        got = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), sf)
        assert sorted((r.doc_id for r in got.collect()), key=str) == expected(rows)


def test_copy_with_word_edits_goes(spark, sf):
    """Four edits in 300 words: similar by 0.8 and more, but many SimHash bits apart."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    rows = [(i, edited(rng, base, 4 if i else 0), None, None, 0, None, None) for i in range(8)]
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), sf).collect()} == {r for r in expected(rows)} == {0}
    assert corpus_pipeline.drop_near_duplicates(spark, frame(spark, []), sf).collect() == []
