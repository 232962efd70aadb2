import random
from collections import Counter

import numpy as np
import pytest

from evidentia.llm import common
from evidentia.llm import substrings as sub
from tests.llm.fixtures import awkward, frame

COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def corpus(seed, least):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    say = lambda n: " ".join(word() for _ in range(n))
    passages = [say(rng.randint(30, 160)) for _ in range(6)]
    texts = ["ab" * 400, "x" * 900, "In. " * 300, "In. " * 150 + say(50)]
    for _ in range(60):
        parts = [say(rng.randint(0, 60)) for _ in range(rng.randint(1, 3))]
        for k in range(len(parts)):
            if rng.random() < 0.6:
                p = rng.choice(passages)
                parts[k] += p[rng.randint(0, 30) : len(p) - rng.randint(0, 30)]
        texts.append(" ".join(parts))
    texts += [texts[9], texts[9], texts[11][:-1] + "é", passages[0][:least], passages[0][: least - 1]]
    return [(100 + i, t, None, None, 0, None, None) for i, t in enumerate(texts)]


@pytest.mark.parametrize(
    ("least", "keep_first", "chunk", "tiles", "most", "words"),
    [(400, False, 3000, 8, 10**6, 0), (150, False, 3000, 8, 10**6, 0), (150, True, 3000, 8, 0, 0), (150, False, 2, 99, 0, 0), (150, True, 2, 99, 10**6, 0), (150, False, 2, 1, 10**6, 0), (150, True, 2, 1, 10**6, 0), (300, True, 3000, 8, 10**6, 40), (300, False, 2, 1, 10**6, 40)],
)
def test_matches_brute_force(spark, monkeypatch, least, keep_first, chunk, tiles, most, words):
    """Whole contexts, chunks and counted strings, with and without listed texts, of bytes and of words."""
    monkeypatch.setattr(sub, "CHUNK", chunk)
    monkeypatch.setattr(sub, "TILES", tiles)
    monkeypatch.setattr(common, "LISTED", most)
    rows = [r for r in awkward() if not (keep_first and r[0] == 7)] + corpus(least, least)
    rows = rows[::3] if words else rows
    want = sub.brute_force([(r[0], r[1]) for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))], least, keep_first, words)
    got = [tuple(r[c] for c in COLUMNS) for r in sub.remove_repeats(frame(spark, rows), least, keep_first, words=words).collect()]
    assert Counter(got) == Counter(want)
    assert sum(r[2] > 0 for r in want) > (2 if words else 10)


def test_longest_previous_factor():
    rng = random.Random(5)
    for _ in range(40):
        data = bytes(rng.choice(b"ab" if rng.random() < 0.7 else b"abc") for _ in range(rng.randint(0, 40)))
        brute = [max((k for k in range(len(data) - i + 1) for j in range(i) if data[j : j + k] == data[i : i + k]), default=0) for i in range(len(data))]
        got = sub.longest_previous_factor(data)
        assert got.tolist() == brute


def test_repeats_of_aligned_contexts(monkeypatch):
    """Against every pair: contexts of one group, cut off at either end at random."""
    monkeypatch.setattr(sub, "ANCHOR", 2)
    rng = random.Random(6)
    least = 6
    for _ in range(60):
        groups = sorted(rng.randint(0, 2) for _ in range(rng.randint(1, 9)))
        centres = [rng.randint(0, least - 2) for _ in groups]
        bodies = [bytes(rng.choice(b"aab") for _ in range(c)) + b"zz" + bytes(rng.choice(b"aab") for _ in range(rng.randint(0, least - 2))) for c in centres]
        earlier, other = sub.repeats(bodies, least, groups, centres)
        for c in range(least - 2 + 1):
            cut = [(g, b[c - least + 2 + m : c + 2 + m]) if c - least + 2 + m >= 0 and len(b) >= c + 2 + m else None for g, b, m in zip(groups, bodies, centres, strict=True)]
            assert (earlier[c] > 0).tolist() == [x is not None and x in cut[:k] for k, x in enumerate(cut)]
            assert (other[c] > 0).tolist() == [x is not None and cut.count(x) > 1 for x in cut]


def test_previous_factors():
    """Against every pair of suffixes of a group of strings."""
    rng = random.Random(8)
    for _ in range(200):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 12))]
        order = sorted(range(len(texts)), key=lambda i: (texts[i], i))
        prefix = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        common = np.array([0, *(prefix(texts[i], texts[j]) for i, j in zip(order[:-1], order[1:], strict=True))])
        got = sub.previous_factors(np.array(order), common)
        assert got.tolist() == [max((prefix(texts[i], texts[j]) for j in range(i)), default=0) for i in order]


def test_a_very_long_text(spark):
    """Megabytes of one text, with one passage at both ends, beside texts that share it."""
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage, rest = say(80), say(300_000)
    rows = [(1, f"{passage} {rest} {passage}", None, None, 0, None, None), (2, f"x {passage} y", None, None, 0, None, None), (3, say(100), None, None, 0, None, None)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in sub.remove_repeats(frame(spark, rows), 400, False).collect()}
    assert got[3] == (0, 0) and got[1][1] == 2 and got[1][0] >= 2 * len(passage) and got[2][0] >= len(passage)


def test_segments_find_the_same_anchors(monkeypatch):
    data = "".join(random.Random(1).choice("abcdef ") for _ in range(30_000)).encode()
    at, h = sub.anchors(data, 400)
    monkeypatch.setattr(sub, "SEGMENT", 2000)
    at2, h2 = sub.anchors(data, 400)
    assert np.array_equal(at, at2) and np.array_equal(h, h2)
    assert np.diff(at).max() <= 400


def test_empty(spark):
    assert sub.remove_repeats(frame(spark, [])).collect() == []
