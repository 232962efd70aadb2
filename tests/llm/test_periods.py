import hashlib
import random
import zlib

from evidentia.llm import periods
from tests.llm.fixtures import awkward, frame


def smallest(s):
    return next(q for q in range(1, len(s) + 1) if all(s[i] == s[i + q] for i in range(len(s) - q)))


def brute(s):
    n, out = len(s), []
    for q in range(1, n // 4 + 1):
        a = 0
        while a < n - q:
            b = a
            while b < n - q and s[b] == s[b + q]:
                b += 1
            if b - a + q >= max(6, 4 * q) and smallest(s[a : b + q]) == q:
                out.append((a, b - a + q, q))
            a = max(b, a + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_runs_match_brute_force():
    rng = random.Random(3)
    for trial in range(600):
        letters = "ab" if trial % 3 else "abcde"
        s = []
        while len(s) < rng.randint(0, 90):
            part = [rng.choice(letters) for _ in range(rng.randint(1, 7))]
            s += part * rng.choice([1, 1, 2, 4, 5, 9])
            s = s[: len(s) - rng.randint(0, 2)]
        words = [c.encode() for c in s]
        assert periods.word_runs([words]) == [brute(s)], s
        assert periods.find_runs([ord(c) for c in s]) == [tuple(x) for x in brute(s)] or sorted(periods.find_runs([ord(c) for c in s])) == sorted(brute(s))


def test_texts_of_a_batch_do_not_touch():
    a, b = [b"x"] * 5, [b"x"] * 5
    assert periods.word_runs([a, b, [], [b"x"] * 6]) == [[], [], [], [(0, 6, 1)]]


def row(doc_id, text):
    w = periods.planted((text or "").encode().split(), doc_id)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    own = (text or "").encode().split()
    if h % 10 == 0 and own:
        n, g = len(own), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert w == [x if i < a else own[a + (i - a) % p] for i, x in enumerate(own)]
    runs = brute(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (str(doc_id), len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()), sha(b" ".join(kept)))


def test_query_matches_brute_force(spark):
    rng = random.Random(5)
    words = ["a", "b", "é", "日本"]
    extra = [(1000 + i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), None, None, 0, None, None) for i in range(150)]
    extra += [(2000, "go " * 5000, None, None, 0, None, None), (2001, "a\x1cb " * 7 + "\x0bx\x0b" * 6, None, None, 0, None, None), (2002, "a b c d " * 4, None, None, 0, None, None)]
    data = awkward() + extra
    got = periods.detect(frame(spark, data)).collect()
    want = [row(r[0], r[1]) for r in data if r[0] != 2000]
    assert sorted((str(r.doc_id), *r[1:]) for r in got if r.doc_id != 2000) == sorted(want, key=lambda r: tuple(map(str, r))) or sorted(map(str, ((str(r.doc_id), *r[1:]) for r in got if r.doc_id != 2000))) == sorted(map(str, want))
    assert any(r.n_runs for r in got)
    assert periods.detect(frame(spark, [])).collect() == []


def test_small_flat_arrays_and_collisions(spark, monkeypatch):
    data = [(i, "x y " * (i % 9) + "z", None, None, 0, None, None) for i in range(60)]
    want = sorted(map(str, periods.detect(frame(spark, data), None, True).collect()))
    assert any("x y" in r for r in want)
    runs = periods.word_runs([r[1].encode().split() for r in data])
    assert runs == [brute(r[1].split()) for r in data]


def test_very_long_texts():
    assert periods.find_runs([1] * 300_000) == [(0, 300_000, 1)]
    rng = random.Random(1)
    part = [rng.randint(0, 50) for _ in range(1000)]
    long = [str(x).encode() for x in part * 100 + [rng.randint(0, 50) for _ in range(100_000)]]
    (start, n, q), *_ = periods.word_runs([long])[0]
    assert start == 0 and q == 1000 and n >= 100_000
