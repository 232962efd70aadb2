import random
import re

import corpus_pipeline
from tests.llm.fixtures import frame


def brute_texts(rows):
    """Every string of 51 words or 300 bytes is looked up in the earlier documents, and lengthened."""
    out, before = {}, ""
    for i, text in rows:
        gone = [False] * len(text)
        for p in range(len(text)):
            words = list(re.finditer(r"[^ \t\n\r\x0b\x0c]+", text[p:]))
            e = p + min(300, words[50].start() + 1 if len(words) > 50 else 300)
            if e <= len(text) and text[p:e] in before:
                while e < len(text) and text[p : e + 1] in before:
                    e += 1
                gone[p:e] = [True] * (e - p)
        kept = "".join(x for x, g in zip(text, gone, strict=True) if not g)
        if kept == text or kept.split():
            out[i] = kept
        before += "\0" + text
    return out


def test_passages_of_short_words(spark, sf):
    """51 short words under 300 bytes that stand in many documents go from all but the first; 30 words stay."""
    rng = random.Random(9)
    say = lambda n, k: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(k)) for _ in range(n))
    passages = [say(51, 2), say(51, 3), say(51, 4), say(60, 3), say(30, 6)]
    assert [len(p) for p in passages] == [152, 203, 254, 239, 209]
    rows = [(i, f"{say(40, 5)} {passages[i % 5]} {say(40, 5)}", None, None, 0, None, None) for i in range(40)]
    got = {r.doc_id: r.text for r in corpus_pipeline.remove_repeats(spark, frame(spark, rows), sf).collect()}
    assert got == brute_texts([r[:2] for r in rows])
    for k, p in enumerate(passages):
        assert sorted(i for i, t in got.items() if p in t) == ([k] if k < 4 else list(range(4, 40, 5)))
