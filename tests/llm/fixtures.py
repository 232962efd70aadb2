"""Awkward documents that every operator's tests share."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, label string"


def awkward() -> list[tuple]:
    """Nulls, empty and white texts, repeated rows, ties, a long text, other scripts, clashing extra columns."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = say(120)
    texts = [None, "", " \n\t ", "one", "One two", "All rights reserved.", "cc by cc-by CC BY", base, base, base + " tail", "x " + base, say(3000), "日本語 テキスト é à ü", "a\x1cb\x0bc\x0cd", "the same line\nthe same line\n\nother", "% $ # * & | < >", say(40) + "\n" + say(40)]
    rows = [(i, t, "en" if i % 3 else None, "s", len(t) if t is not None else None, "extra", "extra") for i, t in enumerate(texts)]
    return rows + [rows[7], (None, "no id " + say(30), None, None, None, None, None), (None, None, None, None, None, None, None)]


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int, text string")
