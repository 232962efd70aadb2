import re

from evidentia.llm import license as lic
from tests.llm.fixtures import awkward, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(text):
    w = WORD.findall((text or "").translate(LOWER))
    at = [(i, label) for p, label in lic.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def brute_labels(text, t=0.8):
    """Every block and every window with every template; of an anchor's finds at one place the greatest overlap."""
    words = WORD.findall((text or "").translate(LOWER))
    finds = {}
    for label, ts in lic.TEMPLATES.items():
        for notice, must in ts:
            own, must = set(notice.split()), must.split()
            good = lambda b, own=own, must=must: set(must) <= b and len(b & own) >= t * len(own) - 1e-9
            for k, block in enumerate(re.split(r"\n|(?<=[.!?;])[ \t]+", text or "")):
                b = set(WORD.findall(block.translate(LOWER)))
                if good(b):
                    finds.setdefault(("block", k, must[0]), []).append((len(b & own), label))
            n = len(notice.split())
            for i in range(len(words)):
                w = words[i : i + n]
                if must[0] in w and good(set(w)):
                    for j, x in enumerate(w):
                        if x == must[0]:
                            finds.setdefault(("word", i + j, must[0]), []).append((len(set(w) & own), label))
    return {label for found in finds.values() for o, label in found if o == max(found)[0]}


def test_matches_brute_force(spark, sf):
    extra = [(100 + i, t, None, None, 0, None, None) for i, t in enumerate(["Licensed under CC BY-NC 4.0.", "x\nReleased under the MIT License.\ny", "released UNDER the  mit licenses", "All\nrights   RESERVED all rights reserved", "general general public license", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY\n# 4.0 and CC BY-SA 4.0", "Licensed under the GNU Lesser General\nPublic License", "Released under the Company License", "you can redistribute it and/or modify it under the terms of the GNU General Public License. x " * 3, "word " * 30000 + "released under the mit license"])]
    real = [(1000 + r.doc_id, r.text, r.lang, r.source, r.n_chars, None, None) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = awkward() + extra + real
    got = lic.scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {}
    for r in rows:
        base = brute(r[1])
        want.setdefault((r[0], *base, ",".join(sorted({x for x in base[-1].split(",") if x} | brute_labels(r[1])))), 0)
        want[(r[0], *base, ",".join(sorted({x for x in base[-1].split(",") if x} | brute_labels(r[1])))) ] += 1
    have = {}
    for r in got:
        k = (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels)
        have[k] = have.get(k, 0) + 1
        assert 0 <= r.score <= 1
    assert have == want


def test_each_notice_gets_its_own_label(spark):
    notices = {
        "Released under the MIT License.": "mit", "Released under the BSD License.": "bsd", "Licensed under CC BY 4.0.": "cc-by,cc-by-4.0", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0", "Licensed under CC BY-SA 4.0.": "cc-by,cc-by-sa-4.0",
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0", "Licensed under the GNU Lesser General Public License.": "gpl,lgpl", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the Company License.": "",
        "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc-4.0", "Licensed under a Creative Commons Attribution 4.0 International License.": "cc-by-4.0", "Licensed under the GNU Affero General Public License version 3": "agpl-3.0,gpl",
    }
    got = lic.scan(frame(spark, [(i, t, None, None, 0, None, None) for i, t in enumerate(notices)])).collect()
    assert {list(notices)[r.doc_id]: r.labels for r in got} == notices


def test_empty(spark):
    assert lic.scan(frame(spark, [])).collect() == []
