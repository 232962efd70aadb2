"""Names by a gazetteer and by cues, and the choice among overlapping finds.

A gazetteer whose measured size is bounded becomes an Aho-Corasick automaton that every task reads once; a greater one
is joined: word sequences of the texts meet its names as rows. Both give the same finds."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Role words before a name, words after them that are no names, words before `market` that name no
#: platform, and the platform words with their types.
ROLES = "vendor seller buyer customer admin administrator moderator mod operator staff reseller owner curator broker supplier affiliate".split()
NO_NAMES = frozenset("""a an the is are was were be been being will would shall should may might must can could do does did has have had not no and or but if then than so as of to for from by in on at with without
into this that these those it its they them who what when where why how all any some shipped ship sent send paid pay buy sell listed posts post writes write said says here there now today yesterday new old first last
next previous please thanks thank""".split())
NO_PLATFORMS = frozenset("""the a an on in at to for from by black grey gray underground open free global local new old second secret hidden dark job stock capital property farmers real world night wide source media social
online digital virtual whole""".split())
PLATFORMS = {"marketplace": "marketplace", "market": "marketplace", "forum": "forum", "board": "forum", "channel": "channel", "community": "forum"}
#: Confidences of the finds.
BY_GRAMMAR, BY_NAME, BY_ROLE = 0.70, 0.90, 0.65

WORD = re.compile(r"[A-Za-z][A-Za-z0-9_-]*")
GRAMMAR = re.compile(rf"(?<![A-Za-z0-9_])([A-Za-z][A-Za-z0-9_-]{{1,40}})\s+({'|'.join(sorted(PLATFORMS, key=len, reverse=True))})(?![A-Za-z0-9_])", re.I)
ROLE = re.compile(rf"(?<![A-Za-z0-9_])({'|'.join(sorted(ROLES, key=len, reverse=True))})(?![A-Za-z0-9_])\s*[:#@]?\s+([A-Za-z0-9_][A-Za-z0-9_.-]{{1,31}})(?![A-Za-z0-9_-])", re.I)
#: A gazetteer of at most so many characters is broadcast (an automaton takes some 100 bytes for each).
MOST_CHARACTERS = 2_000_000
SPANS = "type string, start long, end long, value string, confidence double, cue string"

Span = tuple[str, int, int, str, float, str]


def by_grammar(text: str) -> list[Span]:
    """`NAME market` and the like."""
    return [(PLATFORMS[m[2].lower()], *m.span(), f"{m[1].lower()} {m[2].lower()}", BY_GRAMMAR, "grammar") for m in GRAMMAR.finditer(text) if m[1].lower() not in NO_PLATFORMS]


def by_role(text: str) -> list[Span]:
    """The name behind a role word; the span is the name's."""
    out = []
    for m in ROLE.finditer(text):
        name = m[2].rstrip(".-")
        if len(name) >= 2 and name.lower() not in NO_NAMES:
            out.append(("alias", m.start(2), m.end(2), name.lower(), BY_ROLE, m[1].lower()))
    return out


def automaton(names: dict[str, str]) -> ahocorasick.Automaton:
    """Of lower-case names and their types."""
    a = ahocorasick.Automaton()
    for name, kind in names.items():
        a.add_word(name, (name, kind))
    a.make_automaton()
    return a


def by_name(text: str, a: ahocorasick.Automaton) -> list[Span]:
    """Names of the gazetteer that stand as whole words, in any case; ASCII letters are folded, so places agree."""
    if not len(a):
        return []
    low = text.translate(FOLD)
    inner = lambda i: 0 <= i < len(low) and (low[i].isascii() and (low[i].isalnum() or low[i] in "_-"))
    return [(kind, end + 1 - len(name), end + 1, name, BY_NAME, "gazetteer") for end, (name, kind) in a.iter(low) if not inner(end - len(name)) and not inner(end + 1)]


FOLD = {c: c + 32 for c in range(65, 91)}


def chosen(spans: Sequence[Span]) -> list[Span]:
    """Of overlapping spans the set without overlaps of the greatest total confidence times length; of equal sets the one
    found first from the left. Sorting and one binary search a span."""
    order = sorted(set(spans), key=lambda s: (s[2], s[1], -s[4], s[0], s[3], s[5]))
    ends = [s[2] for s in order]
    best, take = [0.0], []
    for k, s in enumerate(order):
        before = bisect.bisect_right(ends, s[1], 0, k)
        with_it = best[before] + s[4] * (s[2] - s[1])
        take.append((with_it > best[k], before))
        best.append(max(best[k], with_it))
    out, k = [], len(order)
    while k:
        use, before = take[k - 1]
        if use:
            out.append(order[k - 1])
        k = before if use else k - 1
    return out[::-1]


def clean_gazetteer(gazetteer: DataFrame) -> DataFrame:
    """(name, kind): names folded and trimmed, one kind each (the smallest); names that begin or end beyond a word are
    left out, as they could not stand as whole words."""
    name = F.translate(F.trim("name"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return gazetteer.select(name.alias("name"), "kind").filter(F.col("name").rlike(r"^[a-z]([a-z0-9_-]|.*[a-z0-9_-])?$")).groupBy("name").agg(F.min("kind").alias("kind"))


def recognise(documents: DataFrame, gazetteer: DataFrame, resolve: bool = True, most: int = MOST_CHARACTERS) -> DataFrame:
    """doc_id, type, start, end, value, confidence, cue of every name in every whole text: platform names by grammar and
    gazetteer, aliases by role. gazetteer: (name, kind), names of one or more words. resolve: of overlapping finds only
    the best set stays. A null text has none."""
    g = clean_gazetteer(gazetteer)
    size = g.agg(F.sum(F.length("name")).alias("n"), F.max(F.size(F.split("name", r"[^a-z0-9_-]+"))).alias("words")).first()
    kind = documents.schema["doc_id"].dataType.simpleString()
    if (size["n"] or 0) <= most:
        names = {r["name"]: r["kind"] for r in g.collect()}  # as many characters as `most` at most

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            a = automaton(names)
            for b in batches:
                rows = []
                for i, t in zip(b["doc_id"], b["text"], strict=True):
                    found = by_grammar(t) + by_role(t) + by_name(t, a)
                    rows += [(i, *s) for s in (chosen(found) if resolve else sorted(set(found), key=lambda s: (s[1], s[2], s[0])))]
                yield pd.DataFrame(rows, columns=["doc_id", *[c.split()[0] for c in SPANS.split(", ")]])

        return documents.select("doc_id", "text").filter("text is not null").mapInPandas(run, f"doc_id {kind}, {SPANS}")
    return _joined(documents, g, int(size["words"]), resolve, kind)


def _joined(documents: DataFrame, g: DataFrame, words: int, resolve: bool, kind: str) -> DataFrame:
    """The same for a gazetteer that is too large for every task: its names' first words are met as rows."""

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                low = t.translate(FOLD)
                at = [m.span() for m in re.finditer(r"[a-z0-9_-]+", low)]
                rows += [(i, low[at[k][0] : at[e][1]], at[k][0], at[e][1]) for k in range(len(at)) for e in range(k, min(len(at), k + words)) if low[at[k][0]].isalpha()]
            yield pd.DataFrame(rows, columns=["doc_id", "name", "start", "end"])

    def cued(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, *s) for i, t in zip(b["doc_id"], b["text"], strict=True) for s in by_grammar(t) + by_role(t)], columns=["doc_id", *[c.split()[0] for c in SPANS.split(", ")]])

    d = documents.select("doc_id", "text").filter("text is not null")
    met = d.mapInPandas(starts, f"doc_id {kind}, name string, start long, end long").join(g, "name")
    found = met.select("doc_id", F.col("kind").alias("type"), "start", "end", F.col("name").alias("value"), F.lit(BY_NAME).alias("confidence"), F.lit("gazetteer").alias("cue")).unionByName(d.mapInPandas(cued, f"doc_id {kind}, {SPANS}")).distinct()
    if not resolve:
        return found

    def best(key, b: pd.DataFrame) -> pd.DataFrame:
        spans = [tuple(r) for r in b[["type", "start", "end", "value", "confidence", "cue"]].itertuples(index=False)]
        return pd.DataFrame([(key[0], *s) for s in chosen(spans)], columns=["doc_id", *[c.split()[0] for c in SPANS.split(", ")]])

    return found.groupBy("doc_id").applyInPandas(best, f"doc_id {kind}, {SPANS}")
