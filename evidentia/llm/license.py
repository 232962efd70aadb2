"""License scans: an exact set-similarity join of text blocks with license templates, in native expressions.

Template tokens are ordered by their document frequency over the whole corpus, rarest first. A block that holds at
least the threshold's share of a template's tokens must hold one of its prefix tokens (|T| - ceil(t|T|) + 1 rarest),
so blocks are joined with templates on prefix tokens only. Length (|B| >= ceil(t|T|)) and positional bounds (what
can still match behind the two positions) prune before the exact overlap is counted.

Licenses' notices differ in a word or two, so a template also has words that must occur (`mit`, `nc`, `lesser`), and
the first of them is its anchor: of templates with the same anchor that meet the threshold in one block, or around
one place of the anchor, only those with the greatest overlap count. A plain CC BY notice is not CC BY-NC, nor the
other way round.

Defined results: a null text counts as empty (no words, no labels, score 0); a text block is a line, a sentence of
one, or as many words of the whole text as the template has, so that wrapped notices count; templates of equal overlap
at one anchor all count (ties); texts of any length are scanned whole; rows that repeat get equal results; extra columns,
whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import ALNUM_WORD

#: Words of a text whose capitals are still there.
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed values of the contract: phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices of well-known licenses and the words of them that must occur, the anchor first; the labels follow the
#: licenses' usual short names.
TEMPLATES = {
    "agpl-3.0": [("licensed under the gnu affero general public license version 3", "general affero")],
    "apache-2.0": [("licensed under the apache license version 2 0", "apache license"), ("this file is licensed to you under the apache license version 2 0", "apache license")],
    "bsd": [("released under the bsd license", "bsd license"), ("redistribution and use in source and binary forms with or without modification are permitted", "redistribution")],
    "cc-by-4.0": [("licensed under cc by 4 0", "cc by"), ("licensed under a creative commons attribution 4 0 international license", "creative commons attribution")],
    "cc-by-nc-4.0": [("licensed under cc by nc 4 0", "cc by nc"), ("licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons noncommercial")],
    "cc-by-sa-4.0": [("licensed under cc by sa 4 0", "cc by sa"), ("licensed under a creative commons attribution sharealike 4 0 international license", "creative commons sharealike")],
    "gpl-3.0": [("this work is licensed under the gnu general public license version 3", "general public"), ("you can redistribute it and or modify it under the terms of the gnu general public license", "general public")],
    "lgpl": [("licensed under the gnu lesser general public license", "general lesser"), ("you can redistribute it and or modify it under the terms of the gnu lesser general public license", "general lesser")],
    "mit": [("released under the mit license", "mit license"), ("permission is hereby granted free of charge to any person obtaining a copy of this software", "permission granted")],
    "mpl-2.0": [("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public")],
}


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def words_of(c: Column) -> Column:
    """Words of a text, A-Z lower-cased."""
    return F.filter(F.split(ascii_lower(c), BREAK), lambda x: x != "")


def has_any(text: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out |= F.contains(text, F.lit(n))
    return out


def document_frequency(documents: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How many documents hold each of the vocabulary's tokens; the result is as long as the vocabulary."""
    own = F.array_intersect(F.split(F.lower("text"), BREAK), F.array(*map(F.lit, vocabulary)))
    rows = documents.filter(F.col("text").isNotNull()).select(F.explode(own).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["token"]: r["n"] for r in rows}


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a one-element array's lambda binds it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def template_matches(documents: DataFrame, threshold: float = 0.8, templates: dict[str, list[tuple[str, str]]] = TEMPLATES) -> DataFrame:
    """(doc_id, text_hash, label, containment) of each document and the template labels that count in it."""
    spark = documents.sparkSession
    sets = [(label, i, len(re.findall(ALNUM_WORD, t)), sorted(set(re.findall(ALNUM_WORD, t))), must.split()) for label, ts in templates.items() for i, (t, must) in enumerate(ts)]
    vocabulary = sorted({w for *_, ws, _ in sets for w in ws})
    df = document_frequency(documents, vocabulary)
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (df.get(w, 0), w)))}
    rows, prefix = [], set()
    for label, i, length, ws, must in sets:
        ranked = sorted(order[w] for w in ws)
        least = math.ceil(threshold * len(ws) - 1e-9)
        for at, r in enumerate(ranked[: len(ws) - least + 1]):
            rows.append((label, i, ranked, least, length, at, r, [order[w] for w in must]))
            prefix.add(sorted(vocabulary, key=order.get)[r])

    def may(low: Column) -> Column:
        """Whether a text holds what some template must have: substring tests are wider than the token test, and cheap."""
        out = F.lit(False)
        for _, _, _, ws, must in sets:
            held = F.lit(0)
            for w in ws:
                held += F.contains(low, F.lit(w)).cast("int")
            one = F.lit(True)
            for w in must:
                one &= F.contains(low, F.lit(w))
            out |= one & (held >= math.ceil(threshold * len(ws) - 1e-9))
        return out

    # As long as the fixed list of templates: a few hundred short rows at most.
    side = F.broadcast(spark.createDataFrame(rows, "label string, template int, t array<int>, least int, length int, t_at int, token int, must array<int>"))
    rank = F.create_map(*[F.lit(x) for w, r in order.items() for x in (w, r)])
    # The map is searched one by one, so other words are sorted out by a hash set first.
    ranked_word = lambda x: F.when(x.isin(vocabulary), F.element_at(rank, x))
    text = F.col("text")
    some = documents.filter(let(F.lower(text), may)).select("doc_id", F.xxhash64(text).alias("text_hash"), "text")
    anchor = F.get("must", F.lit(0))
    found = ["doc_id", "text_hash", "place", "anchor", "label", "overlap", "size"]
    blocks = (
        some.select("doc_id", "text_hash", F.posexplode(F.split(text, r"\n|(?<=[.!?;])[ \t]+")).alias("place", "block"))
        .filter(has_any(F.lower("block"), sorted(prefix)))
        .select("doc_id", "text_hash", "place", words_of(F.col("block")).alias("w"))
        .select("doc_id", "text_hash", "place", F.sort_array(F.array_distinct(F.filter(F.transform("w", ranked_word), lambda r: r.isNotNull()))).alias("b"))
    )
    pairs = (
        blocks.select("doc_id", "text_hash", "place", "b", F.posexplode("b").alias("b_at", "token"))
        .join(side, "token")
        .filter(F.size("b") >= F.col("least"))  # length
        .filter(1 + F.least(F.size("t") - 1 - F.col("t_at"), F.size("b") - 1 - F.col("b_at")) + F.least(F.col("t_at"), F.col("b_at")) >= F.col("least"))  # position
        .withColumn("overlap", F.size(F.array_intersect("t", "b")))
        .filter((F.col("overlap") >= F.col("least")) & (F.size(F.array_intersect("must", "b")) == F.size("must")))
        .withColumns({"anchor": anchor, "size": F.size("t"), "place": -1 - F.col("place")})  # below 0, apart from places of words
    )
    # Windows of a template's length over the whole text around its prefix tokens; null ranks are other words. A
    # window counts for each place of the anchor in it.
    whole = some.select("doc_id", "text_hash", F.transform(words_of(text), ranked_word).alias("r"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("length") + 1), F.col("at"))
    windows = (
        whole.select("doc_id", "text_hash", "r", F.posexplode("r").alias("at", "token"))
        .join(side, "token")
        .withColumn("start", F.explode(starts))
        .withColumn("w", F.slice("r", F.col("start") + 1, F.col("length")))
        .withColumn("overlap", F.size(F.array_intersect("w", "t")))
        .filter((F.col("overlap") >= F.col("least")) & (F.size(F.array_intersect("must", "w")) == F.size("must")))
        .withColumn("place", F.explode(F.filter(F.transform("w", lambda x, k: F.when(x == anchor, F.col("start") + k)), lambda p: p.isNotNull())))
        .withColumns({"anchor": anchor, "size": F.size("t")})
    )
    best = pairs.select(*found).unionByName(windows.select(*found)).groupBy("doc_id", "text_hash", "place", "anchor", "label", "size").agg(F.max("overlap").alias("overlap"))
    most = best.groupBy("doc_id", "text_hash", "place", "anchor").agg(F.max("overlap").alias("most"), F.collect_list(F.struct("label", "overlap", "size")).alias("each"))  # as long as the list of templates
    kept = most.select("doc_id", "text_hash", F.explode(F.filter("each", lambda x: x["overlap"] == F.col("most"))).alias("x"))
    return kept.groupBy("doc_id", "text_hash", F.col("x.label").alias("label")).agg(F.max(F.col("x.overlap") / F.col("x.size")).alias("containment"))


def base_places(words: Column) -> Column:
    """Where each phrase starts: an array of (at, label), places in the order of the words."""

    def places(phrase: list[str], label: str) -> Column:
        def stands(i: Column) -> Column:
            out = F.coalesce(F.get(words, i) == phrase[0], F.lit(False))
            for k, w in enumerate(phrase[1:], 1):
                out &= F.coalesce(F.get(words, i + k) == w, F.lit(False))
            return out

        starts = F.filter(F.transform(words, lambda x, i: i), stands)
        return F.transform(starts, lambda i: F.struct(i.cast("bigint").alias("at"), F.lit(label).alias("label")))

    return F.concat(*[places(p.split(), label) for p, label in PHRASES.items()])


def scan(documents: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Per document: n_words, the places of the base phrases, base and all labels, and the best containment (1 where
    a base phrase stands)."""
    matches = template_matches(documents, threshold).groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    matches = matches.withColumnsRenamed({"doc_id": "m_id", "text_hash": "m_hash"})

    def maybe(low: Column) -> Column:
        out = F.lit(False)
        for phrase in PHRASES:
            near = F.lit(True)
            for w in phrase.split():
                near &= F.contains(low, F.lit(w))
            out |= near
        return out

    none = F.array().cast("array<struct<at:bigint,label:string>>")
    d = documents.select(
        "doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(CASED_WORD)).cast("bigint").alias("n_words"),
        F.when(F.col("text").isNotNull() & let(F.lower("text"), maybe), let(words_of(F.col("text")), base_places)).otherwise(none).alias("base"),
    )
    d = d.join(matches, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash")), "left")
    at, own = F.transform("base", lambda x: x["at"]), F.transform("base", lambda x: x["label"])
    return d.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(own)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(own, F.coalesce("found", F.array().cast("array<string>"))))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
