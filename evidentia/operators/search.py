"""Ranked search over documents: an inverted index as tables, BM25, exact, phrase and hybrid scoring.

Statistics (number of documents, document frequency, mean length) come from the whole index, before filters; the
greatest lexical score of a hybrid search comes from the filtered candidates.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import tokens
from evidentia.operators.dedup import checkpointed
from evidentia.operators.relational import all_of

K1, B = 1.2, 0.75
EXACT_BONUS, PHRASE_BONUS = 2.0, 3.0
LEXICAL, SEMANTIC = 0.7, 0.3
#: Trigrams of words divided by spaces, one at each place (not inside a surrogate pair).
TRIGRAM = r"(?![\uDC00-\uDFFF])(?=([^ ]{3}))"


@dataclass(frozen=True)
class SearchQuery:
    text: str = ""
    mode: str = "terms"  # terms, exact, phrase
    hybrid: bool = False
    limit: int | None = 20
    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        if self.mode not in ("terms", "exact", "phrase"):
            raise ValueError(f"unknown mode {self.mode}")
        if self.limit is not None and not 1 <= self.limit <= 1000:
            raise ValueError("limit is from 1 to 1000")
        if self.text.strip() and not self.terms:
            raise ValueError("the text has no word")

    @property
    def terms(self) -> list[str]:
        return re.findall(r"\w+", self.text.lower())


def latest(documents: DataFrame, version: str) -> DataFrame:
    """Upsert: the last version of each doc_id."""
    w = Window.partitionBy("doc_id").orderBy(F.desc(version))
    return documents.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def postings(documents: DataFrame, fields: list[str]) -> DataFrame:
    """token, doc_id, field, tf, length (of the document over all fields): bucket or sort it by token to keep it."""
    each = [tokens(F.coalesce(F.col(f), F.lit(""))) for f in fields]
    d = documents.select("doc_id", *[e.alias(f) for e, f in zip(each, fields, strict=True)])
    d = d.withColumn("length", sum((F.size(f) for f in fields[1:]), F.size(fields[0])))
    one = [d.select("doc_id", "length", F.lit(f).alias("field"), F.explode(f).alias("token")) for f in fields]
    out = one[0]
    for o in one[1:]:
        out = out.unionByName(o)
    return out.groupBy("token", "doc_id", "field", "length").agg(F.count(F.lit(1)).alias("tf"))


def _counts(documents: DataFrame, words: list[str], weights: dict[str, float], condition: Column | None, hybrid: bool) -> DataFrame:
    """One row of numbers for each document, from one pass over the texts: length, the count and the weighted frequency
    of each distinct word asked for, the fields with a word, the fields with the phrase, whether a whole field is the
    query, and what the sets of words and trigrams share with the query's.

    The rows are written, so that statistics, greatest score and scores don't read the texts again."""
    fields, terms = list(weights), list(dict.fromkeys(words))
    kept = F.coalesce(condition, F.lit(False)) if condition is not None else F.lit(True)
    d = documents.select("doc_id", kept.alias("kept"), *[tokens(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f"w{j}") for j, f in enumerate(fields)])
    sizes = [F.size(f"w{j}") for j in range(len(fields))]
    n = lambda j, t: sizes[j] - F.size(F.array_remove(f"w{j}", t))
    per_field = [F.array(*[n(j, t) for t in terms]).alias(f"c{j}") for j in range(len(fields))]
    lines = [F.concat(F.lit(" "), F.array_join(f"w{j}", " "), F.lit(" ")).alias(f"l{j}") for j in range(len(fields))]
    words_set = F.array_distinct(F.concat(*[f"w{j}" for j in range(len(fields))])).alias("u")
    d = d.select("doc_id", "kept", sum(sizes[1:], sizes[0]).alias("length"), *per_field, *lines, *([words_set] if hybrid else []))
    asked = " " + " ".join(words) + " "
    named = lambda test: F.array_compact(F.array(*[F.when(test(j), F.lit(f)) for j, f in sorted(enumerate(fields), key=lambda x: x[1])]))
    count = lambda i, by: sum((F.col(f"c{j}")[i] * by(f) for j, f in enumerate(fields[1:], 1)), F.col("c0")[i] * by(fields[0]))
    out = [
        F.array(*[count(i, lambda f: 1) for i in range(len(terms))]).alias("n"),
        F.array(*[count(i, lambda f: float(weights[f])) for i in range(len(terms))]).alias("tf"),
        named(lambda j: F.array_max(f"c{j}") > 0).alias("with_word"),
        named(lambda j: F.contains(f"l{j}", F.lit(asked))).alias("with_phrase"),
        F.array_contains(F.array(*[f"l{j}" for j in range(len(fields))]), asked).alias("whole"),
    ]
    if not hybrid:
        return checkpointed(d.select("doc_id", "kept", "length", *out), "search")
    padded = F.concat(F.lit("##"), F.array_join("u", "## ##"), F.lit("##"))
    grams = F.array_distinct(F.regexp_extract_all(F.when(F.col("kept") & (F.size("u") > 0), padded).otherwise(""), F.lit(TRIGRAM), 1))
    d = d.select("doc_id", "kept", "length", *out, F.size("u").alias("words"), F.size(F.array_intersect("u", F.array(*map(F.lit, terms)))).alias("words_shared"), grams.alias("g"))
    asked_grams = sorted({f"##{t}##"[i : i + 3] for t in terms for i in range(len(t) + 2)})
    shared = F.size(F.array_intersect("g", F.array(*map(F.lit, asked_grams))))
    dice = 2 * shared / (F.size("g") + len(asked_grams))
    jaccard = F.col("words_shared") / (F.col("words") + len(terms) - F.col("words_shared"))
    return checkpointed(d.select("doc_id", "kept", "length", "n", "tf", "with_word", "with_phrase", "whole", (0.5 * dice + 0.5 * jaccard).alias("semantic")), "search")


def _scored(counts: DataFrame, terms: list[str]) -> DataFrame:
    """The kept documents with hits (distinct words found) and lexical (BM25); the statistics, one row, come from all."""
    stats = counts.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean"), *[F.count_if(F.col("n")[i] > 0).alias(f"df{i}") for i in range(len(terms))])
    score, hits = F.lit(0.0), F.lit(0)
    for i in range(len(terms)):
        tf, df = F.col("tf")[i], F.col(f"df{i}")
        idf = F.ln(1 + (F.col("docs") - df + 0.5) / (df + 0.5))
        score += F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))).otherwise(0.0)
        hits += (F.col("n")[i] > 0).cast("int")
    return counts.filter("kept").crossJoin(F.broadcast(stats)).select(*counts.columns, hits.alias("hits"), score.alias("lexical"))


def bm25(documents: DataFrame, terms: list[str], body: str = "text", condition: Column | None = None, hits: int = 1) -> DataFrame:
    """doc_id, lexical of the documents with at least that many of the terms."""
    terms = list(dict.fromkeys(terms))
    return _scored(_counts(documents, terms, {body: 1.0}, condition, False), terms).filter(F.col("hits") >= hits).select("doc_id", "lexical")


def search(documents: DataFrame, query: SearchQuery, body: str = "text", condition: Column | None = None) -> DataFrame:
    """doc_id, score, lexical, semantic, matched_fields, matched_terms, total; ordered by score and doc_id, cut at the
    limit.

    Fields and their weights are those of the query, or the body alone. Exact needs every word, and a whole field equal
    to the query earns a bonus; a phrase must stand in one field. matched_fields are sorted (with the phrase for
    phrases, with a word otherwise), matched_terms keep the query's order. A null field is empty."""
    terms = list(dict.fromkeys(query.terms))
    none = F.array().cast("array<string>")
    if not terms:
        out = documents.filter(condition if condition is not None else F.lit(True)).select("doc_id", *[F.lit(0.0).alias(c) for c in ("score", "lexical", "semantic")], none.alias("matched_fields"), none.alias("matched_terms"))
        out = out.crossJoin(F.broadcast(out.agg(F.count(F.lit(1)).alias("total")))).orderBy("doc_id")
        return out if query.limit is None else out.limit(query.limit)
    found = _scored(_counts(documents, query.terms, query.weights or {body: 1.0}, condition, query.hybrid), terms)
    if query.mode == "phrase":
        found = found.filter(F.size("with_phrase") > 0).withColumn("lexical", F.col("lexical") + PHRASE_BONUS)
    elif query.mode == "exact":
        found = found.filter(F.col("hits") == len(terms)).withColumn("lexical", F.col("lexical") + F.when(F.col("whole"), EXACT_BONUS).otherwise(0.0))
    elif not query.hybrid:
        found = found.filter("hits > 0")
    if query.hybrid:
        found = found.filter("lexical > 0 or semantic > 0")
        top = found.agg(F.max("lexical").alias("top"), F.count(F.lit(1)).alias("total"))
        found = found.crossJoin(F.broadcast(top)).withColumn("score", LEXICAL * F.when(F.col("top") > 0, F.col("lexical") / F.col("top")).otherwise(0.0) + SEMANTIC * F.col("semantic"))
    else:
        found = found.withColumn("semantic", F.lit(0.0)).withColumn("score", F.col("lexical")).crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("total"))))
    matched = F.array_compact(F.array(*[F.when(F.col("n")[i] > 0, F.lit(t)) for i, t in enumerate(terms)]))
    fields = F.col("with_phrase" if query.mode == "phrase" else "with_word")
    out = found.select("doc_id", "score", "lexical", "semantic", fields.alias("matched_fields"), matched.alias("matched_terms"), "total").orderBy(F.desc("score"), "doc_id")
    return out if query.limit is None else out.limit(query.limit)


def passes(since=None, until=None, sources=(), entity_ids=(), case_ids=(), at: str = "ts", source: str = "source", entities: str = "entity_ids", cases: str = "case_ids") -> Column:
    """Search filters: inclusive time bounds, any of the sources, entities and cases; a missing value fails a filter."""
    any_of = lambda c, values: F.arrays_overlap(c, F.array(*map(F.lit, values)))
    parts = [
        F.col(at) >= F.lit(since) if since is not None else None, F.col(at) <= F.lit(until) if until is not None else None,
        F.col(source).isin(*sources) if sources else None, any_of(entities, entity_ids) if entity_ids else None, any_of(cases, case_ids) if case_ids else None,
    ]
    return F.coalesce(all_of(*parts), F.lit(False))
