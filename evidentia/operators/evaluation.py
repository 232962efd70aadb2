"""Splits, leakage, sampling, drift and the record of experiments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import scores as S
from evidentia.functions import text as X
from evidentia.operators import blocks
from evidentia.operators.dedup import checkpointed
from evidentia.operators.resolution import set_pairs, sparse_cosine_pairs, tfidf


def temporal_split(df: DataFrame, at: str, cutoff) -> DataFrame:
    return df.withColumn("part", F.when(F.col(at) < F.lit(cutoff).cast("timestamp_ntz"), "train").otherwise("test"))


def hash_split(df: DataFrame, group: str, shares: dict[str, float], seed: int = 26151) -> DataFrame:
    """Whole groups by a seeded hash, e.g. train .6, validation .2, test .2."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double") / 2**32
    edge, out, name = 0.0, None, None
    for name, share in shares.items():
        edge += share
        out = F.when(h < edge, name) if out is None else out.when(h < edge, name)
    return df.withColumn("part", out.otherwise(name))


def leakage(split: DataFrame, group: str) -> DataFrame:
    """Groups that stand in several parts; none in a sound split."""
    return split.groupBy(group).agg(F.count_distinct("part").alias("parts")).filter("parts > 1")


def sample_negatives(pairs: DataFrame, per_positive: int = 4, seed: int = 26151) -> DataFrame:
    """All positives and per_positive times as many negatives, those of the smallest seeded hash."""
    n = pairs.filter("label = 1").count()
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), "l", "r").cast("binary"), 256)
    return pairs.filter("label = 1").unionByName(pairs.filter("label = 0").orderBy(order, "l", "r").limit(per_positive * n))


def drift(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """The shift of the mean over the reference's mean, at most 1: one row."""
    r, c = reference.agg(F.avg(column).alias("r")), current.agg(F.avg(column).alias("c"))
    return r.crossJoin(c).select(F.least(F.lit(1.0), F.abs(F.col("c") - F.col("r")) / F.greatest(F.abs("r"), F.lit(1e-9))).alias("drift"))


def degradation(baseline: Column, migrated: Column) -> Column:
    return F.greatest(F.lit(0.0), baseline - migrated)


def experiment_id(name: Column, config: Column) -> Column:
    """A slug of the name and eight digits of the configuration's hash."""
    slug = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.concat(slug, F.lit("-"), F.substring(F.sha2(config.cast("binary"), 256), 1, 8))


def register(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New experiments whose id isn't taken."""
    return new.withColumn("id", experiment_id(F.col("name"), F.col("config"))).dropDuplicates(["id"]).join(existing.select("id"), "id", "left_anti")


#: The pair features, in order.
PAIR_FEATURES = ["handle_edit", "handle_grams", "text_cosine", "window", "identifiers", "platforms", "hours", "graph", "reliability"]


def pair_features(pairs: DataFrame, aliases: DataFrame, texts: DataFrame, identifiers: DataFrame, platforms: DataFrame, links: DataFrame) -> DataFrame:
    """Nine features of each (l, r). aliases: id, handle, first_seen, last_seen, hours (24 counts), reliability (NULL:
    unknown); texts: id, text; identifiers, platforms, links: (id, item). Each set feature is one join on its item."""
    vectors = tfidf(texts, X.tokens(F.col("text")))
    overlap = lambda d, name: set_pairs(d, "id", "item").select("l", "r", (F.col("shared") / F.col("union")).alias(name))
    side = lambda s: aliases.select(F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("handle", "first_seen", "last_seen", "hours", "reliability")])
    p = pairs.select(F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r")).distinct().join(side("l"), "l").join(side("r"), "r")
    for d in (sparse_cosine_pairs(vectors).withColumnRenamed("cosine", "text_cosine"), overlap(identifiers, "identifiers"), overlap(platforms, "platforms"), overlap(links, "graph")):
        p = p.join(d, ["l", "r"], "left")
    a, b = X.resolution_handle(F.col("l_handle")), X.resolution_handle(F.col("r_handle"))
    grams = lambda h: F.concat(*[X.char_ngrams(h, n) for n in (3, 4, 5)])
    return p.select(
        "l", "r", S.levenshtein_similarity(a, b).alias("handle_edit"), S.dice(F.array_distinct(grams(a)), F.array_distinct(grams(b))).alias("handle_grams"), F.least(F.lit(1.0), F.coalesce("text_cosine", F.lit(0.0))).alias("text_cosine"),
        S.window_iou(F.col("l_first_seen"), F.col("l_last_seen"), F.col("r_first_seen"), F.col("r_last_seen")).alias("window"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("identifiers", "platforms")], S.cosine(F.col("l_hours"), F.col("r_hours")).alias("hours"), F.coalesce("graph", F.lit(0.0)).alias("graph"),
        ((F.coalesce("l_reliability", F.lit(0.5)) + F.coalesce("r_reliability", F.lit(0.5))) / 2).alias("reliability"),
    )


#: Pairs of one batch of pairs_within.
PAIRS_A_BATCH = 250_000


def _rows(c: pa.ListArray) -> np.ndarray:
    return np.repeat(np.arange(len(c)), c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))


def _met(held: pa.ListArray, held_weights=None):
    """A function that counts the items which some passing sets share with every held one; with weights, their products' sum."""
    index, owner, wide = held.flatten().dictionary_encode(null_encoding="encode"), _rows(held), len(held)
    codes = index.indices.to_numpy()
    order, count = np.argsort(codes, kind="stable"), np.bincount(codes, minlength=len(index.dictionary))
    listed, first = owner[order], np.cumsum(count) - count
    weights = None if held_weights is None else held_weights.flatten().to_numpy(zero_copy_only=False)[order]

    def of(passing: pa.ListArray, passing_weights=None) -> np.ndarray:
        at = pc.fill_null(pc.index_in(passing.flatten(), value_set=index.dictionary), -1).to_numpy(zero_copy_only=False)
        row, kept = _rows(passing), at >= 0
        row, at = row[kept], at[kept]
        many = count[at]
        place = np.repeat(first[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        w = None if weights is None else np.repeat(passing_weights.flatten().to_numpy(zero_copy_only=False)[kept], many) * weights[place]
        return np.bincount(np.repeat(row * wide, many) + listed[place], w, len(passing) * wide).reshape(len(passing), wide)

    return of


SETS = ("identifiers", "platforms", "graph")


def _features(held: pa.Table, passing: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PAIR_FEATURES of all pairs of held and passing aliases, some passing ones at a time."""
    column = lambda t, c: t[c].combine_chunks() if isinstance(t, pa.Table) else t[c]
    number = lambda t, c: column(t, c).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    x = lambda c: column(held, c)
    sets, grams, terms = {c: _met(x(c)) for c in SETS}, _met(x("grams")), _met(x("terms"), x("weights"))
    handles, (known, hours, lengths) = blocks.texts(x("handle")), blocks.vectors(x("hours"))
    gram_sizes, named = x("grams").value_lengths().fill_null(0).to_numpy(zero_copy_only=False), x("handle").is_valid().to_numpy(zero_copy_only=False)
    since, until, trust = (number(held, c) for c in ("since", "until", "reliability"))
    half, wide = held["half"][0].as_py(), held.num_rows
    step = max(1, PAIRS_A_BATCH // wide)
    for b in (b.slice(lo, step) for b in passing for lo in range(0, b.num_rows, step)):
        y = lambda c: b[c]  # noqa: B023, E731
        kept = np.ones((b.num_rows, wide), bool)
        if half:  # Both sides are the same aliases: a pair counts where the later one passes.
            kept = np.arange(wide) < pc.index_in(y("id"), value_set=x("id")).to_numpy(zero_copy_only=False)[:, None]
        texts, (r_known, r_hours, r_lengths) = blocks.texts(y("handle")), blocks.vectors(y("hours"))
        longest = np.maximum(texts[1][:, None], handles[1])
        sizes = y("grams").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)[:, None] + gram_sizes
        valid = y("handle").is_valid().to_numpy(zero_copy_only=False)[:, None]
        unknown = ~(valid & named) & ~((longest == 0) & (valid | named))  # As levenshtein_similarity has it.
        with np.errstate(invalid="ignore", divide="ignore"):
            r_since, r_until = (number(b, c)[:, None] for c in ("since", "until"))
            span = np.fmax(r_until, until) - np.fmin(r_since, since)
            window = np.where(span == 0, 1.0, np.fmax(0.0, np.fmin(r_until, until) - np.fmax(r_since, since)) / span)
            out = {
                "handle_edit": np.where(longest == 0, 1.0, 1 - blocks.edits(texts, handles) / longest), "handle_grams": np.where(sizes == 0, 0.0, 2 * grams(y("grams")) / sizes),
                "text_cosine": np.minimum(1.0, terms(y("terms"), y("weights"))), "window": window, "hours": blocks.cosines((r_hours, r_lengths), (hours, lengths)),
                "reliability": (np.nan_to_num(number(b, "reliability"), nan=0.5)[:, None] + np.nan_to_num(trust, nan=0.5)) / 2,
            }
            for c in SETS:
                k = sets[c](y(c))
                out[c] = np.where(k > 0, k / (y(f"n_{c}").to_numpy()[:, None] + x(f"n_{c}").to_numpy() - k), 0.0)
        nulls = {"handle_edit": unknown, "window": np.isnan(window), "hours": ~(r_known[:, None] & known)}
        r, l = kept.nonzero()
        arrays = [pa.array(out[c][kept], pa.float64(), mask=nulls[c][kept] if c in nulls else None) for c in PAIR_FEATURES]
        yield pa.RecordBatch.from_arrays([x("id").take(pa.array(l)), y("id").take(pa.array(r)), *arrays], names=["l", "r", *PAIR_FEATURES])


def pairs_within(aliases: DataFrame, group: str, texts: DataFrame, identifiers: DataFrame, platforms: DataFrame, links: DataFrame) -> DataFrame:
    """pair_features of all pairs l < r of the aliases of each group.

    These pairs are many times the aliases, so they are neither shuffled nor joined: an alias comes as one row with its
    sets and its text's terms, and the cells of each group's grid work its pairs out where they are output."""
    vectors = tfidf(texts, X.tokens(F.col("text"))).groupBy("id").agg(F.collect_list(F.struct("term", "w")).alias("v"))
    out = aliases.filter(F.col(group).isNotNull()).join(vectors, "id", "left")
    for d, c in ((identifiers, "identifiers"), (platforms, "platforms"), (links, "graph")):
        sets = d.groupBy("id").agg(F.collect_set("item").alias(c), F.bool_or(F.col("item").isNull()).alias("u"))
        out = out.join(sets.select("id", c, (F.size(c) + F.col("u").cast("int")).alias(f"n_{c}")), "id", "left")
    handle = X.resolution_handle(F.col("handle"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    kinds = {c: out.schema[c].dataType.elementType.simpleString() for c in SETS}
    rows = out.select(
        group, "id", handle.alias("handle"), F.array_distinct(F.concat(*[X.char_ngrams(handle, n) for n in (3, 4, 5)])).alias("grams"), S.seconds(F.col("first_seen")).alias("since"), S.seconds(F.col("last_seen")).alias("until"), "hours", F.col("reliability").cast("double").alias("reliability"),
        none(F.col("v.term"), "string").alias("terms"), none(F.col("v.w"), "double").alias("weights"), *[none(F.col(c), kinds[c]).alias(c) for c in SETS], *[F.coalesce(f"n_{c}", F.lit(0)).alias(f"n_{c}") for c in SETS],
    )
    rows = checkpointed(rows, "aliases")
    met, cell, n = blocks.dealt_within(rows, group, "id", F.lit(64) + sum(F.size(c) for c in (*SETS, "grams", "terms")))
    kind = rows.schema["id"].dataType.simpleString()
    pairs = blocks.streamed(met, cell, n, _features, f"l {kind}, r {kind}, " + ", ".join(f"{c} double" for c in PAIR_FEATURES))
    return pairs.withColumns({"l": F.least("l", "r"), "r": F.greatest("l", "r")})
