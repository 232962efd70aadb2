"""Seeded generators of small fixtures: a forum corpus, actors with evidence, a wallet graph, persona migrations."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START = datetime(2024, 1, 1)


def corpus(spark: SparkSession, actors: int = 100, posts: int = 1000, seed: int = 26151) -> tuple[DataFrame, DataFrame]:
    """(aliases, posts): two to four aliases an actor, posts with replies."""
    rng = random.Random(seed)
    aliases, out = [], []
    for a in range(actors):
        for k in range(rng.randint(2, 4)):
            aliases.append((f"al{len(aliases):05d}", f"a{a:04d}", f"{rng.choice(['dark', 'silent', 'iron', 'lucky'])}_{rng.choice(['fox', 'wolf', 'owl', 'crow'])}{rng.randint(1, 99)}", ("forum", "market", "channel", "surface")[k % 4]))
    words = [f"w{i}" for i in range(300)]
    for p in range(posts):
        al = rng.choice(aliases)
        parent = f"p{rng.randrange(p):06d}" if p and rng.random() < 0.15 else None
        out.append((f"p{p:06d}", al[0], al[3], parent, " ".join(rng.choice(words) for _ in range(rng.randint(10, 60))), START + timedelta(minutes=rng.randint(0, 500_000))))
    return spark.createDataFrame(aliases, "alias_id string, actor_id string, handle string, platform string"), spark.createDataFrame(out, "post_id string, alias_id string, platform string, parent_post_id string, body string, posted_at timestamp_ntz")


def styled_corpus(spark: SparkSession, actors: int = 100, posts: int = 1000, styles: int = 12, seed: int = 26151) -> DataFrame:
    """(id, actor, platform, style, posts, text) of aliases whose actors write in their own way: a style class gives the
    sign-off and the punctuation, the actor some favourite words; topics are shared. Two to four aliases an actor."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3)))
    topics = [word() for _ in range(260)] + ["you", "your", "are", "please", "thanks", "because", "big", "buy", "sell", "good", "help", "start", "the", "and", "with", "for", "is", "not"] * 4
    signs = [(f"{word()} {word()}", rng.choice(["!", "...", " --", ";", "."])) for _ in range(styles)]
    aliases = []
    for a in range(actors):
        style, own = rng.randrange(styles), [word() + word() for _ in range(5)]
        aliases += [(f"al{len(aliases) + k:05d}", f"a{a:04d}", ("forum", "market", "channel", "surface")[k % 4], style, own) for k in range(rng.randint(2, 4))]
    texts: dict[str, list[str]] = {}
    for _ in range(posts):
        alias, _, _, style, own = rng.choice(aliases)
        sign, mark = signs[style]
        body = [rng.choice(own) if rng.random() < 0.07 else rng.choice(topics) for _ in range(rng.randint(12, 50))]
        texts.setdefault(alias, []).append(" ".join(body) + mark + " " + sign + mark)
    rows = [(i, actor, platform, style, len(texts.get(i, [])), "\n".join(texts.get(i, []))) for i, actor, platform, style, _ in aliases]
    return spark.createDataFrame(rows, "id string, actor string, platform string, style int, posts int, text string")


def wallet_graph(spark: SparkSession, wallets: int = 60, transactions: int = 400, seed: int = 7) -> DataFrame:
    """(tx_id, input, output, amount, ts)."""
    rng = random.Random(seed)
    rows = []
    for t in range(transactions):
        ins, outs = rng.sample(range(wallets), rng.randint(1, 2)), rng.sample(range(wallets), rng.randint(1, 3))
        rows += [(f"t{t:05d}", f"w{i:03d}", f"w{o:03d}", round(100 * rng.random(), 4), START + timedelta(hours=t)) for i in ins for o in outs]
    return spark.createDataFrame(rows, "tx_id string, input string, output string, amount double, ts timestamp_ntz")


def migrate(profiles: DataFrame, level: int) -> DataFrame:
    """A persona that changes, cumulatively: 1 alias, 2 vocabulary, 3 time zone, 4 platform, 5 identifiers."""
    change = {1: "alias", 2: "vocabulary", 3: "timezone", 4: "platform", 5: "identifier"}
    return profiles.withColumns({c: F.when(F.lit(level >= k), F.concat(c, F.lit("_new"))).otherwise(F.col(c)) for k, c in change.items()})


def scenario(evidence: DataFrame, kind: str) -> DataFrame:
    """A mutated evidence set: missing, duplicated, contradicting, stale or low in confidence."""
    if kind == "missing":
        return evidence.filter(F.crc32(F.col("evidence_id").cast("string").cast("binary")) % 3 != 0)
    if kind == "duplicated":
        return evidence.unionByName(evidence.withColumn("evidence_id", F.concat("evidence_id", F.lit("-copy"))))
    if kind == "contradicting":
        return evidence.withColumn("role", F.when(F.crc32(F.col("evidence_id").cast("string").cast("binary")) % 2 == 0, "contradicts").otherwise(F.col("role")))
    if kind == "stale":
        return evidence.withColumn("observed_at", F.col("observed_at") - F.expr("interval 365 days"))
    if kind == "low_confidence":
        return evidence.withColumn("confidence", F.col("confidence") / 2)
    raise ValueError(kind)
